"""Live packets (T1-T11): continuation of channels across micro-batches, with state of one row per id.

Packets are pieces of a channel (id, t0_us, n, dt_us, ...).  Late or out-of-order packets are never dropped: they
open a segment of their own, as a stored time matrix would; a batch merge resolves overlaps later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tremolite import timeaxis

OUT = "id string, seg bigint, i0 bigint, t0_us bigint, t1_us bigint, n bigint, gap_us bigint"
STATE = "end_us bigint, n bigint, seg bigint"


def continue_channel(state: tuple[int, int, int] | None, packets: list[tuple[int, int, int]]) -> tuple[list[tuple], tuple[int, int, int]]:
    """Rows (seg, i0, t0, t1, n, gap) and the new state (end, samples, segment) of packets (t0, n, dt) in order of arrival.

    A packet continues the segment if it starts within half a step of the next sample time.
    """
    end, total, seg = state if state else (None, 0, -1)
    out = []
    for t0, n, dt in packets:
        if n <= 0:
            continue
        gap = 0 if end is None else t0 - end - dt
        if end is None or abs(gap) > dt // 2:
            seg += 1
        else:
            gap = 0
        t1 = t0 + (n - 1) * dt
        out.append((seg, total, t0, t1, n, gap))
        end, total = t1, total + n
    return out, (end, total, seg)


def segments_stream(packets: DataFrame) -> DataFrame:
    """T4: rows of OUT for each packet of a stream with columns id, t0_us, n, dt_us and ord (order of arrival)."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(pdfs)).sort_values("ord", kind="stable")
        rows, new = continue_channel(state.get if state.exists else None, list(zip(p["t0_us"].astype(int), p["n"].astype(int), p["dt_us"].astype(int))))
        if new[0] is not None:
            state.update(new)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["id", "seg", "i0", "t0_us", "t1_us", "n", "gap_us"])

    return packets.groupBy("id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def segments_batch(packets: DataFrame, width: int = 65_536) -> DataFrame:
    """The same rows from a finished table, by built-in windows over shards of ``width`` places in the order of arrival."""
    x = packets.where("n > 0").withColumn("t1_us", F.col("t0_us") + (F.col("n") - 1) * F.col("dt_us"))
    x = timeaxis.previous(x, ["id"], "ord", width, "t1_us", "_p")
    gap = F.col("t0_us") - F.col("_p") - F.col("dt_us")
    new = F.coalesce((F.abs(gap) > F.expr("dt_us div 2")).cast("long"), F.lit(1).cast("long"))
    x = x.withColumn("_g", gap).withColumn("_new", new)
    x = timeaxis.running(x, ["id"], "ord", width, F.col("_new"), "_seg")
    x = timeaxis.running(x, ["id"], "ord", width, F.col("n"), "_all")
    return x.select(
        "id", (F.col("_seg") - 1).alias("seg"), (F.col("_all") - F.col("n")).cast("long").alias("i0"), "t0_us", "t1_us", F.col("n").cast("long").alias("n"),
        F.when((F.col("_new") == 1) & F.col("_g").isNotNull(), F.col("_g")).otherwise(0).alias("gap_us"),
    )


def live(streams: DataFrame, now_us: int, gap_s: int = 3600) -> DataFrame:
    """Streams whose last packet is younger than gap_s seconds."""
    return streams.where(F.lit(now_us) - F.col("end_us") < gap_s * 1_000_000)


def windowed(packets: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """T7 (an addition): packets and samples per id and tumbling window, closed by a watermark."""
    return packets.withWatermark(ts, late).groupBy("id", F.window(ts, width)).agg(F.count(F.lit(1)).alias("packets"), F.sum("n").alias("samples")).select("id", F.col("window.start").alias("start"), "packets", "samples")


def without_repeats(packets: DataFrame, ts: str, late: str) -> DataFrame:
    """T6 (an addition): packets of the same id, start and length once within a watermark."""
    return packets.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id", "t0_us", "n"])


def tee(batch: DataFrame, path: str) -> DataFrame:
    """Raw packets of a micro-batch appended to a folder; gives the batch on."""
    batch.write.mode("append").parquet(path)
    return batch
