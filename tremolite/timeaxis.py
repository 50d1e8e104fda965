"""The time matrix: rows (i, us) <-> windows, samples, bounds (survey section 1.3).

Row 1 holds the absolute start, middle rows the deviation from one sampling step before
sample i, the last row the number of samples (and a deviation if the last sample is itself
preceded by a gap).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Rates (Hz) that make a channel regular: a step of 1 microsecond to about thirty years.
RATES = (1e-9, 1e6)


def delta_us(fs: Column | str) -> Column:
    """Sampling step in microseconds, rounded half-even; null for irregular channels and impossible rates (null, NaN, infinite)."""
    fs = F.col(fs) if isinstance(fs, str) else fs
    return F.when(fs.between(*RATES), F.rint(F.lit(1e6) / fs).cast("long"))


def windows_of(i: np.ndarray, us: np.ndarray, off: np.ndarray, d: np.ndarray):
    """Windows of many matrices at once.

    i, us: all rows of all matrices; off: row offsets, one more than matrices; d: steps.
    Gives (matrix number, segment number, first index, last index, start, end), each per window.
    O(rows), no Python loop.
    """
    n = np.diff(off)
    own = np.repeat(np.arange(len(n)), n)
    first = np.zeros(len(i), bool)
    last = np.zeros(len(i), bool)
    first[off[:-1][n > 0]] = True
    last[off[1:][n > 0] - 1] = True
    starts = first | ~last | (last & (us != 0))
    gaps = np.cumsum(us)
    base = np.zeros(len(n), np.int64)
    base[n > 0] = np.where(off[:-1][n > 0] > 0, gaps[off[:-1][n > 0] - 1], 0)
    t = gaps - base[own] + (i - 1) * d[own]
    k = np.flatnonzero(starts)
    m = own[k]
    nxt = np.r_[k[1:], -1] if len(k) else k
    same = np.r_[m[1:] == m[:-1], False] if len(k) else np.zeros(0, bool)
    end_i = np.where(same, i[nxt] - 1, i[off[m + 1] - 1])
    seg = np.arange(len(k)) - np.r_[0, np.flatnonzero(~same)[:-1] + 1].repeat(np.diff(np.r_[0, np.flatnonzero(~same) + 1])) if len(k) else k
    s = t[k]
    keep = end_i >= i[k]
    return m[keep], seg[keep], i[k][keep], end_i[keep], s[keep], (s + (end_i - i[k]) * d[m])[keep]


def windows(df: DataFrame, keys: list[str], t: str = "t", fs: str = "fs") -> DataFrame:
    """Time matrices to windows: keys, d (step), seg, i0, i1, t0_us, t1_us (inclusive).

    Only regular channels (fs > 0); null or empty matrices, and rows whose matrix holds a
    null, give no windows.  No shuffle.
    """
    src = df.where(delta_us(fs).isNotNull() & (F.size(t) > 0)).select(*keys, delta_us(fs).alias("_d"), F.col(f"{t}.i").alias("_i"), F.col(f"{t}.us").alias("_u"))
    src = src.where(~F.exists("_i", lambda x: x.isNull()) & ~F.exists("_u", lambda x: x.isNull()))
    kept = src.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            li, lu = b.column("_i"), b.column("_u")
            off = np.asarray(li.offsets, dtype=np.int64)
            off = off - off[0]
            d = np.asarray(b.column("_d"), dtype=np.int64)
            m, seg, i0, i1, t0, t1 = windows_of(np.asarray(li.flatten(), dtype=np.int64), np.asarray(lu.flatten(), dtype=np.int64), off, d)
            take = pa.array(m)
            cols = [b.column(k).take(take) for k in keys]
            cols += [pa.array(x.astype(np.int64)) for x in (d[m], seg, i0, i1, t0, t1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "d", "seg", "i0", "i1", "t0_us", "t1_us"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", d bigint, seg bigint, i0 bigint, i1 bigint, t0_us bigint, t1_us bigint"
    return src.mapInArrow(run, schema)


#: Steps of a time shard: what the window of one task sees of a channel, however long it is.
SHARD_STEPS = 65_536


def sharded(df: DataFrame, keys: list[str], order: str, width: int | Column) -> DataFrame:
    """df with _key (the keys as one value; null equals null) and _sh, a number of its shard that grows with ``order``.

    Rows without an order have no place: what is made from shards leaves them out.
    """
    return df.withColumn("_key", F.struct(*keys)).withColumn("_sh", F.floor(F.col(order) / width))


def within(*order: str | Column) -> WindowSpec:
    """The window of a shard."""
    return Window.partitionBy("_key", "_sh").orderBy(*order)


def carried(df: DataFrame, of_shard: dict[str, Column], carry: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
    """Sharded df with what each row's shard takes over from the shards before it.

    of_shard: aggregates of a shard; carry: columns made from these, given the window over a key's shards in order and that of
    all shards before the current one.  That table has one row a shard, and is joined on what df is partitioned by anyway.
    """
    w = Window.partitionBy("_key").orderBy("_sh")
    one = df.groupBy("_key", "_sh").agg(*[c.alias(n) for n, c in of_shard.items()])
    new = carry(w, w.rowsBetween(Window.unboundedPreceding, -1))
    return df.join(one.select("_key", "_sh", *[c.alias(n) for n, c in new.items()]), ["_key", "_sh"])


def previous(df: DataFrame, keys: list[str], order: str, width: int | Column, col: str, out: str) -> DataFrame:
    """df with ``out``, the value of ``col`` in the row before by ``order`` (null in a key's first row)."""
    d = sharded(df, keys, order, width)
    d = carried(d, {"_last": F.max_by(F.struct(col), F.struct(order, col))}, lambda w, _: {"_carry": F.lag("_last").over(w)})
    w = within(order, col)
    lag = F.when(F.row_number().over(w) == 1, F.col(f"_carry.{col}")).otherwise(F.lag(col).over(w))
    return d.withColumn(out, lag).select(*df.columns, out)


def running(df: DataFrame, keys: list[str], order: str, width: int | Column, value: Column, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``out``, the sum of ``value`` over the rows up to each by ``order``."""
    d = sharded(df, keys, order, width).withColumn("_v", value)
    d = carried(d, {"_sum": F.sum("_v")}, lambda _, before: {"_carry": F.sum("_sum").over(before)})
    up = within(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_v").over(up)
    return d.withColumn(out, F.when(F.col("_carry").isNull(), total).otherwise(F.coalesce(total, F.lit(0)) + F.col("_carry"))).select(*df.columns, out)


def islands(df: DataFrame, keys: list[str], order: str, width: int | Column, lo: Column, hi: Column, out: str = "seg") -> DataFrame:
    """df with ``out``, a number (0, 1, ...) that grows by one at each row whose ``order`` isn't between lo and hi after the row before.

    lo and hi are the same for all rows of a key.
    """
    d = sharded(df.withColumn("_lo", lo).withColumn("_hi", hi), keys, order, width)
    w = within(order)
    new = lambda a, b: F.coalesce((~(b - a).between(F.col("_lo"), F.col("_hi"))).cast("long"), F.lit(0).cast("long"))
    d = d.withColumn("_new", new(F.lag(order).over(w), F.col(order))).withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = d.groupBy("_key", "_sh").agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.sum("_new").alias("_n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    # whether a shard's first row is new depends on the last one before it; its step counts for its shard and all later ones
    k = Window.partitionBy("_key").orderBy("_sh")
    one = one.withColumn("_head", new(F.lag("_last").over(k), F.col("_first")))
    one = one.select("_key", "_sh", (F.sum(F.col("_head") + F.col("_n")).over(k.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    return d.join(one, ["_key", "_sh"]).withColumn(out, (F.col("_in") + F.col("_off")).cast("long")).select(*df.columns, out)


def segments_of_samples(samples: DataFrame, keys: list[str], t: str, step: int | Column, tol: str = "half") -> DataFrame:
    """Samples with ``seg``, a running number of contiguous segments in time order.

    tol 'half': a gap is significant if it deviates by more than half a step; 'exact': by anything.  Channels are cut into time
    shards, so no task sorts a channel.
    """
    step = F.lit(step).cast("long") if isinstance(step, int) else step.cast("long")
    slack = F.floor(step / 2) if tol == "half" else F.lit(0)
    return islands(samples, keys, t, step * SHARD_STEPS, step - slack, step + slack)


def segment_table(samples: DataFrame, keys: list[str], t: str, step: int | Column, tol: str = "half") -> DataFrame:
    """One row per contiguous segment: keys, seg, start_us, end_us, n."""
    s = segments_of_samples(samples, keys, t, step, tol)
    return s.groupBy(*keys, "seg").agg(F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.count(F.lit(1)).alias("n"))


def expand(windows_df: DataFrame, keys: list[str]) -> DataFrame:
    """Windows to sample times: keys, seg, i, t_us (``t_expand``); long windows in chunks of SHARD_STEPS."""
    n = F.col("i1") - F.col("i0")
    c = windows_df.select(*keys, "seg", "i0", "t0_us", "d", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / SHARD_STEPS))).alias("_c"))
    lo = F.col("_c") * SHARD_STEPS
    return c.select(*keys, "seg", "i0", "t0_us", "d", F.explode(F.sequence(lo, F.least(F.col("_n"), lo + SHARD_STEPS - 1))).alias("_k")).select(
        *keys, "seg", (F.col("i0") + F.col("_k")).alias("i"), (F.col("t0_us") + F.col("_k") * F.col("d")).alias("t_us")
    )


def collapse(samples: DataFrame, keys: list[str], t: str, step: int) -> DataFrame:
    """Sample times to time-matrix rows (``t_collapse``): keys, i, us: the first sample's time, every deviation from a step, and the last
    sample (deviation 0 if there is none).  A channel of one sample has one row."""
    x = previous(samples.select(*keys, t), keys, t, step * SHARD_STEPS, t, "_p")
    x = running(x, keys, t, step * SHARD_STEPS, F.lit(1).cast("long"), "i")
    end = samples.groupBy(*[F.col(k).alias(f"_e{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_e{n}")) for n, k in enumerate(keys)]
    dev = F.col(t) - F.col("_p") - step
    x = x.join(end, same).where(F.col("_p").isNull() | (F.col("i") == F.col("_n")) | (dev != 0))
    return x.select(*keys, "i", F.when(F.col("_p").isNull(), F.col(t)).otherwise(dev).alias("us"))


def bounds(windows_df: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest and latest sample time per channel, whatever the order of windows."""
    return windows_df.groupBy(*keys).agg(F.min("t0_us").alias("start_us"), F.max("t1_us").alias("end_us"))
