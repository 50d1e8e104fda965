"""Data model: schemas of the engine's tables, defaults, and bindings of plain tables to channels and samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOC = "struct<kind: string, datum: string, lat: double, lon: double, el: double, dep: double, az: double, inc: double, x: double, y: double, z: double, ox: double, oy: double, oz: double, zone: string, hemi: string, e: bigint, n: bigint, vec: array<double>>"
CPLX = "struct<re: double, im: double>"
STAGE = "struct<stage: int, fs: double, gain: double, fg: double, delay: double, corr: double, fac: bigint, os: bigint, i: string, o: string>"
RESP = f"struct<kind: string, a0: double, f0: double, p: array<{CPLX}>, z: array<{CPLX}>, b: array<double>, a: array<double>, stages: array<{STAGE}>>"
#: One row per channel; ``ch`` is the engine's number of a channel (ids needn't be unique).
CHANNELS = f"ch bigint, id string, name string, loc {LOC}, fs double, gain double, resp {RESP}, units string, src string, misc map<string,string>, notes array<string>, dtype string"
#: One row per contiguous segment, samples as a vector: the storage and DSP form.
TRACES = "ch bigint, seg bigint, t0_us bigint, dt_us bigint, fs double, x array<double>"
#: One row per sample: the form for relational operators.
SAMPLES = "ch bigint, seg bigint, i bigint, t_us bigint, x double"
NOTES = "ch bigint, ts timestamp, category string, call string, descr string"
PICK = "struct<amp: double, d: double, ia: double, res: double, rp: double, ta: double, tt: double, unc: double, pol: string, qual: string>"
EVENT = f"event_id string, ot timestamp, lat double, lon double, dep double, mag double, mag_scale string, typ string, src string, misc map<string,string>, picks map<string,{PICK}>"


@dataclass(frozen=True)
class Defaults:
    """Keyword defaults of readers, writers, filters and streams."""

    fmt: str = "miniseed"
    full: bool = False
    nd: float = 1.0
    prune: bool = True
    si: bool = True
    src: str = "IRIS"
    timeout_s: int = 60
    units: bool = False
    write: bool = False
    fl: float = 1.0
    fh: float = 15.0
    np: int = 4
    rp: float = 8.0
    rs: float = 30.0
    rt: str = "Bandpass"
    dm: str = "Butterworth"
    sl_refresh_s: float = 20.0
    sl_gap_s: int = 3600
    sl_keepalive_s: int = 600
    seismic: tuple[str, ...] = ("H", "J", "L", "M", "N", "P", "Z")
    unset: dict = field(default_factory=lambda: {"gain": 1.0, "fs": 0.0, "units": "", "magnitude": -5.0, "header": -12345.0})


KW = Defaults()


def us(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp column, whatever the session's zone for zoneless ones."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


HOUR, DAY = 3_600_000_000, 86_400_000_000


def regular(df: DataFrame, id_: Column, t_us: Column, step: int, value: Column) -> DataFrame:
    """Samples (id, t_us, x) of a grid: values summed per id and step; a missing step is a gap."""
    return df.select(id_.alias("id"), (t_us - F.pmod(t_us, F.lit(step))).alias("t_us"), value.cast("double").alias("x")).groupBy("id", "t_us").agg(F.sum("x").alias("x"))


def ev_hour(events: DataFrame) -> DataFrame:
    """Hourly sums of events per type: regular channels with real gaps."""
    return regular(events, F.col("event_type"), us("ts"), HOUR, F.col("value"))


def ev_irr(events: DataFrame) -> DataFrame:
    """Events of a user as an irregular channel: id, t_us, x, ord (the event's number)."""
    return events.select(F.col("user_id").cast("string").alias("id"), us("ts").alias("t_us"), F.col("value").alias("x"), F.col("event_id").alias("ord"))


def ship_day(lineitem: DataFrame) -> DataFrame:
    """Quantities shipped per day and flag: regular daily channels."""
    return regular(lineitem, F.concat("l_returnflag", "l_linestatus"), us("l_shipdate"), DAY, F.col("l_quantity"))


def ord_day(orders: DataFrame) -> DataFrame:
    """Order totals per day and priority: regular daily channels."""
    return regular(orders, F.col("o_orderpriority"), us("o_orderdate"), DAY, F.col("o_totalprice"))


def emb(embeddings: DataFrame) -> DataFrame:
    """Embeddings as gapless float32 segments: id, seg, t0_us, fs, x."""
    return embeddings.select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("t0_us"), F.lit(1.0).alias("fs"), F.col("embedding").cast("array<double>").alias("x"))
