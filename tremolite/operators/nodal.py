"""Nodal arrays (section 2.13): equal-length channels of one array, as a channel table with array metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.operators.dsp import resample_traces


def to_nodal(traces: DataFrame) -> DataFrame:
    """Traces as nodal channels; unequal lengths raise when the rows are computed."""
    one = traces.agg(F.min(F.size("x")).alias("_a"), F.max(F.size("x")).alias("_z"))
    ok = F.when(F.col("_a") != F.col("_z"), F.raise_error(F.lit("nodal channels must have equal lengths")).cast("long")).otherwise(F.col("_a").cast("long"))
    return traces.join(F.broadcast(one.select(ok.alias("nx"))), F.lit(True))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Channels of two arrays side by side; b's numbers follow a's."""
    top = F.broadcast(a.agg(F.coalesce(F.max("ch"), F.lit(0)).alias("_top")))
    return a.unionByName(b.join(top, F.lit(True)).withColumn("ch", F.col("ch") + F.col("_top")).drop("_top"))


def merge_info(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared info maps of two arrays: b's values win."""
    e = a.select(F.lit(0).alias("o"), F.explode("info").alias("k", "v")).unionByName(b.select(F.lit(1).alias("o"), F.explode("info").alias("k", "v")))
    return e.groupBy("k").agg(F.max_by("v", "o").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("info"))


def info_dump(info: DataFrame) -> DataFrame:
    """Key and value of an info map, by key."""
    return info.select(F.explode("info").alias("key", "value")).orderBy("key")


def resample(traces: DataFrame, f0: float) -> DataFrame:
    """V9: every channel resampled."""
    return resample_traces(traces, f0)


def merge(*_: DataFrame) -> DataFrame:
    """Arrays can't be merged."""
    raise TypeError("nodal arrays can't be merged; append them")
