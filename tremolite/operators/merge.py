"""Merge of channels (U3, U5-U8): windows that overlap are resolved per merge group.

Samples on one grid go through ``process.merge_overlap`` (a pre-aggregated average).  Traces whose windows aren't
congruent are merged here as vectors: all samples of a group and day go to the nearest time of the group's
grid, overlaps average what isn't NaN, and contiguous samples become segments again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.timeaxis import delta_us

#: Time shard of merged samples; segments that cross a border are joined again afterwards.
SHARD_US = 3_600_000_000
#: Steps that a shard has at least, so that slow channels don't fall into many small shards.
SHARD_STEPS = 65_536


def merge_traces(traces: DataFrame, key: str = "id", shard_us: int = SHARD_US, shard_steps: int = SHARD_STEPS) -> DataFrame:
    """key, seg, t0_us, dt_us, fs, x of merged segments.

    traces: key, t0_us, fs, x (one row per contiguous segment), gain optional: values are brought to the gain of the
    trace that ends last.  Each group's grid starts at its first sample.  Rates of a group must agree; null or empty
    vectors are left out.  Segments are cut at shard borders of ``shard_us``.
    """
    has_gain = "gain" in traces.columns
    t = traces.where(delta_us("fs").isNotNull() & (F.size("x") > 0)).select(key, "t0_us", "fs", "x", (F.col("gain") if has_gain else F.lit(1.0)).alias("gain"))
    d = delta_us("fs")
    t = t.withColumn("dt_us", d).withColumn("_end", F.col("t0_us") + (F.size("x") - 1) * d)
    g = t.groupBy(key).agg(F.min("t0_us").alias("_base"), F.max_by("gain", "_end").alias("_gain"), F.min("dt_us").alias("_d"), F.max("dt_us").alias("_d2"))
    g = g.withColumn("_d", F.when(F.col("_d") == F.col("_d2"), F.col("_d")).otherwise(F.raise_error(F.lit("rates of a merge group differ")).cast("long"))).drop("_d2")
    t = t.join(g, key)
    # grid places of a trace's samples, cut into shards of whole steps
    k0 = F.rint((F.col("t0_us") - F.col("_base")) / F.col("_d")).cast("long")
    per = F.greatest(F.lit(shard_steps), F.floor(F.lit(shard_us) / F.col("_d"))).cast("long")
    t = t.withColumn("_k0", k0).withColumn("_per", per)
    t = t.withColumn("_sh", F.explode(F.sequence(F.floor(F.col("_k0") / F.col("_per")), F.floor((F.col("_k0") + F.size("x") - 1) / F.col("_per")))))
    lo = F.greatest(F.lit(0).cast("long"), F.col("_sh") * F.col("_per") - F.col("_k0"))
    n = F.least(F.size("x").cast("long"), (F.col("_sh") + 1) * F.col("_per") - F.col("_k0")) - lo
    t = t.select(key, "_sh", "_base", "_d", "fs", (F.col("_k0") + lo).alias("_k"), (F.col("_gain") / F.col("gain")).alias("_f"), F.slice("x", (lo + 1).cast("int"), n.cast("int")).alias("x"))

    def one(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo = int(g["_k"].min())
        hi = max(int(k) + len(x) for k, x in zip(g["_k"], g["x"]))
        s, c, seen = np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, bool)
        for k, f, x in zip(g["_k"], g["_f"], g["x"]):
            v = np.asarray(x, float) * f
            at = slice(int(k) - lo, int(k) - lo + len(v))
            ok = ~np.isnan(v)
            s[at] += np.where(ok, v, 0)
            c[at] += ok
            seen[at] = True
        y = np.divide(s, c, out=np.full(len(s), np.nan), where=c > 0)
        edge = np.flatnonzero(np.diff(np.r_[0, seen.astype(int), 0]))
        d, base = int(g["_d"].iloc[0]), int(g["_base"].iloc[0])
        return pd.DataFrame({key: keys[0], "t0_us": [base + (lo + int(a)) * d for a in edge[::2]], "dt_us": d, "fs": float(g["fs"].iloc[0]), "x": [y[a:z] for a, z in zip(edge[::2], edge[1::2])]})

    kind = traces.schema[key].dataType.simpleString()
    return t.groupBy(key, "_sh").applyInPandas(one, f"`{key}` {kind}, t0_us bigint, dt_us bigint, fs double, x array<double>")


def segments(merged: DataFrame, key: str = "id") -> DataFrame:
    """key, seg, start_us, end_us, n: contiguous segments of merged pieces, shard borders joined."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("t0_us")
    end = F.col("t0_us") + (F.size("x") - 1) * F.col("dt_us")
    m = merged.select(key, "t0_us", "dt_us", F.size("x").alias("_n"), end.alias("_e"))
    new = F.coalesce((F.col("t0_us") - F.lag("_e").over(w) != F.col("dt_us")).cast("long"), F.lit(0).cast("long"))
    m = m.withColumn("_new", new).withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(key, "seg").agg(F.min("t0_us").alias("start_us"), F.max("_e").alias("end_us"), F.sum("_n").cast("long").alias("n"))


def merge_many(*tables: DataFrame, key: str = "id") -> DataFrame:
    """Several traces tables merged into one."""
    from functools import reduce

    return merge_traces(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), key)


def merge_matching(c: DataFrame, c_traces: DataFrame, d: DataFrame, d_traces: DataFrame, keys: tuple[str, ...] = ("fs", "gain", "units")) -> DataFrame:
    """Traces of channels d merged into those of channels c of the same id whose rate, gain and units agree, unset matching anything.

    c, d: header tables (ch, id and keys); traces: ch, t0_us, fs, x.  Traces of c all stay; those of d only where their header agrees with one
    of c.  Output as ``merge_traces``, by id.
    """
    from tremolite.operators.select import header_classes, match_unset

    hit = match_unset(c, d, keys).select(F.col("ch_b").alias("grp")).distinct()
    into = header_classes(d, keys).join(hit, "grp", "left_semi").select("ch")
    one = c_traces.join(c.select("ch", "id"), "ch").select("id", "t0_us", "fs", "x")
    two = d_traces.join(into, "ch", "left_semi").join(d.select("ch", "id"), "ch").select("id", "t0_us", "fs", "x")
    return merge_many(one, two)


def align_traces(traces: DataFrame, key: str = "id", most: int = 4, least: int = 8, rtol: float = 1e-5, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Traces whose samples repeat those of an overlapping trace, but up to ``most`` samples early or late, moved to where the data agree.

    traces: key, t0_us, fs, x (other columns are kept).  Each trace is compared with the one of its key that overlaps
    it and starts last before it; at least ``least`` samples must agree.  Where the data agree without a shift, or with none, the
    times stay.  Shifts aren't passed on from trace to trace.  Overlaps are found by an equi-join on key and time bucket.
    """
    from tremolite.operators.select import interval_join

    t = traces.where(delta_us("fs").isNotNull() & (F.size("x") > 0)).withColumn("_d", delta_us("fs"))
    t = t.withColumn("_s", F.col("t0_us")).withColumn("_e", F.col("t0_us") + (F.size("x") - 1) * F.col("_d")).withColumn("_tid", F.xxhash64(key, "t0_us", "fs", "x"))
    a = t.select(F.col(key).alias("_k"), "_tid", F.col("_s").alias("_as"), F.col("_d").alias("_ad"), (F.col("_s") - most * F.col("_d")).alias("_a0"), (F.col("_e") + most * F.col("_d")).alias("_a1")).distinct()
    b = t.select(F.col(key).alias("_k"), F.col("_tid").alias("_ptid"), F.col("_s").alias("_ps"), F.col("_e").alias("_pe"), F.col("_d").alias("_pd")).distinct()
    j = interval_join(a, b, "_k", ("_a0", "_a1"), ("_ps", "_pe"), bucket_us)
    first = (F.col("_ps") < F.col("_as")) | ((F.col("_ps") == F.col("_as")) & (F.col("_ptid") < F.col("_tid")))
    pred = j.where(first & (F.col("_ad") == F.col("_pd"))).groupBy("_tid").agg(F.max(F.struct("_ps", "_ptid")).alias("_p")).select("_tid", "_p._ps", "_p._ptid")
    px = t.select(F.col("_tid").alias("_ptid"), F.col("x").alias("_px")).groupBy("_ptid").agg(F.first("_px").alias("_px"))

    @F.pandas_udf("long")
    def shift(x: pd.Series, p: pd.Series, off: pd.Series) -> pd.Series:
        out = []
        for v, w, o in zip(x, p, off):
            found = 0
            if w is not None:
                v, w = np.asarray(v, float), np.asarray(w, float)
                for s in sorted(range(-most, most + 1), key=abs):
                    lo = max(0, int(o) + s)
                    skip = lo - (int(o) + s)
                    m = min(len(w) - lo, len(v) - skip)
                    if m >= least and np.allclose(w[lo : lo + m], v[skip : skip + m], rtol=rtol, atol=0, equal_nan=True):
                        found = s
                        break
            out.append(found)
        return pd.Series(out, dtype="int64")

    cols = [c for c in traces.columns if c != "t0_us"]
    m = t.join(pred, "_tid", "left").join(px, "_ptid", "left")
    off = F.coalesce(F.rint((F.col("_s") - F.col("_ps")) / F.col("_d")), F.lit(0)).cast("long")
    moved = F.col("_s") + shift("x", "_px", off) * F.col("_d")
    return m.select(*cols, moved.alias("t0_us")).select(*traces.columns)
