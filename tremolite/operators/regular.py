"""Problem 5: irregular readings onto a regular grid.

Shape-preserving monotone cubic interpolation (Fritsch-Carlson slopes) per source segment.
A source is cut into time shards of a fixed number of grid slots; the readings next to a shard
border are sent to the neighbouring shard as well (the halo), so every shard computes exactly
what an unsharded run would.  Holes longer than ``max_gap`` slots stay marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.timeaxis import delta_us

#: Slots of one shard and the longest hole (in slots) that is filled; shard > halo.
SHARD_SLOTS = 8192
MAX_GAP = 10

OBSERVED, FILLED, MISSING = "observed", "filled", "missing"


def monotone_slopes(t: np.ndarray, y: np.ndarray, brk: np.ndarray) -> np.ndarray:
    """Slopes at the knots; brk[k]: no curve between knots k and k + 1.

    Inside a segment the weighted harmonic mean of the neighbouring secants, 0 where they
    differ in sign; at the ends of a segment the one-sided three-point slope, limited.
    """
    n = len(t)
    m = np.zeros(n)
    if n < 2:
        return m
    h = np.diff(t)
    s = np.diff(y) / h
    left = np.r_[False, ~brk]  # a secant to the left belongs to the segment
    right = np.r_[~brk, False]
    hl, hr, sl, sr = np.r_[0.0, h], np.r_[h, 0.0], np.r_[0.0, s], np.r_[s, 0.0]
    mid = left & right & (sl * sr > 0)
    w1, w2 = 2 * hr + hl, hr + 2 * hl
    with np.errstate(divide="ignore", invalid="ignore"):
        m[mid] = ((w1 + w2)[mid]) / (w1[mid] / sl[mid] + w2[mid] / sr[mid])
    for only, a, b in ((right & ~left, 0, 1), (left & ~right, -1, -2)):
        k = np.flatnonzero(only)
        if not len(k):
            continue
        near, far = (k, k + 1) if a == 0 else (k - 1, k - 2)
        ok = (far >= 0) & (far < n - 1)
        ok[ok] &= ~brk[far[ok]]
        v = s[near].copy()
        kk, ff = near[ok], far[ok]
        e = ((2 * h[kk] + h[ff]) * s[kk] - h[kk] * s[ff]) / (h[kk] + h[ff])
        e = np.where(e * s[kk] <= 0, 0.0, np.where((s[kk] * s[ff] <= 0) & (np.abs(e) > 3 * np.abs(s[kk])), 3 * s[kk], e))
        v[ok] = e
        m[k] = v
    return m


def hermite(t: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Cubic Hermite values at ``at`` between knots left and left + 1."""
    h = t[left + 1] - t[left]
    u = (at - t[left]) / h
    return y[left] * (1 + 2 * u) * (1 - u) ** 2 + m[left] * h * u * (1 - u) ** 2 + y[left + 1] * u * u * (3 - 2 * u) + m[left + 1] * h * u * u * (u - 1)


def fill_shard(lo: int, hi: int, d: int, k: np.ndarray, t: np.ndarray, x: np.ndarray, max_gap: int):
    """Slots lo..hi of one shard from knots (slot k, time t, value x) in time order, halo included."""
    slots = np.arange(lo, hi + 1)
    out = np.full(len(slots), np.nan)
    status = np.full(len(slots), MISSING, dtype=object)
    if len(t):
        brk = np.diff(k) > max_gap + 1
        tt = (t - slots[0] * d).astype(float)
        m = monotone_slopes(tt, x, brk)
        at = (slots - slots[0]).astype(float) * d
        left = np.searchsorted(tt, at, side="right") - 1
        inside = (left >= 0) & (left < len(t) - 1)
        inside[inside] &= ~brk[left[inside]]
        out[inside] = hermite(tt, x, m, at[inside], left[inside])
        status[inside] = FILLED
        seen = np.unique(k[(k >= lo) & (k <= hi)])
        status[seen - lo] = OBSERVED
        # a slot with a reading but no curve around it (end of a segment): the nearest reading
        bare = np.flatnonzero((status == OBSERVED) & ~inside)
        if len(bare):
            r = np.clip(np.searchsorted(tt, at[bare]), 0, len(tt) - 1)
            l = np.clip(r - 1, 0, len(tt) - 1)
            out[bare] = np.where(np.abs(tt[l] - at[bare]) <= np.abs(tt[r] - at[bare]), x[l], x[r])
    return slots, out, status


def slots_of(readings: DataFrame, runs: DataFrame) -> DataFrame:
    """Readings of regular runs with their grid slot: run_id, d, k, t, x (x null where it has no value)."""
    r = runs.select("run_id", delta_us("fs").alias("d")).where(F.col("d").isNotNull())
    x = readings.where(F.col("t").isNotNull()).select("run_id", "t", F.when(~F.isnan("x"), F.col("x")).alias("x"))
    j = x.join(r, "run_id")
    return j.select("run_id", "d", F.expr("(t + d div 2 - pmod(t + d div 2, d)) div d").alias("k"), "t", "x")


def regularise(readings: DataFrame, runs: DataFrame, max_gap: int = MAX_GAP, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """run_id, slot_us, x, status for every grid time between a run's first and last reading.

    status 'observed': a reading with a value belongs to the slot; 'filled': none, but the hole is
    at most max_gap slots long; 'missing': a longer hole (x is null).  Values at one time
    of a run are averaged.  Null and NaN values count as no reading; infinite values are kept out of
    the curve, but their slot is observed with a null x.  Runs with fs <= 0 or null, and readings
    of unknown runs, give no rows.
    """
    halo = 2 * max_gap + 4
    if shard_slots <= halo:
        raise ValueError("shard_slots must exceed the halo, 2 * max_gap + 4")
    s = slots_of(readings, runs)
    one = s.groupBy("run_id", "d", "k", "t").agg(F.avg("x").alias("x"))
    n = F.lit(shard_slots)
    # a marker row per (run, shard): holes longer than a shard still have their shards
    span = s.groupBy("run_id", "d").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    marks = span.select("run_id", "d", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / n), F.floor(F.col("hi") / n))).alias("sh"))
    marks = marks.select("run_id", "d", "sh", F.greatest("lo", F.col("sh") * n).alias("k"), F.least("hi", F.col("sh") * n + n - 1).alias("t"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("mark"))
    sh = F.floor(F.col("k") / n)
    near = F.array_distinct(F.array(sh, F.floor((F.col("k") - halo) / n), F.floor((F.col("k") + halo) / n)))
    data = one.where(F.col("x").isNotNull()).select("run_id", "d", F.explode(near).alias("sh"), "k", "t", "x", F.lit(False).alias("mark"))
    every = data.unionByName(marks).repartition("run_id", "sh").sortWithinPartitions("run_id", "sh", F.desc("mark"), "t")

    def group(run: int, g: dict[str, np.ndarray]) -> pd.DataFrame | None:
        if not g["mark"][0]:
            return None  # halo of a shard outside the run
        lo, hi, d = int(g["k"][0]), int(g["t"][0]), int(g["d"][0])
        k, t, x = g["k"][1:], g["t"][1:], g["x"][1:]
        fin = np.isfinite(x)
        slots, y, st = fill_shard(lo, hi, d, k[fin], t[fin], x[fin], max_gap)
        odd = k[~fin]
        odd = odd[(odd >= lo) & (odd <= hi)] - lo
        fresh = odd[st[odd] != OBSERVED]
        st[fresh], y[fresh] = OBSERVED, np.nan
        return pd.DataFrame({"run_id": run, "slot_us": slots * d, "x": y, "status": st})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            r, h = b["run_id"].to_numpy(), b["sh"].to_numpy()
            cut = np.flatnonzero((r[1:] != r[:-1]) | (h[1:] != h[:-1])) + 1
            done = cut[-1] if len(cut) else 0
            yield from emit(b, np.r_[0, cut])
            rest = b.iloc[done:]
        if rest is not None and len(rest):
            yield from emit(rest.reset_index(drop=True), np.r_[0, len(rest)])

    def emit(b: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
        c = {n: b[n].to_numpy() for n in ("d", "k", "t", "x", "mark")}
        r = b["run_id"].to_numpy()
        out = [o for a, z in zip(at[:-1], at[1:]) if (o := group(int(r[a]), {n: v[a:z] for n, v in c.items()})) is not None]
        if out:
            yield pd.concat(out, ignore_index=True)

    done = every.mapInPandas(run, "run_id bigint, slot_us bigint, x double, status string")
    return done.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
