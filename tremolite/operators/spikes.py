"""Problem 1: spikes, stuck values and physically impossible readings.

Robust exponentially weighted control charts per source.  In each run, in time order: physical limits take
impossible values out; run-length counters take stuck values out; the chart follows the
deviation of each remaining reading from the course of its neighbours, and clips suspected
values before it updates its mean and scale.  A channel's usual scatter is the median of its
charts' scales; suspects are then held against it.

A run of any length is cut into shards of SHARD readings by exact rank, each with the readings next to it
as a halo, so no task holds a run and results don't depend on the cutting but for the charts' warm-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolite.operators.unitgraph import unit_key
from tremolite.session import cut
from tremolite.timeaxis import delta_us

SHARD, HALO = 4096, 160
#: Weight of the newest reading in the chart; clipping limit in scales.
LAMBDA, CLIP = 0.01, 3.0
#: Mean square of a normal deviation clipped at CLIP.
CLIPPED = 0.9850
#: A spike deviates by more than LIMIT usual scatters, by CALM times its neighbours' own deviation, and is at most two readings.
LIMIT, CALM = 8.0, 3.0
#: Readings in succession that are stuck, and the part of the usual scatter they may vary by.
STUCK, STUCK_PART = 10, 1e-3
#: Groups that are charted in lockstep.
GROUPS = 96
#: Values that stand for none, whatever the unit.
FILLS = (9.96920996838687e36, 9.96921e36, 3.4028234663852886e38, 3.4e38, 1e20, 1e30, 1e35)
#: What instruments of a unit can give at most: 24-bit digitizers, absolute pressure and temperature, ...
LIMITS = {"counts": (-8388608.0, 8388607.0), "k": (50.0, 500.0), "%": (0.0, 100.0), "pa": (100.0, 1e6), "v": (-1000.0, 1000.0), "m/s": (-50.0, 50.0), "m/s2": (-1000.0, 1000.0), "m": (-1000.0, 1000.0), "rad": (-10.0, 10.0)}
#: Fixed value: the unset value of headers; a possible count.
UNSET = -12345.0


def impossible(x: Column, unit: Column) -> Column:
    """Whether a value is impossible for its unit (a key of LIMITS) or for any measurement."""
    c = (F.abs(x) >= 1e18) | x.isin(*FILLS)
    key = F.regexp_replace(unit_key(unit), r"^\{?counts?\}?$", "counts")
    for u, (lo, hi) in LIMITS.items():
        c = c | ((key == u) & ((x < lo) | (x > hi)))
    return c | ((x == UNSET) & (F.coalesce(key, F.lit("")) != "counts"))


def last_digit(x: np.ndarray) -> float:
    """The decimal step (1 to 1e-4) that all values are multiples of; 0 if there is none."""
    x = x[np.isfinite(x) & (np.abs(x) < 1e9)]
    if not len(x) or np.abs(x).max() < 1e-3:
        return 0.0
    for q in (1.0, 0.1, 0.01, 0.001, 0.0001):
        y = x / q
        if (np.abs(y - np.rint(y)) < 1e-4).all():
            return q
    return 0.0


def stuck_range(x: np.ndarray, n: int = STUCK) -> np.ndarray:
    """For each reading the least range of n readings in succession that include it; infinite where there are fewer."""
    out = np.full(len(x), np.inf)
    if len(x) < n:
        return out
    v = np.lib.stride_tricks.sliding_window_view(x, n)
    r = v.max(1) - v.min(1)
    p = np.r_[np.full(n - 1, np.inf), r, np.full(n - 1, np.inf)]
    return np.lib.stride_tricks.sliding_window_view(p, n).min(1)


def course(x: np.ndarray, own: int) -> tuple[np.ndarray, ...]:
    """For groups of ``own`` readings from each place on: the course (median) of the three readings on either side,
    the median of their deviations from it, the larger deviation of the two next to the group, and the medians of either side."""
    n = len(x)
    m = n - own + 1
    if m < 1:
        return (np.zeros(0),) * 5
    p = np.r_[np.full(3, np.nan), x, np.full(3, np.nan)]
    at = np.arange(m)
    nb = np.stack([p[at + k] for k in (0, 1, 2)] + [p[at + 3 + own + k] for k in (0, 1, 2)])
    with np.errstate(all="ignore"):
        mid = _nanmedian(nb)
        dev = np.abs(nb - mid)
        calm = _nanmedian(dev)
        near = np.fmax(dev[2], dev[3])
        left, right = _nanmedian(nb[:3]), _nanmedian(nb[3:])
    return mid, np.nan_to_num(calm), np.nan_to_num(near), left, right


def beyond(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far readings are beyond both sides' courses; 0 between them (a step), one side's where there is only one."""
    a, b = x - left, x - right
    d = np.where(np.isnan(a), np.abs(b), np.where(np.isnan(b), np.abs(a), np.where(a * b > 0, np.fmin(np.abs(a), np.abs(b)), 0.0)))
    return np.nan_to_num(d)


def _nanmedian(a: np.ndarray) -> np.ndarray:
    """Median along the first axis without NaNs (fast for a few rows)."""
    s = np.sort(a, axis=0)
    n = (~np.isnan(a)).sum(0)
    i, k = np.maximum((n - 1) // 2, 0), np.arange(a.shape[1])
    return np.where(n > 0, (s[i, k] + s[np.minimum(n // 2, a.shape[0] - 1), k]) / 2, np.nan)


def charts(rs: list[np.ndarray], lam: float = LAMBDA, clip: float = CLIP) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, scale) before each deviation, for many series in lockstep; suspects are clipped before the update."""
    if not rs:
        return []
    n = np.array([len(r) for r in rs])
    order = np.argsort(-n)
    most = int(n.max())
    a = np.zeros((most, len(rs)))
    s0 = np.zeros(len(rs))
    for c, k in enumerate(order):
        a[: n[k], c] = rs[k]
        s0[c] = 1.4826 * np.median(np.abs(rs[k])) if n[k] else 0.0
    # a chart starts from its series' robust scale
    v, m = s0**2, np.zeros(len(rs))
    mean, scale = np.zeros_like(a), np.zeros_like(a)
    live = np.searchsorted(-n[order], -np.arange(most), "left")
    for t in range(most):
        w = live[t]
        s = np.sqrt(v[:w])
        mean[t, :w], scale[t, :w] = m[:w], s
        e = np.clip(a[t, :w] - m[:w], -clip * s, clip * s)
        m[:w] += lam * e
        v[:w] += lam * (e * e / CLIPPED - v[:w])
    out: list = [None] * len(rs)
    for c, k in enumerate(order):
        out[k] = (mean[: n[k], c], scale[: n[k], c])
    return out


def ranked(readings: DataFrame, runs: DataFrame, shard: int) -> DataFrame:
    """id, run_id, t, x, bad, k (place in its run by time); rows sent twice are one.

    Places are found without sorting a run in one task: readings are numbered in time buckets of about
    ``shard`` readings each, and the buckets' counts are added up.
    """
    x = readings.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("t").isNotNull() & F.col("id").isNotNull()).select("id", "run_id", "t", "x")
    span = x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    u = runs.groupBy("run_id").agg(F.first("units", ignorenulls=True).alias("units"), F.max("fs").alias("fs"))
    # a bucket of a regular run spans ``shard`` steps, so bursts after long holes can't fill one; an irregular run's
    # buckets are a sixteenth of what its mean density would take
    even = F.ceil((F.col("hi") - F.col("lo") + 1) / F.greatest(F.lit(1), F.ceil(F.col("n") * 16 / shard)))
    step = F.greatest(F.lit(1).cast("long"), F.coalesce(delta_us("fs") * shard, even))
    info = span.join(u, "run_id", "left").select("run_id", "lo", step.alias("step"), "units")
    none = F.coalesce("run_id", F.lit(-1).cast("long"))
    x = x.withColumn("run_id", none).join(info.withColumn("run_id", none), "run_id")
    x = x.select("id", "run_id", "t", "x", F.expr("(t - lo) div step").alias("b"), impossible(F.col("x"), F.col("units")).alias("bad"))
    w = Window.partitionBy("run_id", "b").orderBy("t", "x")
    x = x.withColumn("_dup", F.coalesce((F.lag("t").over(w) == F.col("t")) & (F.lag("x").over(w) == F.col("x")), F.lit(False))).where(~F.col("_dup"))
    x = x.withColumn("_r", F.row_number().over(w))
    before = Window.partitionBy("run_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = x.groupBy("run_id", "b").agg(F.max("_r").alias("_c")).select("run_id", "b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return x.join(off, ["run_id", "b"]).select("id", "run_id", "t", "x", F.coalesce("bad", F.lit(False)).alias("bad"), (F.col("_o") + F.col("_r") - 1).cast("long").alias("k"))


def suspects(readings: DataFrame, runs: DataFrame, shard: int = SHARD, halo: int = HALO) -> DataFrame:
    """Suspect readings and the scales of charts: kind, id, t, dev, calm, stuck, digit.

    kind 'scale': dev is a shard's median scale; 'bad': impossible; 'stuck': least range of STUCK readings and last digit;
    'spike': deviation from the course, deviation of the neighbours.
    """
    r = ranked(readings, runs, shard)
    n = F.lit(shard)
    near = F.array_distinct(F.array(F.floor(F.col("k") / n), F.floor((F.col("k") - halo) / n), F.floor((F.col("k") + halo) / n)))
    x = r.select("id", "run_id", "t", "x", "bad", "k", F.explode(near).alias("sh")).where("sh >= 0")
    x = x.repartition("run_id", "sh").sortWithinPartitions("run_id", "sh", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held = None, []
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            u, h = b["run_id"].to_numpy(), b["sh"].to_numpy()
            at = np.r_[0, np.flatnonzero((u[1:] != u[:-1]) | (h[1:] != h[:-1])) + 1]
            held += [b.iloc[a:z] for a, z in zip(at[:-1], at[1:])]
            rest = b.iloc[at[-1] :]
            while len(held) >= GROUPS:
                yield charted(held[:GROUPS])
                held = held[GROUPS:]
        if rest is not None and len(rest):
            held.append(rest)
        if held:
            yield charted(held)

    def charted(groups: list[pd.DataFrame]) -> pd.DataFrame:
        series = [_Series(g, shard) for g in groups]
        for s, (m, v) in zip(series, charts([s.r for s in series])):
            s.chart(m, v)
        return pd.concat([s.out() for s in series], ignore_index=True)

    return x.mapInPandas(run, "kind string, id string, t bigint, dev double, calm double, stuck double, digit double")


class _Series:
    """One shard of a run: what is taken out, the deviations that are charted, the suspects."""

    def __init__(self, g: pd.DataFrame, shard: int):
        self.id, self.t, self.x = g["id"].to_numpy(), g["t"].to_numpy(), g["x"].to_numpy(np.float64)
        self.own = (g["k"].to_numpy() // shard) == g["sh"].to_numpy()
        self.bad = g["bad"].to_numpy(bool)
        ok = np.flatnonzero(~self.bad)
        self.digit = last_digit(self.x[ok])
        # run-length counters run over all readings, rails and fill values included
        self.stuck = stuck_range(np.clip(self.x, -1e18, 1e18))
        diff = np.abs(np.diff(self.x[ok]))
        rough = np.median(diff[diff > 0]) if (diff > 0).any() else 0.0
        self.maybe = self.stuck <= max(rough * 0.02, self.digit * 1.001)
        firm = self.stuck <= max(rough * STUCK_PART, self.digit * 1.001)
        self.k = ok[~firm[ok]]
        self.one, self.two = course(self.x[self.k], 1), course(self.x[self.k], 2)
        self.r = np.nan_to_num(self.x[self.k] - self.one[0]) if len(self.k) else np.zeros(0)

    def chart(self, mean: np.ndarray, scale: np.ndarray) -> None:
        x, n = self.x[self.k], len(self.k)
        self.scale = float(np.median(scale)) if n else np.nan
        self.dev, self.calm = np.zeros(n), np.zeros(n)
        if not n:
            return
        # the usual scatter of the channel isn't known yet: a shard's own, which may be noisier, is no limit here
        mid, calm, near, left, right = self.one
        d = np.fmin(np.nan_to_num(np.abs(x - mid - mean)), beyond(x, left, right))
        hit = (d > 0) & (near < 0.5 * d) & (d > CALM * calm)
        self.dev[hit], self.calm[hit] = d[hit], calm[hit]
        mid, calm, near, left, right = self.two
        if not len(mid):
            return
        # both of two in succession, on one side of the course or on either
        ds = [np.fmin(np.nan_to_num(np.abs(y - mid - mean[:-1])), beyond(y, left, right)) for y in (x[:-1], x[1:])]
        d = np.fmin(*ds)
        hit = np.flatnonzero((d > 0) & (near < 0.5 * d) & (d > CALM * calm))
        for o, y in enumerate(ds):
            y = np.fmin(y, 2 * d)  # the lesser of the two must reach half the limit
            more = hit[y[hit] > self.dev[hit + o]]
            self.dev[more + o], self.calm[more + o] = y[more], calm[more]

    def out(self) -> pd.DataFrame:
        def rows(kind: str, at: np.ndarray, **c) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "id": self.id[at], "t": self.t[at]} | {n: c.get(n, np.nan) for n in ("dev", "calm", "stuck", "digit")}, index=range(len(at)))

        own = self.own
        first = np.flatnonzero(own)[:1]
        bad, stuck = np.flatnonzero(self.bad & own), np.flatnonzero(self.maybe & own)
        s = np.flatnonzero(self.dev > 0)
        s = s[own[self.k[s]]]
        parts = [rows("bad", bad), rows("stuck", stuck, stuck=self.stuck[stuck], digit=self.digit), rows("spike", self.k[s], dev=self.dev[s], calm=self.calm[s])]
        if len(first) and np.isfinite(self.scale):
            parts.append(rows("scale", first, dev=self.scale))
        return pd.concat(parts, ignore_index=True)


def flagged(readings: DataFrame, runs: DataFrame, shard: int = SHARD, halo: int = HALO) -> DataFrame:
    """id, t_us, reason ('impossible', 'stuck' or 'spike'): one row per reading that isn't plausible.

    Null and NaN readings, and readings without time or id, are never flagged.  Readings of unknown runs form
    sequences of their own run_id; those with a null run_id one of their own; without a unit only limits that hold for
    any measurement apply.  Repeated rows count once.  Where several reasons hold, the first of the three is given.
    """
    s = cut(suspects(readings, runs, shard, halo))  # a small table, used twice
    usual = s.where("kind = 'scale'").groupBy("id").agg(F.percentile_approx("dev", 0.5, 10000).alias("usual"))
    j = s.where("kind <> 'scale'").join(usual, "id", "left")
    u = F.coalesce("usual", F.lit(0.0))
    spike = (F.col("kind") == "spike") & (F.col("dev") > LIMIT * u) & (F.col("dev") > 0)
    stuck = (F.col("kind") == "stuck") & (F.col("stuck") <= F.greatest(STUCK_PART * u, F.col("digit") * 1.001))
    order = F.when(F.col("kind") == "bad", 0).when(stuck, 1).when(spike, 2)
    hit = j.withColumn("_o", order).where(F.col("_o").isNotNull()).groupBy("id", F.col("t").alias("t_us")).agg(F.min("_o").alias("_o"))
    return hit.select("id", "t_us", F.element_at(F.array(*[F.lit(k) for k in ("impossible", "stuck", "spike")]), F.col("_o") + 1).alias("reason"))
