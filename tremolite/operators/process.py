"""Sample-wise processing as built-in expressions: V1-V5, V10-V13, N2-N5, A1-A3.

Samples are rows (keys..., t_us, x) with x NaN where a sample is missing.  Operators keep their
keys; channel statistics are pre-aggregated before the join back, so a channel of any length is never sorted
where only its mean is needed, and where order matters channels are cut into time shards (``timeaxis.carried``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolite import timeaxis
from tremolite.timeaxis import SHARD_STEPS, segments_of_samples


def valid(x: Column | str = "x") -> Column:
    """x, null where it is NaN."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def _with(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Channel aggregates joined to each sample (null-safe keys are the caller's business)."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def demean(df: DataFrame, keys: list[str], fs: str | None = None, irr: bool = False) -> DataFrame:
    """V1: subtract the channel's mean; NaNs are ignored and stay.

    fs: a column of rates: channels whose rate isn't above 0 stay as they are, unless ``irr``.
    """
    mu = F.coalesce("_mu", F.lit(0.0))
    if fs is not None and not irr:
        mu = F.when(F.col(fs) > 0, mu).otherwise(0.0)
    return _with(df, keys, _mu=F.avg(valid())).withColumn("x", F.col("x") - mu).drop("_mu")


def nanfill(df: DataFrame, keys: list[str]) -> DataFrame:
    """V3: NaN to the mean of the channel's values; an all-NaN channel to 0."""
    return _with(df, keys, _mu=F.avg(valid())).withColumn("x", F.coalesce(valid(), "_mu", F.lit(0.0))).drop("_mu")


def detrend(df: DataFrame, keys: list[str], t: str = "t_us") -> DataFrame:
    """V2 (n = 1): subtract the least-squares line over the whole channel; NaNs are ignored and stay.

    One aggregate of slope and means, and one join.  The regression runs around its means, so large times cost no digits.
    """
    s = F.col(t) / 1e6
    ok = F.when(~F.isnan("x"), s)
    one = df.groupBy(*keys).agg(
        F.regr_slope(valid(), ok).alias("_b"), F.regr_avgx(valid(), ok).alias("_ms"), F.avg(valid()).alias("_mu")
    )
    line = F.coalesce(F.col("_mu") + F.col("_b") * (s - F.col("_ms")), "_mu", F.lit(0.0))
    return df.join(one, keys).withColumn("x", F.col("x") - line).drop("_b", "_ms", "_mu")


def ungap(df: DataFrame, keys: list[str], step: int, mean: bool = True, t: str = "t_us", chunk: int = 4096, tap: bool = False) -> DataFrame:
    """V4: every grid time between a channel's first and last sample; gaps hold the mean (NaNs ignored) or NaN.

    Samples off the grid go to the grid time before them, measured from the first sample; two samples at one grid time
    are averaged.  The grid is made in chunks, so a long channel is spread over tasks.  ``tap`` tapers every segment first.
    """
    if tap:
        df = taper(segments_of_samples(df, keys, t, step), keys, 1e6 / step, order=t).select(*keys, t, "x")
    b = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.avg(valid()).alias("_mu"))
    d = F.lit(step)
    n = F.expr(f"(_t1 - _t0) div {step}")
    parts = b.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"((_t1 - _t0) div {step}) div {chunk}"))))
    lo = F.col("_c") * chunk
    grid = parts.select(*keys, "_t0", "_mu", F.explode(F.sequence(lo, F.least(n, lo + chunk - 1))).alias("_k"))
    have = df.join(b.select(*keys, "_t0"), keys).withColumn("_k", F.expr(f"({t} - _t0) div {step}")).groupBy(*keys, "_k").agg(F.avg(valid()).alias("_x"), F.count(F.lit(1)).alias("_n"))
    fill = F.coalesce("_mu", F.lit(0.0)) if mean else F.lit(float("nan"))
    x = F.when(F.col("_n").isNull(), fill).otherwise(F.coalesce("_x", F.lit(float("nan"))))
    return grid.join(have, [*keys, "_k"], "left").select(*keys, (F.col("_t0") + F.col("_k") * d).alias(t), x.alias("x"), F.col("_n").isNull().alias("filled"))


def taper(df: DataFrame, keys: list[str], fs: float | Column, t_max: float = 10.0, alpha: float = 0.05, n_min: int = 10, order: str = "t_us", seg: str = "seg") -> DataFrame:
    """V5: cosine taper of both ends of every segment around the channel's mean; short segments stay as they are.

    The edge has min(round(t_max * fs), round(min(alpha, 0.5) * n)) samples; segments of fewer than n_min are not tapered.
    """
    fs = F.lit(float(fs)) if not isinstance(fs, Column) else fs
    d = _with(df, keys, _mu=F.avg(valid()))
    d = _with(d, [*keys, seg], _n=F.count(F.lit(1)), _w=shard_width(order))
    d = timeaxis.running(d, [*keys, seg], order, F.col("_w"), F.lit(1), "_i")
    d = d.withColumn("_l", F.least(F.rint(F.lit(t_max) * fs), F.rint(F.lit(min(alpha, 0.5)) * F.col("_n"))))
    k = F.least(F.col("_i"), F.col("_n") - F.col("_i") + 1)
    wt = F.when((F.col("_n") >= n_min) & (k <= F.col("_l")), 0.5 * (1 - F.cos(math.pi * (k - 1) / F.col("_l")))).otherwise(1.0)
    return d.withColumn("x", (F.col("x") - F.col("_mu")) * wt + F.col("_mu")).drop("_mu", "_n", "_w", "_i", "_l")


def shard_width(order: str) -> Column:
    """Width of shards that hold SHARD_STEPS rows each if rows are evenly spread over a group: an aggregate."""
    return F.greatest(F.lit(1), F.ceil((F.max(order) - F.min(order) + 1) * SHARD_STEPS / F.count(F.lit(1)))).cast("long")


def differentiate(df: DataFrame, keys: list[str], fs: float | Column, order: str = "t_us", seg: str = "seg") -> DataFrame:
    """First difference within a segment times fs; the first sample is kept (times fs)."""
    fs = F.lit(float(fs)) if not isinstance(fs, Column) else fs
    d = timeaxis.previous(_with(df, [*keys, seg], _w=shard_width(order)), [*keys, seg], order, F.col("_w"), "x", "_p")
    return d.withColumn("x", F.coalesce(F.col("x") - F.col("_p"), F.col("x")) * fs).select(*df.columns)


def integrate(df: DataFrame, keys: list[str], fs: float | Column, order: str = "t_us", seg: str = "seg") -> DataFrame:
    """Running sum within a segment over fs; the inverse of ``differentiate``."""
    fs = F.lit(float(fs)) if not isinstance(fs, Column) else fs
    d = timeaxis.running(_with(df, [*keys, seg], _w=shard_width(order)), [*keys, seg], order, F.col("_w"), F.col("x"), "_s")
    return d.withColumn("x", F.col("_s") / fs).select(*df.columns)


#: Powers of seconds that seismic units differ by.
ORDER = {"m": 0, "m/s": 1, "m/s2": 2}


def convert_seismic(df: DataFrame, keys: list[str], units_in: str, units_out: str, fs: float, order: str = "t_us", seg: str = "seg") -> DataFrame:
    """M, m/s and m/s2 into each other; differences are centred, so times move by half a step per order."""
    if units_in not in ORDER or units_out not in ORDER:
        raise ValueError(f"seismic units are {', '.join(ORDER)}")
    n = ORDER[units_out] - ORDER[units_in]
    half = round(1e6 / fs) // 2
    for _ in range(abs(n)):
        df = differentiate(df, keys, fs, order, seg) if n > 0 else integrate(df, keys, fs, order, seg)
        df = df.withColumn(order, F.col(order) + F.lit(-half if n > 0 else half))
    return df


def unscale(df: DataFrame, gain: str = "gain") -> DataFrame:
    """X over gain, gain 1."""
    return df.withColumn("x", F.col("x") / F.col(gain)).withColumn(gain, F.lit(1.0))


def rescale(df: DataFrame, g: float | Column, gain: str = "gain") -> DataFrame:
    """X and gain to the gain g."""
    g = F.lit(float(g)) if not isinstance(g, Column) else g
    return df.withColumn("x", F.col("x") * g / F.col(gain)).withColumn(gain, g)


def rescale_from(target: DataFrame, source: DataFrame, key: str = "id", order: str = "ch") -> DataFrame:
    """Gains of the first channel of the same id in source; others stay as they are."""
    s = source.groupBy(key).agg(F.min_by("gain", order).alias("_g"))
    j = target.join(s, key, "left")
    return rescale(j, F.coalesce("_g", "gain")).drop("_g")


def sync(df: DataFrame, keys: list[str], step: int, start: str | int = "last", end: str | int = "none", pad: bool = False, t: str = "t_us", chunk: int = 4096) -> DataFrame:
    """A common window. start/end: 'first', 'last' (of the channels' starts or ends), microseconds, or 'none' for end.

    Samples outside are cut; with pad, channels that begin late or end early are filled up with their
    own mean at their own sample times.  Gaps inside stay.  Channels without samples in the window vanish.  start
    'none' keeps all starts.  An empty window gives no rows.
    """
    b = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_z"), F.avg(valid()).alias("_mu"))
    pick = {"first": F.min, "last": F.max}
    lim = b.agg(
        (pick[start]("_a") if start in pick else F.lit(None if start == "none" else start).cast("long")).alias("_t0"),
        (pick[end]("_z") if end in pick else F.lit(None if end == "none" else end).cast("long")).alias("_t1"),
    )
    one = F.broadcast(lim)  # a single row
    inside = (F.col("_t0").isNull() | (F.col(t) >= F.col("_t0"))) & (F.col("_t1").isNull() | (F.col(t) <= F.col("_t1")))
    cut = df.join(one, F.lit(True)).where(inside).select(*df.columns)
    if not pad:
        return cut
    live = b.join(one, F.lit(True)).where((F.col("_t0").isNull() | (F.col("_z") >= F.col("_t0"))) & (F.col("_t1").isNull() | (F.col("_a") <= F.col("_t1"))))
    # pads are made in chunks: (from, steps, sign)
    pre = F.struct(F.col("_a").alias("at"), F.expr(f"(_a - _t0) div {step}").alias("n"), F.lit(-step).cast("long").alias("by"))
    post = F.struct(F.col("_z").alias("at"), F.expr(f"(_t1 - _z) div {step}").alias("n"), F.lit(step).cast("long").alias("by"))
    ends = live.select(*keys, F.coalesce("_mu", F.lit(0.0)).alias("x"), F.explode(F.array(pre, post)).alias("_p")).where("_p.n > 0")
    parts = ends.select(*keys, "x", "_p", F.explode(F.expr(f"sequence(0L, (_p.n - 1) div {chunk})")).alias("_c"))
    lo = F.col("_c") * chunk
    k = F.sequence(lo + 1, F.least(F.col("_p.n"), lo + chunk))
    fill = parts.select(*keys, F.explode(F.transform(k, lambda v: F.col("_p.at") + v * F.col("_p.by"))).alias(t), "x")
    return cut.select(*keys, t, "x").unionByName(fill)


def merge_near(df: DataFrame, keys: list[str], step: int, t: str = "t_us") -> DataFrame:
    """Runs of samples less than half a step apart become one: keys, t (the first time), x (mean of values that aren't NaN), n (samples)."""
    near = F.lit((step + 1) // 2 - 1).cast("long")
    d = timeaxis.islands(df, keys, t, step * SHARD_STEPS, F.lit(-1).cast("long"), near, "_g")
    return d.groupBy(*keys, "_g").agg(F.min(t).alias(t), F.coalesce(F.avg(valid()), F.lit(float("nan"))).alias("x"), F.count(F.lit(1)).alias("n")).drop("_g")


def merge_overlap(a: DataFrame, b: DataFrame, keys: list[str], t: str = "t_us") -> DataFrame:
    """U5, samples on one grid: union of samples; where both have one, the mean of the values that aren't NaN."""
    u = a.select(*keys, t, "x").unionByName(b.select(*keys, t, "x"))
    return u.groupBy(*keys, t).agg(F.coalesce(F.avg(valid()), F.lit(float("nan"))).alias("x"))


def merge_irregular(a: DataFrame, b: DataFrame, keys: list[str], t: str = "t_us") -> DataFrame:
    """Set union of (time, value) pairs."""
    return a.select(*keys, t, "x").unionByName(b.select(*keys, t, "x")).distinct()


def drop_repeats(df: DataFrame, keys: list[str], t: str = "t_us") -> DataFrame:
    """Equal samples at equal times once."""
    return df.dropDuplicates([*keys, t, "x"])


def summary(df: DataFrame, keys: list[str], step: int, t: str = "t_us") -> DataFrame:
    """Per contiguous segment: first and last time, samples, mean of values."""
    s = segments_of_samples(df, keys, t, step)
    return s.groupBy(*keys, "seg").agg(F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.count(F.lit(1)).alias("n"), F.avg(valid()).alias("mean_x"))
