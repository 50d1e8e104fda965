"""Selection and matching of channels (P1-P19, J1-J3, J5-J9, A8-A13, O1-O3, W10) on channel tables.

Channel tables have ``ch`` (position) and ``id``; ids needn't be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolite import timeaxis
from tremolite.functions.ids import inst_code, wildcard_to_regex
from tremolite.model import DAY, KW


def by_position(df: DataFrame, chans: list[int] | range) -> DataFrame:
    """Rows at positions."""
    return df.where(F.col("ch").isin(*chans))


def replace_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of rows with the same position."""
    return df.join(new.select("ch"), "ch", "left_anti").unionByName(new)


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows added at the end; positions continue."""
    top = F.broadcast(df.agg(F.coalesce(F.max("ch"), F.lit(0)).alias("_top")))
    return df.unionByName(more.join(top, F.lit(True)).withColumn("ch", F.col("ch") + F.col("_top")).drop("_top"))


def pull(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that fulfil a condition, the others; unknown counts as not)."""
    c = F.coalesce(cond, F.lit(False))
    return df.where(c), df.where(~c)


def delete(df: DataFrame, chans: list[int] | None = None, id: str | None = None, pattern: str | None = None) -> DataFrame:
    """Without the positions, the exact id, or ids that match a regular expression."""
    if chans is not None:
        df = df.where(~F.col("ch").isin(*chans))
    if id is not None:
        df = df.where(~F.col("id").eqNullSafe(id))
    if pattern is not None:
        df = df.where(~F.coalesce(F.col("id").rlike(pattern), F.lit(False)))
    return df


def find_ids(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted id with the first position that has it, 0 if none."""
    first = df.groupBy("id").agg(F.min("ch").alias("ch"))
    return wanted.select("id").join(first, "id", "left").select("id", F.coalesce("ch", F.lit(0).cast("long")).alias("ch"))


def present(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """P10: each wanted id with whether the table has it."""
    have = df.select("id").distinct().withColumn("_p", F.lit(True))
    return wanted.select("id").join(have, "id", "left").select("id", F.coalesce("_p", F.lit(False)).alias("present"))


def find_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose id contains a match."""
    return df.where(F.col("id").rlike(pattern))


def wildcard(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose id contains a match of ? and * wildcards."""
    return df.where(F.col("id").rlike(wildcard_to_regex(pattern)))


def prune(df: DataFrame, x: str = "nx", t: str = "t") -> DataFrame:
    """Without channels that have no samples or an empty time matrix."""
    return df.where((F.coalesce(F.col(x), F.lit(0)) > 0) & (F.coalesce(F.size(t), F.lit(0)) > 0))


def seismic(df: DataFrame, codes: tuple[str, ...] = KW.seismic) -> DataFrame:
    """Rows whose instrument code is seismic."""
    return df.where(inst_code("id").isin(*codes))


def usable(df: DataFrame, keep_empty: bool = False, keep_irregular: bool = True, chans: list[int] | None = None, x: str = "nx") -> DataFrame:
    """The channels an operator works on."""
    if chans:
        df = by_position(df, chans)
    if not keep_empty:
        df = df.where(F.coalesce(F.col(x), F.lit(0)) > 0)
    return df if keep_irregular else df.where(F.col("fs") > 0)


def between(df: DataFrame, start_us: int, end_us: int, t: str = "t_us") -> DataFrame:
    """Samples in a closed time range (pushed down to Parquet)."""
    return df.where(F.col(t).between(start_us, end_us))


def splat(*parts: DataFrame) -> DataFrame:
    """Tables of different kinds in one; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sorted_by_id(df: DataFrame, reverse: bool = False) -> DataFrame:
    """O1: by id, then position."""
    return df.orderBy(F.desc("id") if reverse else F.asc("id"), "ch")


MATCH = ("id", "fs", "gain", "loc", "resp", "units")


def channel_match(a: DataFrame, b: DataFrame, use_gain: bool = True, keys: tuple[str, ...] = MATCH) -> DataFrame:
    """Side ('a' or 'b'), ch, grp, links: the channels of two tables that agree in all keys with one of the other table; null equals null.

    Channels that agree form a class: grp is the first position of a in it, links the number of channels of the other side.  All pairs are
    those of equal grp; they aren't written out, so a much repeated channel costs its rows and no more.
    """
    ks = [k for k in keys if use_gain or k != "gain"]
    u = a.select(F.lit("a").alias("side"), "ch", *ks).unionByName(b.select(F.lit("b").alias("side"), "ch", *ks))
    n = u.groupBy(*ks).agg(F.min(F.when(F.col("side") == "a", F.col("ch"))).alias("grp"), F.count(F.when(F.col("side") == "a", 1)).alias("_a"), F.count(F.when(F.col("side") == "b", 1)).alias("_b")).where("_a > 0 and _b > 0")
    same = reduce(lambda x, y: x & y, [u[k].eqNullSafe(n[k]) for k in ks])
    return u.join(n, same).select("side", "ch", "grp", F.when(F.col("side") == "a", F.col("_b")).otherwise(F.col("_a")).alias("links"))


def header_classes(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """ch, grp: the first position among the channels of the same id and keys (null equals null)."""
    g = df.groupBy("id", *keys).agg(F.min("ch").alias("grp"))
    return df.join(g, reduce(lambda x, y: x & y, [df[k].eqNullSafe(g[k]) for k in ("id", *keys)])).select(df["ch"], g["grp"])


def match_unset(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("fs", "gain", "units")) -> DataFrame:
    """Id, ch, n, ch_b, n_b and the keys filled both ways: pairs of equal id whose keys agree or are unset (null) on either side.

    Channels of equal id and keys are one class: a pair is given once for two classes, with their first positions and numbers of
    channels (``header_classes`` gives the membership).  An id has few header classes, however many channels.
    """
    def classes(d: DataFrame, p: str) -> DataFrame:
        return d.groupBy("id", *keys).agg(F.min("ch").alias(f"ch{p}"), F.count(F.lit(1)).alias(f"n{p}"))

    r = classes(b, "_b").select(F.col("id").alias("_id"), "ch_b", "n_b", *[F.col(k).alias(f"_{k}") for k in keys])
    j = classes(a, "").join(r, F.col("id") == F.col("_id"))
    j = j.where(reduce(lambda x, y: x & y, [F.col(k).isNull() | F.col(f"_{k}").isNull() | (F.col(k) == F.col(f"_{k}")) for k in keys]))
    return j.select("id", "ch", "n", "ch_b", "n_b", *[F.coalesce(k, f"_{k}").alias(k) for k in keys])


def interval_join(a: DataFrame, b: DataFrame, key: str, a_int: tuple[str, str], b_int: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of equal key whose closed intervals overlap (a point is an interval of no length).

    Intervals are spread over time buckets and joined on (key, bucket): no nested loops.  A pair is given in
    the bucket where the later of the two starts, so once.
    """
    def cut(d: DataFrame, s: str, e: str, p: str) -> DataFrame:
        k = F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))
        return d.where(F.col(e) >= F.col(s)).withColumn(p, F.explode(k))

    x, y = cut(a, *a_int, "_bk"), cut(b.withColumnRenamed(key, "_key"), *b_int, "_bk2")
    s1, e1, s2, e2 = (F.col(c) for c in (*a_int, *b_int))
    on = (F.col(key) == F.col("_key")) & (F.col("_bk") == F.col("_bk2")) & (s1 <= e2) & (s2 <= e1) & (F.col("_bk") == F.floor(F.greatest(s1, s2) / bucket))
    return x.join(y, on).drop("_key", "_bk", "_bk2")


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str], order: str, width: int = 65_536) -> DataFrame:
    """For every row of b one row of a with equal keys is dropped, the last ones first.

    ``width``: how much of ``order`` one task ranks; equal places are told apart by chance.
    """
    na, nb = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    null_safe = lambda x, y: reduce(lambda p, q: p & q, [x[k].eqNullSafe(y[k]) for k in keys])
    n = na.join(nb, null_safe(na, nb), "left").select(*[na[k] for k in keys], (F.col("_all") - F.coalesce("_m", F.lit(0))).alias("_keep")).where("_keep > 0")
    r = timeaxis.running(a, keys, order, width, F.lit(1), "_n")
    return r.join(n, null_safe(r, n)).where(F.col("_n") <= F.col("_keep")).select(*[r[c] for c in a.columns])


def union_unique(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, of exact duplicates the last; a before b."""
    u = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    rest = [c for c in a.columns if c not in keys]
    return u.groupBy(*keys).agg(F.max(F.struct("_s", order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def property_groups(df: DataFrame, props: list[str]) -> DataFrame:
    """Number of the group of channels that agree in properties (null equals null), by its first channel."""
    g = df.groupBy(*props).agg(F.min("ch").alias("grp"), F.count(F.lit(1)).alias("members"))
    cond = reduce(lambda x, y: x & y, [df[p].eqNullSafe(g[p]) for p in props])
    return df.join(g, cond).select(df["ch"], g["grp"], g["members"])


def merge_groups(df: DataFrame, keys: tuple[str, ...] = ("fs", "units")) -> DataFrame:
    """Ch, grp: channels of one id whose keys agree, unset (null) being a wildcard; partly unset
    headers join the most specified compatible header of their id, the first in order of position among equals.

    Headers are few per id: they are grouped as distinct combinations, not as channels.
    """
    n_set = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    h = df.groupBy("id", *keys).agg(F.min("ch").alias("grp")).withColumn("_n", n_set)
    a = h.select(*[F.col(c).alias(f"a_{c}") for c in ("id", *keys, "grp", "_n")])
    ok = reduce(lambda x, y: x & y, [F.col(f"a_{k}").isNull() | F.col(f"a_{k}").eqNullSafe(F.col(k)) for k in keys])
    best = a.join(h, (F.col("a_id") == F.col("id")) & ok).groupBy("a_id", *[f"a_{k}" for k in keys]).agg(F.max_by("grp", F.struct("_n", -F.col("grp"))).alias("grp"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in ("id", *keys)])
    return df.select("ch", "id", *keys).join(best, cond).select("ch", "id", "grp")


def merge_maps(df: DataFrame, keys: list[str], col: str, order: str) -> DataFrame:
    """A10: one map per group, the last in order wins a key; entries are reduced before they are collected."""
    e = df.select(*keys, order, F.explode(col).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
    return e.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(col))


def nearest(events: DataFrame, at_us: int, k: int, t: str = "ot_us", tie: str = "event_id") -> DataFrame:
    """The k events nearest to a time (a top-k report)."""
    return events.orderBy(F.abs(F.col(t) - at_us), tie).limit(k)


def compact_requests(df: DataFrame, what: str, others: list[str]) -> DataFrame:
    """Requests that differ in one column only become one with a comma list."""
    return df.select(what, *others).distinct().groupBy(*others).agg(F.concat_ws(",", F.array_sort(F.collect_set(what))).alias(what))


def changed(before: DataFrame, after: DataFrame, size: str = "nx") -> DataFrame:
    """Ids that are new, gone, or whose size changed."""
    a, b = before.groupBy("id").agg(F.sum(size).alias("was")), after.groupBy("id").agg(F.sum(size).alias("now"))
    return a.join(b, "id", "full").where(~F.col("was").eqNullSafe(F.col("now")))


def asof_join(left: DataFrame, right: DataFrame, key: str, t: str, value: str, width: int = DAY) -> DataFrame:
    """J13 (an addition): each left row with the value of the last right row of its key at or before its time.

    Both sides are merged in one window per key and time shard of ``width``, and a shard takes over the last value of those
    before it: no range join, and no task sorts a key.  Equal times match; ties on the right go to the larger value; null values don't count.
    """
    u = left.withColumn("_r", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(key, t, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).withColumn("_r", F.lit(0))
    d = timeaxis.sharded(u.unionByName(r, allowMissingColumns=True), [key], t, width)
    last = F.max_by(F.struct("_v"), F.when(F.col("_r") == 0, F.struct(t, "_v")))
    d = timeaxis.carried(d, {"_last": last}, lambda _, before: {"_carry": F.last("_last", ignorenulls=True).over(before)})
    w = timeaxis.within(t, "_r", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carry._v"))
    return d.withColumn(value, out).where("_r = 1").select(*left.columns, value)


def without_flagged(df: DataFrame, flag: str = "flagged") -> DataFrame:
    """Without flagged channels (null counts as not flagged)."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def as_event_traces(channels: DataFrame) -> DataFrame:
    """Channels with the columns that event traces have besides, unset."""
    z = F.lit(0.0)
    return channels.withColumns({"az": z, "baz": z, "dist": z, "pha": F.create_map().cast("map<string, double>")})


def as_channels(event_traces: DataFrame) -> DataFrame:
    """Event traces as plain channels."""
    return event_traces.drop("az", "baz", "dist", "pha")


def summary(channels: DataFrame) -> DataFrame:
    """One row: channels, distinct ids, regular and irregular ones, samples, earliest update."""
    n = F.coalesce(F.col("nx"), F.lit(0))
    return channels.agg(
        F.count(F.lit(1)).alias("channels"), F.countDistinct("id").alias("ids"), F.sum((F.col("fs") > 0).cast("long")).alias("regular"), F.sum((F.col("fs") == 0).cast("long")).alias("irregular"), F.sum(n).alias("samples")
    )


def in_region(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, dep_min: float | None = None, dep_max: float | None = None, loc: str = "loc") -> DataFrame:
    """Rows inside a rectangle (it may cross the date line: lon_min > lon_max) and a depth range; rows without a place are out."""
    lat, lon, dep = (F.col(f"{loc}.{k}") for k in ("lat", "lon", "dep"))
    lons = lon.between(lon_min, lon_max) if lon_min <= lon_max else (lon >= lon_min) | (lon <= lon_max)
    c = lat.between(lat_min, lat_max) & lons
    if dep_min is not None:
        c = c & (dep >= dep_min)
    if dep_max is not None:
        c = c & (dep <= dep_max)
    return df.where(c)


def in_radius(df: DataFrame, lat: float, lon: float, r_min: float, r_max: float, loc: str = "loc") -> DataFrame:
    """Rows whose distance in degrees from a point is between r_min and r_max."""
    from tremolite.functions.scalar import gcdist

    d = gcdist(F.lit(float(lat)), F.lit(float(lon)), f"{loc}.lat", f"{loc}.lon")["dist"]
    near = F.col(f"{loc}.lat").between(max(-90.0, lat - r_max - 0.5), min(90.0, lat + r_max + 0.5))  # a plain range reaches the scan
    return df.where(near & d.between(r_min, r_max))
