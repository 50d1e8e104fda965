"""Earthquake operators (F20, U9, W7-W9, section 2.12) on event and pick tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.functions.scalar import gcdist


def distaz(channels: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """channels of an event with distance and azimuths from its origin; a channel without a place raises.

    Both tables have ``key``; events have lat and lon, channels a loc struct.
    """
    e = events.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    j = channels.join(e, key)
    missing = F.col("loc.lat").isNull() | F.col("loc.lon").isNull()
    lat = F.when(missing, F.raise_error(F.lit("a channel has no geographic location")).cast("double")).otherwise(F.col("loc.lat"))
    j = j.withColumn("_g", gcdist("_lat", "_lon", lat, "loc.lon"))
    return j.select(*channels.columns, "_g.dist", "_g.az", "_g.baz")


#: Sources that one call of ``source_receiver`` takes.
MOST_SOURCES = 1000


def source_receiver(sources: list[tuple[str, float, float]], receivers: DataFrame, lat: str = "loc.lat", lon: str = "loc.lon") -> DataFrame:
    """Every receiver with its distance and azimuths from each source (name, lat, lon): receivers' columns, source, dist, az, baz.

    Sources are a stated query set of at most MOST_SOURCES (ValueError beyond; give them in blocks); they go with the plan, so nothing is
    joined.  Receivers without a place have null figures.
    """
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give them in blocks")
    if not sources:
        return receivers.select("*", F.lit(None).cast("string").alias("source"), *[F.lit(None).cast("double").alias(k) for k in ("dist", "az", "baz")]).limit(0)
    one = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for n, a, o in sources])
    g = gcdist("_s.lat", "_s.lon", lat, lon)
    return receivers.select("*", F.explode(one).alias("_s")).select("*", g.alias("_g")).select(*receivers.columns, "_s.source", "_g.dist", "_g.az", "_g.baz")


def source_headers(headers: DataFrame, sources: DataFrame, key: str = "event_id", order: str = "src_id") -> DataFrame:
    """Each event header with its event's first source by ``order`` (null where there is none; of equal ones the least); column names must differ but for the key."""
    first = sources.groupBy(key).agg(F.min(F.struct(order, *[c for c in sources.columns if c not in (key, order)])).alias("_s"))
    return headers.join(first, key, "left").select(*headers.columns, "_s.*")


def show_phases(picks: DataFrame, catalog: str = "pha") -> DataFrame:
    """Picks of each channel, one row per phase, sorted by travel time."""
    return picks.select("id", F.explode(catalog).alias("phase", "p")).select("id", "phase", "p.*").orderBy("id", "tt")


def merge_trace_fields(df: DataFrame, keys: list[str], latest: str) -> DataFrame:
    """Distance and azimuths of merged event traces, the latest member's unless 0, else the first other that isn't."""
    val = lambda c: F.max_by(F.col(c), F.struct((F.coalesce(F.col(c), F.lit(0.0)) != 0).cast("int"), F.col(latest)))
    return df.groupBy(*keys).agg(*[val(c).alias(c) for c in ("az", "baz", "dist")])


def event_table(events: DataFrame, channels: DataFrame, samples: DataFrame, before_us: int, after_us: int, table: DataFrame | None = None, phase: str = "P") -> DataFrame:
    """event_id, id, dist, az, baz, phase, tt, n, t0_us: every channel of every event with its geometry, the travel time of a phase
    (null without a ``table``) and its samples from before_us to after_us around the origin time.

    events: event_id, ot_us, lat, lon; channels: event_id, id, loc; samples: id, t_us, x.  Samples are joined by id and time bucket; channels
    without samples in the window have n 0.
    """
    from tremolite.operators.select import interval_join

    g = distaz(channels.select("event_id", "id", "loc"), events).select("event_id", "id", "dist", "az", "baz")
    g = travel_times(g, table, phase) if table is not None else g.select("*", F.lit(phase).alias("phase"), F.lit(None).cast("double").alias("tt"))
    w = channels.select("event_id", "id").distinct().join(events.select("event_id", (F.col("ot_us") - before_us).alias("_a"), (F.col("ot_us") + after_us).alias("_z")), "event_id")
    s = samples.select("id", "t_us", F.col("t_us").alias("_t2"))
    n = interval_join(w, s, "id", ("_a", "_z"), ("t_us", "_t2"), max(1, before_us + after_us)).groupBy("event_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0_us"))
    return g.join(n, ["event_id", "id"], "left").select("event_id", "id", "dist", "az", "baz", "phase", "tt", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "t0_us")


def merge_phases(df: DataFrame, keys: list[str], latest: str, pha: str = "pha") -> DataFrame:
    """One phase map of merged event traces: of each phase the latest member's pick; entries are reduced before they are collected."""
    from tremolite.operators.select import merge_maps

    return merge_maps(df, keys, pha, latest)


def travel_times(pairs: DataFrame, table: DataFrame, phase: str = "P") -> DataFrame:
    """W9 without a web service: travel times of a phase by linear interpolation of a table (phase, dist, tt).

    The table is a small, fixed one; it is joined by whole degrees.
    """
    from pyspark.sql import Window

    t = table.where(F.col("phase") == phase)
    w = Window.partitionBy("phase").orderBy("dist")
    t = t.select("dist", "tt", F.lead("dist").over(w).alias("_d2"), F.lead("tt").over(w).alias("_t2")).where("_d2 is not null")
    t = t.select(F.col("dist").alias("_d1"), F.col("tt").alias("_t1"), "_d2", "_t2", F.explode(F.sequence(F.floor("dist"), F.floor("_d2"))).alias("_k"))
    j = pairs.withColumn("_k", F.floor("dist")).join(t, "_k").where((F.col("dist") >= F.col("_d1")) & (F.col("dist") < F.col("_d2")))
    tt = F.col("_t1") + (F.col("_t2") - F.col("_t1")) * (F.col("dist") - F.col("_d1")) / (F.col("_d2") - F.col("_d1"))
    return j.select(*pairs.columns, F.lit(phase).alias("phase"), tt.alias("tt"))
