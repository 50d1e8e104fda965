"""Synthetic channels (section 2.16): seeded, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampling rates of regular channels.
RATES = (0.1, 1.0, 2.0, 5.0, 10.0, 20.0, 25.0, 40.0, 50.0, 60.0, 62.5, 80.0, 100.0)


def channels(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n random channel headers: ch, id, fs, gain, units, lat, lon."""
    c = spark.range(1, n + 1).select(F.col("id").alias("ch"))
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "ch"), F.lit(m))
    letters = lambda k, m: F.concat(*[F.char(65 + h(f"{k}{j}", 26)) for j in range(m)])
    inst = F.element_at(F.array(*[F.lit(v) for v in ("HZ", "HN", "HE", "NZ", "LZ")]), (h("i", 5) + 1).cast("int"))
    units = F.when(F.substring(inst, 1, 1) == "N", "m/s2").otherwise("m/s")
    fs = F.element_at(F.array(*[F.lit(v) for v in RATES]), (h("fs", len(RATES)) + 1).cast("int"))
    return c.select("ch", F.concat(letters("n", 2), F.lit("."), letters("s", 4), F.lit("..B"), inst).alias("id"), fs.alias("fs"), (10.0 ** (h("g", 9) + 1)).alias("gain"), units.alias("units"), (h("lat", 18001) / 100.0 - 90).alias("lat"), (h("lon", 36001) / 100.0 - 180).alias("lon"))


def traces(headers: DataFrame, seconds: int, start_us: int, seed: int = 42, gaps: int = 3) -> DataFrame:
    """ch, seg, t0_us, dt_us, fs, x: each channel's samples in up to gaps + 1 segments, gaps of more than half a step."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "ch", "seg"), F.lit(1_000_000)) / 1e6
    t = headers.select("ch", "fs", F.explode(F.sequence(F.lit(0), F.lit(gaps))).alias("seg"))
    dt = F.rint(1e6 / F.col("fs")).cast("long")
    n = F.greatest(F.lit(1), F.floor(seconds * F.col("fs") / (gaps + 1) * (0.5 + 0.5 * h("n")))).cast("long")
    t0 = F.lit(start_us) + F.col("seg") * F.lit(int(seconds * 1.5e6 / (gaps + 1))).cast("long") + F.floor(h("t") * 1000)
    noise = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: (F.pmod(F.xxhash64(F.lit(seed), "ch", "seg", k), F.lit(2_000_001)) - 1_000_000) / 1e6)
    return t.select("ch", F.col("seg").cast("long").alias("seg"), t0.cast("long").alias("t0_us"), dt.alias("dt_us"), "fs", noise.alias("x"))


def events(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n random events: event_id, ot_us, lat, lon, dep, mag, mag_scale, typ, picks (phase -> travel time)."""
    e = spark.range(1, n + 1)
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(m))
    pick = lambda names, k: F.element_at(F.array(*[F.lit(v) for v in names]), (h(k, len(names)) + 1).cast("int"))
    dist = h("d", 18000) / 100.0
    return e.select(
        F.format_string("ev%06d", "id").alias("event_id"), (F.lit(1_500_000_000_000_000) + h("t", 10**15)).alias("ot_us"), (h("lat", 18001) / 100.0 - 90).alias("lat"), (h("lon", 36001) / 100.0 - 180).alias("lon"),
        (h("dep", 70000) / 100.0).alias("dep"), (h("m", 90) / 10.0 - 1).alias("mag"), pick(("Mw", "ML", "mb", "Ms"), "s").alias("mag_scale"), pick(("earthquake", "explosion", "quarry blast"), "k").alias("typ"),
        F.create_map(F.lit("P"), dist * 8.0, F.lit("S"), dist * 14.5).alias("picks"),
    )
