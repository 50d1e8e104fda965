"""The engine's own store (S15-S17, K1-K2, K8-K9): Parquet partitioned by station and day, with add and overwrite modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.functions.ids import wildcard_to_regex
from tremolite.model import DAY

VERSION = "1"


#: Columns of a store; partition values are read as what they are, not guessed ('007' is a text).
SCHEMA = "id string, t_us bigint, x double, net_sta string, day date"


def with_partitions(samples: DataFrame) -> DataFrame:
    """net_sta and day columns of samples (id, t_us, x); an id without a dot is a station of its own, a missing one is 'none'."""
    station = F.regexp_extract("id", r"^([^.]*\.[^.]*)", 1)
    return samples.withColumn("net_sta", F.coalesce(F.nullif(station, F.lit("")), F.nullif(F.col("id"), F.lit("")), F.lit("none"))).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"(t_us - pmod(t_us, {DAY})) div {DAY}").cast("int")))


def write(samples: DataFrame, path: str, mode: str = "new", compression: str = "lz4") -> None:
    """Samples (id, t_us, x) to the store.

    mode 'new' fails on an existing store; 'add' keeps stored values where both have a sample; 'ovr' takes the
    new ones.  Only the station-days that the new samples touch are rewritten; old and new are joined on (id, t_us).
    """
    spark = samples.sparkSession
    new = with_partitions(samples.select("id", "t_us", "x"))
    if mode == "new":
        new.repartition("net_sta", "day").sortWithinPartitions("id", "t_us").write.option("compression", compression).partitionBy("net_sta", "day").parquet(path)
        return
    if mode not in ("add", "ovr"):
        raise ValueError("modes are new, add and ovr")
    touched = new.select("net_sta", "day").distinct()
    old = spark.read.schema(SCHEMA).parquet(path).join(touched, ["net_sta", "day"], "left_semi")
    # a missing id is one like any other
    j = old.select(F.struct("id").alias("_id"), "t_us", F.col("x").alias("_old")).join(new.select(F.struct("id").alias("_id"), "t_us", F.col("x").alias("_new")), ["_id", "t_us"], "full").withColumn("id", F.col("_id.id"))
    x = F.coalesce("_old", "_new") if mode == "add" else F.coalesce("_new", "_old")
    # the old files are read by the plan that replaces them, so the result is made firm first
    from tremolite.session import cut

    out = cut(with_partitions(j.select("id", "t_us", x.alias("x"))))
    out.repartition("net_sta", "day").sortWithinPartitions("id", "t_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("net_sta", "day").parquet(path)


def read(spark: SparkSession, path: str, id: str = "*", start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Samples of ids that contain a match of a wildcard pattern, in a closed time range; days outside aren't read."""
    s = spark.read.schema(SCHEMA).parquet(path)
    if id != "*":
        s = s.where(F.col("id").rlike(wildcard_to_regex(id)))
    day = lambda us: F.date_add(F.lit("1970-01-01").cast("date"), us // DAY)
    if start_us is not None:
        s = s.where((F.col("day") >= day(start_us)) & (F.col("t_us") >= start_us))
    if end_us is not None:
        s = s.where((F.col("day") <= day(end_us)) & (F.col("t_us") <= end_us))
    return s.select("id", "t_us", "x")


def write_table(rows: DataFrame, path: str, key: str, mode: str = "new") -> None:
    """K9: a table of events, picks or auxiliary data beside the samples, one row a key.

    mode 'new' fails on an existing table; 'add' keeps stored rows where both have a key; 'ovr' takes the new ones.
    """
    spark = rows.sparkSession
    if mode == "new":
        rows.write.parquet(path)
        return
    if mode not in ("add", "ovr"):
        raise ValueError("modes are new, add and ovr")
    from tremolite.session import cut

    old = spark.read.parquet(path)
    first, rest = (old, rows) if mode == "add" else (rows, old)
    # the old files are read by the plan that replaces them, so the result is made firm first
    out = cut(first.unionByName(rest.join(first.select(key), key, "left_anti"), allowMissingColumns=True))
    out.write.mode("overwrite").parquet(path)


def read_event(spark: SparkSession, path: str, events: DataFrame, event_id: str, before_us: int, after_us: int) -> DataFrame:
    """Samples around one event's origin time."""
    one = events.where(F.col("event_id") == event_id).select(F.col("ot_us").alias("_ot"))
    return read(spark, path).join(F.broadcast(one), F.expr(f"t_us between _ot - {before_us} and _ot + {after_us}"), "inner").select("id", "t_us", "x")


def scan(spark: SparkSession, path: str, level: str = "station") -> DataFrame:
    """Stations or channels in the store; stations come from the partitions alone."""
    s = spark.read.schema(SCHEMA).parquet(path)
    return s.select("net_sta").distinct() if level == "station" else s.select("id").distinct()


def version(spark: SparkSession, path: str) -> str | None:
    """K2: the format version a store says it has; None if it says nothing."""
    try:
        rows = spark.read.text(f"{path}/_format").collect()
    except Exception:  # noqa: BLE001
        return None
    return rows[0][0] if rows else None


def set_version(spark: SparkSession, path: str, value: str = VERSION) -> None:
    """K2: writes the version beside the data; readers of the data don't see it."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_format")
