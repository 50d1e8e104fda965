"""Problem 3: overlapping and gapped time intervals to periods and gaps.

Sort by start per entity, compare each start with the running maximum of previous ends,
label islands cumulatively, aggregate periods and derive gaps.  An entity that holds much of
the data is split into time shards: each shard is sorted and scanned by itself, and the
running maximum and the island count are carried from shard to shard through a small
table of one row per (entity, shard).  No task ever sees a whole entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time shard: only a matter of speed, results don't depend on it.
SHARD_US = 6 * 3600 * 1_000_000


def islands(df: DataFrame, key: str, start: str, end: str, slack: Column, shard_us: int = SHARD_US) -> DataFrame:
    """Rows (key, _s, _e, _isl): intervals with the number of their period.

    An interval belongs to the period before unless it starts later than (running end) + slack.
    Intervals with a null key, start or end, or that end before they start, are left out.
    Equal and repeated intervals share a period.
    """
    x = df.select(F.col(key).alias("_key"), F.col(start).alias("_s"), F.col(end).alias("_e"), slack.cast("long").alias("_slack")).where(
        F.col("_key").isNotNull() & (F.col("_e") >= F.col("_s"))
    )
    # equal intervals are one row from here on: copies of one interval can't make a hot shard
    x = x.groupBy("_key", "_s", "_e").agg(F.max("_slack").alias("_slack")).withColumn("_sh", F.floor(F.col("_s") / F.lit(shard_us)))
    w = Window.partitionBy("_key", "_sh").orderBy("_s", "_e")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_key").orderBy("_sh")
    carry = x.groupBy("_key", "_sh").agg(F.max("_e").alias("_m")).select(
        "_key", "_sh", F.max("_m").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry")
    )
    x = x.withColumn("_prev", F.max("_e").over(before)).join(carry, ["_key", "_sh"])
    end_so_far = F.greatest("_prev", "_carry")
    x = x.withColumn("_new", (end_so_far.isNull() | (F.col("_s") > end_so_far + F.col("_slack"))).cast("long"))
    x = x.withColumn("_loc", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # shard-local islands, then numbers continued over the shards
    loc = x.groupBy("_key", "_sh", "_loc").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_new").alias("_new"))
    base = loc.groupBy("_key", "_sh").agg(F.max("_loc").alias("_n")).select(
        "_key", "_sh", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    return loc.join(base, ["_key", "_sh"]).select("_key", (F.col("_base") + F.col("_loc")).alias("_isl"), "_s", "_e")


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, slack: Column, shard_us: int = SHARD_US) -> DataFrame:
    """key, kind ('period' or 'gap'), start_us, end_us.

    period: first and last covered time; gap: last time of a period and first of the next.
    Empty input gives no rows; a single interval one period.  Extra columns are ignored.
    """
    p = islands(df, key, start, end, slack, shard_us).groupBy("_key", "_isl").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    # every period says where it starts to the period before: gaps need no ordered scan of an entity
    parts = p.select(
        "_key",
        F.explode(
            F.array(
                F.struct(F.col("_isl").alias("n"), F.col("_s").alias("s"), F.col("_e").alias("e"), F.lit(None).cast("long").alias("nx")),
                F.struct((F.col("_isl") - 1).alias("n"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.col("_s").alias("nx")),
            )
        ).alias("r"),
    )
    g = parts.groupBy("_key", F.col("r.n").alias("n")).agg(F.max("r.s").alias("s"), F.max("r.e").alias("e"), F.max("r.nx").alias("nx")).where(F.col("s").isNotNull())
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("nx").alias("b")),
    )
    return g.select("_key", F.explode(both).alias("o")).where(F.col("o.b").isNotNull()).select(
        F.col("_key").alias(key), F.col("o.kind").alias("kind"), F.col("o.a").alias("start_us"), F.col("o.b").alias("end_us")
    )
