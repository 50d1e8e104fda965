"""SQL surface (an addition: the reference has none): temporary views, SQL functions and a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: SQL functions with plain SQL bodies; registered for the session.
FUNCTIONS = {
    "inst_code": ("id STRING", "STRING", r"regexp_extract(id, '\\.[^.]([^.])[^.]*$', 1)"),
    "delta_us": ("fs DOUBLE", "BIGINT", "CASE WHEN fs > 0 THEN CAST(rint(1e6 / fs) AS BIGINT) END"),
    "julian_day": ("y INT, m INT, d INT", "INT", "dayofyear(make_date(y, m, d))"),
    "grid_slot": ("t BIGINT, step BIGINT", "BIGINT", "t + step div 2 - pmod(t + step div 2, step)"),
    "canonical_id": ("id STRING", "STRING", r"regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '$1$2'), '_-/', '...'), '\\s+', '')"),
}


@udtf(returnType="i: bigint, t_us: bigint")
class TExpand:
    """Sample numbers and times of one time matrix (array of (i, us)) at a step in microseconds."""

    def eval(self, t, step: int):
        if not t or not step:
            return
        at, rows = 0, [(r["i"], r["us"]) for r in t]
        last = rows[-1][0]
        gaps = dict(rows[1:])
        for k in range(1, last + 1):
            at = rows[0][1] if k == 1 else at + step + (gaps.get(k, 0) or 0)
            yield k, at


def register(spark: SparkSession) -> None:
    """Functions and the t_expand table function for spark.sql."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("t_expand", TExpand)


def views(spark: SparkSession, **tables: DataFrame) -> None:
    """Tables as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
