"""Queries of this package's problems: pN_... -> DataFrame, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.llm import leak, listpages, packing, survivor
from tremolite.session import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(load(spark, d, "channels"), load(spark, d, "sources"), votes="rank")


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(load(spark, d, "channels"), load(spark, d, "sources"), votes="sum")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    boxes = load(spark, d, "boxes")
    return packing.filling(packing.pack(packing.token_counts(load(spark, d, "documents")), boxes), boxes)


def p7_placement(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(load(spark, d, "documents")), load(spark, d, "boxes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("words").alias("words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return listpages.list_pages(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_consensus, p7_fill, p7_placement, p8_found, p8_items, p9_found)}

SQL = {
    "p4_found": """
with c as (
  select regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '\\1\\2'), '_-/', '...'), '\\s+', '', 'g') as id,
    rec_id, coalesce(s.trust, 0) as trust, epoch_us(updated) as us, name, loc, resp, gain
  from channels left join sources s using (src)),
m as (select id from c where id is not null group by id having count(*) >= 2),
u as (
  select id, 'name' as field, rec_id, trust, us from c where name is not null
    and lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) not in ('', '?', '-', '--', 'n/a', 'na', 'null', 'none', 'nil', 'nan', 'unknown', 'tbd', 'tba', 'todo', 'test', 'no name', 'noname', 'unnamed', 'not available', 'default', '-12345', '0')
    and not regexp_matches(lower(trim(name)), '^(x+|\\?+|\\.+|-+|_+|\\*+)$')
  union all
  select id, 'gain', rec_id, trust, us from c where gain is not null and not isnan(gain) and gain > 0 and gain <> 1 and gain < 1e300
  union all
  select id, 'loc', rec_id, trust, us from c where loc is not null and loc.lat is not null and loc.lon is not null and not isnan(loc.lat) and not isnan(loc.lon)
    and abs(loc.lat) <= 90 and abs(loc.lon) <= 180
    and not (loc.lat = 0 and loc.lon = 0 and coalesce(loc.el, 0) = 0 and coalesce(loc.dep, 0) = 0 and coalesce(loc.az, 0) = 0 and coalesce(loc.inc, 0) = 0)
  union all
  select id, 'resp', rec_id, trust, us from c where len(resp.p) > 0 and resp.f0 is not null and not isnan(resp.f0) and resp.f0 > 0 and resp.f0 < 1e300)
select id, field, rec_id from u semi join m using (id)
qualify row_number() over (partition by id, field order by trust desc, us desc nulls last, rec_id desc) = 1
""",
}
