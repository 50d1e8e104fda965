"""Queries of the general data problems: pN_... -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite import timeaxis
from tremolite.operators import drift, intervals, regular, spikes, unitgraph
from tremolite.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged(load(spark, d, "readings"), load(spark, d, "runs")).select("id", "t_us")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged(load(spark, d, "readings"), load(spark, d, "runs"))


def p1_impossible(spark: SparkSession, d: str) -> DataFrame:
    f = spikes.flagged(load(spark, d, "readings"), load(spark, d, "runs"))
    return f.where(F.col("reason") == "impossible").select("id", "t_us")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = drift.changes(load(spark, d, "meta_records"), load(spark, d, "meta_files"))
    return c.select("file_id", "change_kind", "field", "new_field")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    t = drift.consistent_table(load(spark, d, "meta_records"), load(spark, d, "meta_files"))
    return t.select("line_id", "file_id", "producer", "version", "id", *[F.to_json(g).alias(g) for g in drift.GROUPS])


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(load(spark, d, "meta_records"), load(spark, d, "meta_files"))


def p2_losses(spark: SparkSession, d: str) -> DataFrame:
    return drift.losses(load(spark, d, "meta_records"), load(spark, d, "meta_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    w = timeaxis.windows(load(spark, d, "traces"), ["id"])
    return intervals.periods_and_gaps(w, "id", "t0_us", "t1_us", F.col("d") + F.expr("d div 2"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = regular.regularise(load(spark, d, "readings"), load(spark, d, "runs"))
    return g.where(F.col("status") != regular.OBSERVED).select("run_id", "slot_us")


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    return regular.regularise(load(spark, d, "readings"), load(spark, d, "runs"))


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    return regular.regularise(load(spark, d, "readings"), load(spark, d, "runs")).select("run_id", "slot_us", "status")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unitgraph.to_si(load(spark, d, "channels"))


def p6_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of absolute temperatures, pressures and more, by turns in other units of the same quantity (offsets included)."""
    u = load(spark, d, "runs").groupBy("run_id").agg(F.max("units").alias("unit"))
    r = load(spark, d, "readings").select("rd_id", "run_id", "x").join(u, "run_id", "left")
    other = {"K": ("degC", "degF", "K"), "Pa": ("hPa", "psi", "mbar"), "m/s": ("in/s", "nm/s", "kine"), "V": ("mV", "uV", "V"), "%": ("fraction", "%", "%")}
    to = F.create_map(*[v for k, t in other.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in t]))])
    r = r.withColumn("to", F.element_at(F.try_element_at(to, F.col("unit")), (F.col("rd_id") % 3 + 1).cast("int")))
    c = unitgraph.convert(r, "x", "unit", "to", "y")
    real = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    return c.select("rd_id", "to", F.when(real, F.format_string("%.8e", "y").cast("double")).alias("y"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_impossible, p2_found, p2_table, p2_versions, p2_losses, p3_found, p5_found, p5_series, p5_status, p6_found, p6_readings)}

#: Fixed values, typed out for SQL beside the graph: unit, SI unit, scale, offset.
_UNITS = """
('m','m',1,0), ('nm','m',1e-9,0), ('um','m',1e-6,0), ('mm','m',1e-3,0), ('cm','m',1e-2,0), ('km','m',1e3,0), ('in','m',0.0254,0),
('m/s','m/s',1,0), ('nm/s','m/s',1e-9,0), ('um/s','m/s',1e-6,0), ('mm/s','m/s',1e-3,0), ('cm/s','m/s',1e-2,0), ('km/s','m/s',1e3,0), ('in/s','m/s',0.0254,0), ('kine','m/s',0.01,0),
('m/s2','m/s2',1,0), ('nm/s2','m/s2',1e-9,0), ('um/s2','m/s2',1e-6,0), ('mm/s2','m/s2',1e-3,0), ('cm/s2','m/s2',1e-2,0), ('gal','m/s2',0.01,0), ('mgal','m/s2',1e-5,0), ('gravity','m/s2',9.80665,0), ('milligravity','m/s2',0.00980665,0),
('pa','Pa',1,0), ('mpa','Pa',1e-3,0), ('hpa','Pa',100,0), ('kpa','Pa',1000,0), ('mbar','Pa',100,0), ('bar','Pa',100000,0), ('psi','Pa',6894.757293168,0),
('k','K',1,0), ('mk','K',1e-3,0), ('degc','K',1,273.15), ('degf','K',0.5555555555555556,255.3722222222222),
('v','V',1,0), ('mv','V',1e-3,0), ('uv','V',1e-6,0), ('nv','V',1e-9,0),
('rad','rad',1,0), ('mrad','rad',1e-3,0), ('urad','rad',1e-6,0), ('nrad','rad',1e-9,0), ('deg','rad',0.017453292519943295,0), ('arcmin','rad',0.0002908882086657216,0), ('arcsec','rad',4.84813681109536e-06,0),
('%','%',1,0), ('fraction','%',100,0), ('hz','Hz',1,0), ('mhz','Hz',1e-3,0), ('khz','Hz',1000,0), ('rad/s','Hz',0.15915494309189535,0)
"""
#: Spellings, for SQL.
_SPELLED = ", ".join(f"('{k}', '{u}')" for k, u in unitgraph.SPELLED.items())
_UNIT_SQL = "lower(trim(t))"
for _a, _b in unitgraph.REWRITES:
    _UNIT_SQL = f"regexp_replace({_UNIT_SQL}, '{_a}', '{_b}', 'g')"
#: Fields of records with their JSON types, for SQL.
_FIELDS = """r as (select file_id, raw from meta_records where json_valid(raw) and json_type(raw) = 'OBJECT'),
k as (select file_id, json_extract_string(raw, '$.id') as id, unnest(json_keys(raw)) as k, raw from r),
n as (select file_id, id, k as g, unnest(json_keys(json_extract(raw, '$.' || k))) as kk, json_extract(raw, '$.' || k) as o from k where k in ('loc', 'resp', 'misc') and json_type(json_extract(raw, '$.' || k)) = 'OBJECT'),
f as (select file_id, id, k as field, json_extract(raw, '$."' || k || '"') as v from k where regexp_matches(k, '^(loc|resp|misc)\\.')
      union all select file_id, id, g || '.' || kk, json_extract(o, '$."' || kk || '"') from n),
t as (select file_id, id, field, v, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as kind from f where v is not null and json_type(v) <> 'NULL'),
c as (select file_id, field, kind, count(*) as n from t group by all),
ff as (select file_id, field, arg_max(kind, n * 1000000 - ascii(kind) * 1000 - ascii(kind[2:])) as kind from c group by file_id, field)"""

SQL = {
    "p2_versions": f"""
with {_FIELDS},
g as (select file_id, sha256(string_agg(field || ':' || kind, '|' order by field || ':' || kind)) as fingerprint, count(*) as n_fields from ff group by file_id),
ch as (select m.file_id, producer, row_number() over w as seq, fingerprint, lag(fingerprint) over w as was, coalesce(n_fields, 0) as n_fields from meta_files m left join g using (file_id) window w as (partition by producer order by written nulls first, m.file_id))
select file_id, producer, seq, fingerprint, cast(sum((fingerprint is distinct from was)::int) over (partition by producer order by seq rows unbounded preceding) as bigint) as version, n_fields from ch
""",
    "p6_readings": f"""
with si(unit, si_units, scale, off) as (values {_UNITS}), u as (select run_id, max(units) as unit from runs group by run_id),
r as (select rd_id, x, unit, case unit when 'K' then ['degC', 'degF', 'K'] when 'Pa' then ['hPa', 'psi', 'mbar'] when 'm/s' then ['in/s', 'nm/s', 'kine'] when 'V' then ['mV', 'uV', 'V'] when '%' then ['fraction', '%', '%'] end[rd_id % 3 + 1] as "to" from readings left join u using (run_id)),
c as (select rd_id, "to", (x * a.scale + a.off - b.off) / b.scale as y from r left join si a on a.unit = lower(r.unit) left join si b on b.unit = lower(r."to"))
select rd_id, "to", case when isnan(y) or isinf(y) then null else cast(printf('%.8e', y) as double) end as y from c
""",
    "p1_impossible": """
select distinct r.id, r.t as t_us from readings r left join runs u on r.run_id = u.run_id
where r.x is not null and not isnan(r.x) and r.t is not null and r.id is not null and (abs(r.x) >= 1e18 or (r.x = -12345 and lower(u.units) not in ('counts', '{counts}'))
  or (lower(u.units) in ('counts', '{counts}') and (r.x < -8388608 or r.x > 8388607)) or (u.units = 'K' and (r.x < 50 or r.x > 500)) or (u.units = '%' and (r.x < 0 or r.x > 100))
  or (u.units = 'Pa' and (r.x < 100 or r.x > 1e6)) or (u.units = 'V' and abs(r.x) > 1000) or (u.units = 'm/s' and abs(r.x) > 50))
""",
    "p5_status": """
with j as (select u.run_id, cast(round_even(1e6 / u.fs, 0) as bigint) as d, r.t, r.x from readings r join runs u on r.run_id = u.run_id where u.fs > 0 and r.t is not null),
k as (select run_id, d, (t + d // 2) // d as k, t, x from j),
b as (select run_id, d, min(k) as lo, max(k) as hi from k group by run_id, d),
g as (select run_id, d, unnest(generate_series(lo, hi)) as k from b),
o as (select distinct run_id, k from k where x is not null and not isnan(x)),
f as (select run_id, t, max(k) as k from k where x is not null and not isnan(x) group by run_id, t having not isinf(avg(x))),
fk as (select run_id, k, min(t) as t0, max(t) as t1 from f group by run_id, k),
s as (select g.run_id, g.d, g.k, o.k is not null as seen, last_value(case when fk.t0 <= g.k * g.d then fk.k end ignore nulls) over (partition by g.run_id order by g.k rows between unbounded preceding and current row) as p0,
  last_value(fk.k ignore nulls) over (partition by g.run_id order by g.k rows between unbounded preceding and 1 preceding) as p1,
  first_value(fk.k ignore nulls) over (partition by g.run_id order by g.k rows between 1 following and unbounded following) as n1
  from g left join o on o.run_id = g.run_id and o.k = g.k left join fk on fk.run_id = g.run_id and fk.k = g.k)
select run_id, k * d as slot_us, case when seen then 'observed' when p1 is not null and n1 is not null and n1 - p1 <= 11 then 'filled' else 'missing' end as status from s
""",
    "p3_found": """
with m as (select tr_id, id, cast(round_even(1e6 / fs, 0) as bigint) as d, t from traces where fs > 0 and len(t) > 0),
r as (select tr_id, id, d, generate_subscripts(t, 1) as k, len(t) as n, unnest(t) as u from m),
q as (select tr_id, id, d, k, n, u.i as i, u.us as us, sum(u.us) over (partition by tr_id order by k rows unbounded preceding) as g from r),
s as (select *, i_end from (select tr_id, id, d, i, cast(g as bigint) + (i - 1) * d as s, coalesce(lead(i) over (partition by tr_id order by k) - 1, i) as i_end, n, k
      from q where k < n or us <> 0 or n = 1) z),
l as (select tr_id, max(i) as nx, max_by(us, k) as last_us from q group by tr_id),
f as (select s.*, case when s.k = (select max(s2.k) from s s2 where s2.tr_id = s.tr_id) then l.nx else s.i_end end as ie from s join l using (tr_id)),
w as (select id, d, s as a, s + (ie - i) * d as b from f where ie >= i),
p as (select *, max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding) as pe from w),
c as (select *, sum(case when pe is null or a > pe + d + d // 2 then 1 else 0 end) over (partition by id order by a, b rows unbounded preceding) as isl from p),
e as (select id, isl, min(a) as a, max(b) as b from c group by id, isl),
x as (select id, a, b, lead(a) over (partition by id order by isl) as nx from e)
select id, 'period' as kind, a as start_us, b as end_us from x
union all select id, 'gap', b, nx from x where nx is not null
""",
    "p5_found": """
with j as (select u.run_id, cast(round_even(1e6 / u.fs, 0) as bigint) as d, r.t, r.x from readings r join runs u on r.run_id = u.run_id where u.fs > 0 and r.t is not null),
k as (select run_id, d, (t + d // 2) // d as k, x from j),
b as (select run_id, d, min(k) as lo, max(k) as hi from k group by run_id, d),
g as (select run_id, d, unnest(generate_series(lo, hi)) as k from b),
v as (select distinct run_id, k from k where x is not null and not isnan(x))
select g.run_id, g.k * g.d as slot_us from g left join v on g.run_id = v.run_id and g.k = v.k where v.k is null
""",
    "p2_found": """
with r as (select file_id, raw from meta_records where json_valid(raw) and json_type(raw) = 'OBJECT'),
k as (select file_id, json_extract_string(raw, '$.id') as id, unnest(json_keys(raw)) as k, raw from r),
n as (select file_id, id, k as g, unnest(json_keys(json_extract(raw, '$.' || k))) as kk, json_extract(raw, '$.' || k) as o from k where k in ('loc', 'resp', 'misc') and json_type(json_extract(raw, '$.' || k)) = 'OBJECT'),
f as (select file_id, id, k as field, json_extract(raw, '$."' || k || '"') as v from k where regexp_matches(k, '^(loc|resp|misc)\\.')
      union all select file_id, id, g || '.' || kk, json_extract(o, '$."' || kk || '"') from n),
t as (select file_id, id, field, v, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as kind from f where v is not null and json_type(v) <> 'NULL'),
c as (select file_id, field, kind, count(*) as n from t group by all),
ff as (select file_id, field, arg_max(kind, n * 1000000 - ascii(kind) * 1000 - ascii(kind[2:])) as kind from c group by file_id, field),
ch as (select file_id, lag(file_id) over w as prev_file, lead(file_id) over w as next_file from meta_files window w as (partition by producer order by written nulls first, file_id)),
now as (select ff.* from ff join ch using (file_id) where prev_file is not null),
was as (select next_file as file_id, field, kind from ff join ch using (file_id) where next_file is not null),
d as (select coalesce(was.file_id, now.file_id) as file_id, coalesce(was.field, now.field) as field, was.kind as ok, now.kind as nk from was full join now on was.file_id = now.file_id and was.field = now.field where was.kind is distinct from now.kind),
pv as (select file_id, id, field, lower(regexp_replace(v::varchar, '[\\[\\]{}"\\s]|"?(?:value|items)"?:', '', 'g')) as s from t where id is not null),
vals as (select file_id, id, field, min(coalesce(try_cast(s as double)::varchar, s)) as v from pv where s not in ('', 'n/a', 'null', 'none') group by file_id, id, field),
ov as (select ch.next_file as file_id, vals.id, d.field as old, v from vals join ch using (file_id) join d on d.file_id = ch.next_file and d.field = vals.field and d.nk is null),
nv as (select vals.file_id, vals.id, d.field as new, v from vals join d on d.file_id = vals.file_id and d.field = vals.field and d.ok is null),
pr as (select file_id, old, new, count(*) as n_both, count(*) filter (ov.v = nv.v) as same from ov join nv using (file_id, id) group by file_id, old, new),
ok as (select * from pr where same >= 2 and same >= 0.6 * n_both),
bs as (select *, row_number() over (partition by file_id, old order by same / n_both desc, same desc, old, new) as ro, row_number() over (partition by file_id, new order by same / n_both desc, same desc, old, new) as rn from ok),
ren as (select file_id, old, new from bs where ro = 1 and rn = 1)
select d.file_id, case when ren.new is not null then 'renamed' when ok is null then 'added' when nk is null then 'removed' else 'retyped' end as change_kind, d.field, coalesce(ren.new, '') as new_field
from d left join ren on d.file_id = ren.file_id and d.field = ren.old where not exists (select 1 from ren x where x.file_id = d.file_id and x.new = d.field)
""",
    "p6_found": f"""
with si(unit, si_units, scale, off) as (values {_UNITS}), sp(t, unit) as (values {_SPELLED}), tab as (select unit, si_units, scale from si union all select sp.t, si_units, scale from sp join si using (unit)),
c as (select rec_id, gain, [units, misc['Sensitivity'], misc['gain_units'], misc['unit']] || coalesce(list_transform(notes, lambda n: coalesce(nullif(regexp_extract(n, '(?i)calibrated per\\s+(.+?)(?:,.*|\\.?)$', 1), ''), nullif(regexp_extract(n, '(?i)amplitudes? of this channel (?:is|are) in\\s+(.+?)(?: after unscaling)?\\.?$', 1), ''),
       nullif(regexp_extract(n, '(?i)gain refers to (?:one|1|an?)\\s+(.+?)\\.?$', 1), ''), nullif(regexp_extract(n, '(?i)\\bone\\s+(.+?)\\s+gives the stated number of counts', 1), ''), case when regexp_matches(n, '(?i)counts') then n end)), []) || [resp.i] as cand from channels where gain > 0 and gain <> 1 and not isnan(gain) and gain < 1e300),
u as (select rec_id, gain, generate_subscripts(cand, 1) as k, unnest(cand) as t from c),
v as (select rec_id, gain, k, coalesce(nullif(regexp_extract(t, '(?i)(?:counts?|cts)\\s*(?:/|per)\\s*\\(?\\s*([^()]+?)\\s*\\)?\\s*\\.?$', 1), ''), t) as t from u where t is not null),
w as (select rec_id, gain, k, {_UNIT_SQL} as t from v),
g as (select w.rec_id, w.gain, arg_min(tab.si_units, k) as si_units, arg_min(tab.scale, k) as scale from w join tab on tab.unit = w.t group by w.rec_id, w.gain),
f as (select rec_id, resp.f0 as f0, lower(coalesce(nullif(trim(resp.fu), ''), nullif(trim(resp.descr), ''), 'hz')) as said from channels where len(resp.p) > 0 and resp.f0 > 0 and not isnan(resp.f0) and resp.f0 < 1e300)
select rec_id, 'gain' as what, si_units, cast(round(gain / scale) as bigint) as si_value from g
union all select rec_id, 'f0', 'Hz', cast(round(1000 * case when regexp_matches(said, 'rad|angular') then f0 * (1 / (2 * pi())) when said like '%mhz%' then f0 * 0.001 when said like '%hz%' then f0 when regexp_matches(said, '^s$|^secs?$|second|period') then 1 / f0 else f0 end) as bigint) from f
""",
}
