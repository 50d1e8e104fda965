"""Queries for the time-series operators, each with the same question in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite import model, timeaxis
from tremolite.functions import ids, scalar
from tremolite.model import DAY, HOUR
from tremolite.operators import dsp, lineage, merge, process, quake, select, synth
from tremolite.plans import sqlapi
from tremolite.session import load, shared_folder
from tremolite.sources import formats
from tremolite.streaming import packets

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL side.
EV = "with ev as (select event_type as id, epoch_us(ts) // 3600000000 * 3600000000 as t_us, sum(value) as x from events group by 1, 2)"
GAPPED = EV + ", lg as (select *, t_us - lag(t_us) over (partition by id order by t_us) - 3600000000 as dev from ev), sg as (select id, t_us, x, cast(sum(case when abs(dev) > 1800000000 then 1 else 0 end) over (partition by id order by t_us rows unbounded preceding) as bigint) as seg from lg)"
NAN = ", nn as (select id, seg, t_us, case when (t_us // 3600000000) % 17 = 0 then 'nan'::double else x end as x from sg)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return model.ev_hour(load(spark, d, "events"))


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return timeaxis.segments_of_samples(_ev(spark, d), ["id"], "t_us", HOUR)


def _nan(df: DataFrame) -> DataFrame:
    """Missing samples, the same on either side: every 17th hour since the epoch."""
    return df.withColumn("x", F.when(F.pmod(F.expr("t_us div 3600000000"), F.lit(17)) == 0, float("nan")).otherwise(F.col("x")))


def _r(c: str = "x", n: int = 6):
    return F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), n).alias(c)


# --- time axis


@query(GAPPED + """, g as (select id, min(t_us) as a, max(t_us) as z, avg(x) as mu from ev group by id),
grid as (select id, unnest(generate_series(a, z, 3600000000)) as t_us, mu from g),
f as (select grid.id, grid.t_us, coalesce(ev.x, mu) as x, ev.x is null as filled from grid left join ev on ev.id = grid.id and ev.t_us = grid.t_us),
m as (select id, avg(x) as mm, cast(sum(filled::int) as bigint) as n_filled from f group by id)
select s.id, s.seg, min(t_us) as start_us, max(t_us) as end_us, count(*) as n, round(avg(x) - any_value(mm), 6) as mean_x, any_value(n_filled) as n_filled from sg s join m on s.id = m.id group by s.id, s.seg""")
def flagship_segments(spark, d):
    """Contiguous segments per event type on the hourly grid, around the mean of the gap-filled channel."""
    e = _ev(spark, d)
    full = process.ungap(e, ["id"], HOUR)
    m = full.groupBy("id").agg(F.avg("x").alias("mm"), F.sum(F.col("filled").cast("long")).alias("n_filled"))
    s = process.summary(e, ["id"], HOUR)
    return s.join(m, "id").select("id", "seg", "start_us", "end_us", "n", F.round(F.col("mean_x") - F.col("mm"), 6).alias("mean_x"), "n_filled")


@query(GAPPED + " select id, seg, min(t_us) as start_us, max(t_us) as end_us, count(*) as n from sg group by id, seg")
def gap_segments(spark, d):
    return timeaxis.segment_table(_ev(spark, d), ["id"], "t_us", HOUR)


@query(EV + ", lg as (select *, t_us - lag(t_us) over (partition by id order by t_us) as dt, row_number() over (partition by id order by t_us) as i, count(*) over (partition by id) as n from ev) select id, i, case when i = 1 then t_us when dt <> 3600000000 then dt - 3600000000 else 0 end as us from lg where i = 1 or i = n or dt <> 3600000000")
def t_collapse(spark, d):
    """Sample times to time-matrix rows: the first, every deviation, the last."""
    return timeaxis.collapse(_ev(spark, d), ["id"], "t_us", HOUR)


WIN = """with m as (select tr_id, id, cast(round_even(1e6 / fs, 0) as bigint) as d, t from traces where fs > 0 and len(t) > 0),
r as (select tr_id, id, d, generate_subscripts(t, 1) as k, len(t) as n, unnest(t) as u from m),
q as (select tr_id, id, d, k, n, u.i as i, u.us as us, sum(u.us) over (partition by tr_id order by k rows unbounded preceding) as g from r),
s as (select tr_id, id, d, i as i0, cast(g as bigint) + (i - 1) * d as t0_us, k, lead(i) over (partition by tr_id order by k) as nx, max(i) over (partition by tr_id) as li from (select * from q where k < n or us <> 0 or n = 1)),
l as (select tr_id, max(i) as last_i from q group by tr_id),
w as (select s.tr_id, s.id, s.d, row_number() over (partition by s.tr_id order by k) - 1 as seg, i0, coalesce(nx - 1, last_i) as i1, t0_us from s join l using (tr_id)),
win as (select tr_id, id, d, seg, i0, i1, t0_us, t0_us + (i1 - i0) * d as t1_us from w where i1 >= i0)"""


@query(WIN + " select tr_id, seg, i0, i1, t0_us, t1_us from win")
def t_win(spark, d):
    """Windows and sample indices of every time matrix (t_win, x_inds)."""
    return timeaxis.windows(load(spark, d, "traces"), ["tr_id"]).select("tr_id", "seg", "i0", "i1", "t0_us", "t1_us")


@query(WIN + ", e as (select tr_id, seg, i0 + unnest(generate_series(0, i1 - i0)) as i, t0_us, i0, d from win) select tr_id, count(*) as n, cast(sum((t0_us + (i - i0) * d) % 1000003) as bigint) as check_sum, max(t0_us + (i - i0) * d) as last_us from e group by tr_id")
def t_expand(spark, d):
    """Sample times of every time matrix, as counts and check sums."""
    e = timeaxis.expand(timeaxis.windows(load(spark, d, "traces"), ["tr_id"]), ["tr_id"])
    return e.groupBy("tr_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t_us") % 1000003).alias("check_sum"), F.max("t_us").alias("last_us"))


@query(WIN + " select tr_id, min(t0_us) as start_us, max(t1_us) as end_us from win group by tr_id")
def endtime_starttime(spark, d):
    return timeaxis.bounds(timeaxis.windows(load(spark, d, "traces"), ["tr_id"]), ["tr_id"])


@query(WIN + " select id, max(i1 - i0 + 1) as nx_max from win group by id")
def nx_max(spark, d):
    """Longest contiguous segment of each channel."""
    w = timeaxis.windows(load(spark, d, "traces"), ["id"])
    return w.groupBy("id").agg(F.max(F.col("i1") - F.col("i0") + 1).alias("nx_max"))


@query("select tr_id, greatest(0, len(t) - 2 + case when t[len(t)].us <> 0 then 1 else 0 end) as n, len(t) = 2 and t[1].i = 1 and t[1].us > 1 and t[2].us = 0 as gapless from traces where fs > 0 and len(t) > 1")
def ngaps(spark, d):
    """Number of gaps of a time matrix, and whether it is gapless."""
    t = load(spark, d, "traces").where("fs > 0 and size(t) > 1")
    last = F.element_at("t", -1)
    return t.select("tr_id", F.greatest(F.lit(0), F.size("t") - 2 + F.when(last["us"] != 0, 1).otherwise(0)).cast("long").alias("n"), ((F.size("t") == 2) & (F.col("t")[0]["i"] == 1) & (F.col("t")[0]["us"] > 1) & (last["us"] == 0)).alias("gapless"))


@query("""with x as (select tr_id, id, fs, nx, t, src from traces), r as (select id, fs, nx, len(t) as rows from x)
select id, cast(sum(nx) as bigint) as npts, cast(sum(greatest(0, coalesce(rows, 0) - 2)) as bigint) as ngaps, count(distinct fs) as nfs from r group by id""")
def scan_npts_ngaps_nfs(spark, d):
    """Samples, gaps and distinct rates per channel without reading samples."""
    t = load(spark, d, "traces").select("id", "fs", "nx", F.coalesce(F.size("t"), F.lit(0)).alias("rows"))
    return t.groupBy("id").agg(F.sum("nx").alias("npts"), F.sum(F.greatest(F.lit(0), F.col("rows") - 2)).alias("ngaps"), F.countDistinct("fs").alias("nfs"))


# --- processing


@query(GAPPED + NAN + ", m as (select id, avg(x) filter (not isnan(x)) as mu from nn group by id) select nn.id, t_us, round(case when isnan(x) then null else x - mu end, 6) as x from nn join m using (id)")
def demean(spark, d):
    return process.demean(_nan(_ev(spark, d)), ["id"]).select("id", "t_us", _r())


@query(GAPPED + NAN + ", m as (select id, avg(x) filter (not isnan(x)) as mu from nn group by id) select nn.id, t_us, round(case when isnan(x) then mu else x end, 6) as x from nn join m using (id)")
def nanfill(spark, d):
    return process.nanfill(_nan(_ev(spark, d)), ["id"]).select("id", "t_us", _r())


@query(GAPPED + NAN + """, a as (select id, min(t_us) as t0 from nn group by id), s as (select id, t_us, x, (t_us - t0) / 1e6 as s from nn join a using (id)),
f as (select id, regr_slope(x, s) filter (not isnan(x)) as b, regr_intercept(x, s) filter (not isnan(x)) as c from s group by id)
select id, t_us, round(case when isnan(x) then null else x - c - b * s end, 4) as x from s join f using (id)""")
def detrend_linear(spark, d):
    return process.detrend(_nan(_ev(spark, d)), ["id"]).select("id", "t_us", _r("x", 4))


UNGAP = EV + ", g as (select id, min(t_us) as a, max(t_us) as z, avg(x) as mu from ev group by id), grid as (select id, unnest(generate_series(a, z, 3600000000)) as t_us, mu from g)"


@query(UNGAP + " select grid.id, grid.t_us, round(coalesce(ev.x, mu), 6) as x from grid left join ev on ev.id = grid.id and ev.t_us = grid.t_us")
def ungap_mean(spark, d):
    return process.ungap(_ev(spark, d), ["id"], HOUR).select("id", "t_us", _r())


@query(UNGAP + " select grid.id, grid.t_us, round(ev.x, 6) as x from grid left join ev on ev.id = grid.id and ev.t_us = grid.t_us")
def ungap_nan(spark, d):
    return process.ungap(_ev(spark, d), ["id"], HOUR, mean=False).select("id", "t_us", _r())


@query(GAPPED + """, m as (select id, avg(x) as mu from sg group by id), n as (select *, count(*) over (partition by id, seg) as n, row_number() over (partition by id, seg order by t_us) as i from sg),
l as (select n.*, mu, least(round_even(40.0, 0), round_even(0.2 * n, 0)) as l, least(i, n - i + 1) as k from n join m using (id))
select id, t_us, round((x - mu) * case when n >= 10 and k <= l then 0.5 * (1 - cos(pi() * (k - 1) / l)) else 1 end + mu, 6) as x from l""")
def taper_cosine(spark, d):
    return process.taper(_seg(spark, d), ["id"], 1.0, t_max=40.0, alpha=0.2).select("id", "t_us", _r())


@query(GAPPED + " select id, t_us, round(coalesce(x - lag(x) over (partition by id, seg order by t_us), x) * 2.0, 6) as x from sg")
def diff_x(spark, d):
    return process.differentiate(_seg(spark, d), ["id"], 2.0).select("id", "t_us", _r())


@query(GAPPED + " select id, t_us, round(sum(x) over (partition by id, seg order by t_us rows unbounded preceding) / 2.0, 5) as x from sg")
def int_x(spark, d):
    return process.integrate(_seg(spark, d), ["id"], 2.0).select("id", "t_us", _r("x", 5))


@query(GAPPED + """, a as (select id, seg, t_us - 250000 as t_us, coalesce(x - lag(x) over (partition by id, seg order by t_us), x) * 2.0 as x from sg),
b as (select id, seg, t_us - 250000 as t_us, coalesce(x - lag(x) over (partition by id, seg order by t_us), x) * 2.0 as x from a) select id, t_us, round(x, 5) as x from b""")
def convert_units(spark, d):
    """M to m/s2 at 2 Hz."""
    return process.convert_seismic(_seg(spark, d), ["id"], "m", "m/s2", 2.0).select("id", "t_us", _r("x", 5))


@query("with s as (select event_type as id, epoch_us(ts) as t_us, value as x, 1.0 + event_id % 7 as gain, event_id from events) select event_id, id, t_us, round(x / gain, 6) as x, 1.0::double as gain from s")
def unscale(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("id"), model.us("ts").alias("t_us"), F.col("value").alias("x"), (F.lit(1.0) + F.col("event_id") % 7).alias("gain"))
    return process.unscale(e).select("event_id", "id", "t_us", _r(), "gain")


@query("""with g as (select n_name as id, min_by(s_acctbal, s_suppkey) as g from supplier join nation on s_nationkey = n_nationkey group by n_name)
select c_custkey as ch, n_name as id, round(c_acctbal * coalesce(g, 2.0) / 2.0, 4) as x, round(coalesce(g, 2.0), 4) as gain from customer join nation on c_nationkey = n_nationkey left join g on g.id = n_name""")
def rescale_by_src(spark, d):
    """Gains of the first source channel of the same id."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("id"))
    t = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("k")).select(F.col("c_custkey").alias("ch"), "id", F.col("c_acctbal").alias("x"), F.lit(2.0).alias("gain"))
    s = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("k")).select(F.col("s_suppkey").alias("ch"), "id", F.col("s_acctbal").alias("gain"))
    return process.rescale_from(t, s).select("ch", "id", _r("x", 4), F.round("gain", 4).alias("gain"))


DAYS = "with dd as (select l_returnflag || l_linestatus as id, epoch_us(l_shipdate) // 86400000000 * 86400000000 as t_us, sum(l_quantity) as x from lineitem group by 1, 2), b as (select id, min(t_us) as a, max(t_us) as z, avg(x) as mu from dd group by id)"


@query(DAYS + ", l as (select max(a) as t0 from b) select id, t_us, round(x, 4) as x from dd, l where t_us >= t0")
def sync_last_none(spark, d):
    return process.sync(model.ship_day(load(spark, d, "lineitem")), ["id"], DAY, "last", "none").select("id", "t_us", _r("x", 4))


@query(DAYS + """, l as (select min(a) as t0, max(z) as t1 from b), p as (select id, unnest(generate_series(1, greatest(0, (a - t0) // 86400000000))) as k, a, mu from b, l), q as (select id, unnest(generate_series(1, greatest(0, (t1 - z) // 86400000000))) as k, z, mu from b, l)
select id, t_us, round(x, 4) as x from dd union all select id, a - k * 86400000000, round(mu, 4) from p union all select id, z + k * 86400000000, round(mu, 4) from q""")
def sync_first_last_pad(spark, d):
    return process.sync(model.ship_day(load(spark, d, "lineitem")), ["id"], DAY, "first", "last", pad=True).select("id", "t_us", _r("x", 4))


@query(EV + """, o as (select id, t_us, x from ev where (t_us // 3600000000) % 3 <> 0), p as (select id, t_us, x + 1 as x from ev where (t_us // 3600000000) % 3 <> 1)
select id, t_us, round(avg(x), 6) as x from (select * from o union all select * from p) group by id, t_us""")
def merge_overlap_avg(spark, d):
    """Two overlapping versions of a channel, averaged where both have a sample."""
    e, k = _ev(spark, d), F.pmod(F.expr("t_us div 3600000000"), F.lit(3))
    return process.merge_overlap(e.where(k != 0), e.where(k != 1).withColumn("x", F.col("x") + 1), ["id"]).select("id", "t_us", _r())


@query("with r as (select id, t as t_us, x from readings where x is not null and not isnan(x)), a as (select * from r where t_us % 4 <> 0), b as (select * from r where t_us % 4 <> 1) select id, t_us, x + 0.0 as x from a union select id, t_us, x + 0.0 from b")
def merge_irregular(spark, d):
    """Set union of the (time, value) pairs of two irregular versions."""
    r = load(spark, d, "readings").where("x is not null and not isnan(x)").select("id", F.col("t").alias("t_us"), "x")
    m = F.pmod("t_us", F.lit(4))
    return process.merge_irregular(r.where(m != 0), r.where(m != 1), ["id"]).select("id", "t_us", (F.col("x") + 0.0).alias("x"))


@query("""with r as (select id, run_id, t as t_us, x from readings where x is not null and not isnan(x)), l as (select *, case when t_us - lag(t_us) over (partition by id, run_id order by t_us, x) < 500 then 0 else 1 end as n from r),
g as (select *, sum(n) over (partition by id, run_id order by t_us, x rows unbounded preceding) as g from l), m as (select id, run_id, min(t_us) as t_us, avg(x) as x, count(*) as n from g group by id, run_id, g having count(*) > 1)
select id, run_id, t_us, case when isinf(x) then x else cast(printf('%.8e', x) as double) end as x, n from m""")
def near_duplicates(spark, d):
    """Samples less than half a step (1 ms) apart become one; means to nine digits."""
    r = load(spark, d, "readings").where("x is not null and not isnan(x)").select("id", "run_id", F.col("t").alias("t_us"), "x")
    m = process.merge_near(r, ["id", "run_id"], 1000).where("n > 1")
    return m.withColumn("x", F.when(F.abs("x") == float("inf"), F.col("x")).otherwise(F.format_string("%.8e", "x").cast("double"))).select("id", "run_id", "t_us", "x", "n")


@query("select id, run_id, t, x, max(rd_id) as rd_id from readings where x is not null and not isnan(x) group by id, run_id, t, x having count(*) > 1")
def purge_dups(spark, d):
    """Rows sent twice; the last of each set is kept (NaN equals nothing)."""
    r = load(spark, d, "readings").where("x is not null and not isnan(x)")
    return r.groupBy("id", "run_id", "t", "x").agg(F.max("rd_id").alias("rd_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


# --- selection, matching, set operations

CH = "with c as (select rec_id as ch, regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '\\1\\2'), '_-/', '...'), '\\s+', '', 'g') as id, fs, gain, units, src from channels)"


def _ch(spark, d):
    return load(spark, d, "channels").select(F.col("rec_id").alias("ch"), ids.canonical_id("id").alias("id"), "fs", "gain", "units", "src", "misc", "updated")


@query(CH + " select ch, id, split_part(id, '.', 1) as net, split_part(id, '.', 2) as sta, split_part(id, '.', 3) as loc, split_part(id, '.', 4) as cha, substr(split_part(id, '.', 4), 2, 1) as inst from c where id is not null")
def split_id(spark, d):
    """the codes of canonical ids and the instrument code."""
    c = _ch(spark, d).where("id is not null").withColumn("p", ids.split_id("id"))
    return c.select("ch", "id", *[F.col("p")[k].alias(n) for k, n in enumerate(("net", "sta", "loc", "cha"))], ids.inst_code("id").alias("inst"))


@query(CH + " select ch, id from c where substr(split_part(id, '.', 4), 2, 1) in ('H','J','L','M','N','P','Z')")
def seismic_channels(spark, d):
    """P12."""
    return select.seismic(_ch(spark, d)).select("ch", "id")


@query(CH + " select ch, id from c where regexp_matches(id, 'QX\\..*\\.BH.')")
def id_wildcard(spark, d):
    """QX.*.BH? as an unanchored pattern."""
    return select.wildcard(_ch(spark, d), "QX.*.BH?").select("ch", "id")


@query(CH + ", w as (select distinct id from traces union select 'XX.NONE..ZZZ'), f as (select id, min(ch) as ch from c group by id) select w.id, coalesce(f.ch, 0) as ch from w left join f on f.id = w.id")
def findid_first(spark, d):
    """First position of each wanted id, 0 if there is none."""
    w = load(spark, d, "traces").select("id").distinct().unionByName(spark.createDataFrame([("XX.NONE..ZZZ",)], "id string"))
    return select.find_ids(_ch(spark, d), w)


@query("select tr_id, id from traces where nx > 0 and coalesce(len(t), 0) > 0")
def prune(spark, d):
    """P11."""
    return select.prune(load(spark, d, "traces")).select("tr_id", "id")


@query("select tr_id, id, fs from traces where nx > 0 and fs > 0")
def mkchans(spark, d):
    """Channels with samples and a rate."""
    return select.usable(load(spark, d, "traces"), keep_irregular=False).select("tr_id", "id", "fs")


@query("select rd_id, t from readings where t between 1230768000000000 and 1230854400000000")
def time_range(spark, d):
    """One day of samples; the range reaches the Parquet scan."""
    return select.between(load(spark, d, "readings"), 1_230_768_000_000_000, 1_230_854_400_000_000, "t").select("rd_id", "t")


@query("""with c as (select rec_id as ch, regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '\\1\\2'), '_-/', '...'), '\\s+', '', 'g') as id, fs, gain, units, src, loc.lat as lat, loc.lon as lon, resp.f0 as f0 from channels),
k as (select *, dense_rank() over (order by id, fs, gain, units, lat, lon, f0) as g, case when src = 'NDC' then 'a' else 'b' end as side from c), n as (select g, min(ch) filter (side = 'a') as grp, count(*) filter (side = 'a') as na, count(*) filter (side = 'b') as nb from k group by g)
select side, ch, grp, case when side = 'a' then nb else na end as links from k join n using (g) where na > 0 and nb > 0""")
def channel_match(spark, d):
    """Records of one source and of all others that agree in id, rate, gain, units, place and corner (null equals null), as classes."""
    c = load(spark, d, "channels").select(F.col("rec_id").alias("ch"), ids.canonical_id("id").alias("id"), "fs", "gain", "units", "src", F.col("loc.lat").alias("lat"), F.col("loc.lon").alias("lon"), F.col("resp.f0").alias("f0"))
    return select.channel_match(c.where("src = 'NDC'"), c.where("not src <=> 'NDC'"), keys=("id", "fs", "gain", "units", "lat", "lon", "f0"))


@query(CH + """, u as (select ch, id, fs, case when lower(trim(units)) in ('', '?', 'see notes') then null else units end as units, src from c), a as (select id, fs, units, min(ch) as ch, count(*) as n from u where src = 'NDC' group by 1, 2, 3), b as (select id, fs, units, min(ch) as ch, count(*) as n from u where src = 'SXML' group by 1, 2, 3)
select a.id, a.ch, a.n, b.ch as ch_b, b.n as n_b, coalesce(a.fs, b.fs) as fs, coalesce(a.units, b.units) as units from a join b on a.id = b.id and (a.fs is null or b.fs is null or a.fs = b.fs) and (a.units is null or b.units is null or a.units = b.units)""")
def cmatch_wildcard(spark, d):
    """Two sources' header classes of one id that agree, unset matching anything; values filled both ways."""
    c = _ch(spark, d).withColumn("units", F.when(~F.lower(F.trim("units")).isin("", "?", "see notes"), F.col("units")))
    return select.match_unset(c.where("src = 'NDC'"), c.where("src = 'SXML'"), keys=("fs", "units"))


EPOCH = CH.replace(", fs, gain", ", epoch_us(updated) as u, fs, gain")


@query(EPOCH + """, e as (select ch, id, u as si, u + 30 * 86400000000 as ei from c), t as (select tr_id, id, t[1].us as ts, t[1].us + cast(nx * 1e6 / fs as bigint) as te from traces where fs > 0 and len(t) > 0 and nx > 0)
select tr_id, min(ch) as ch from t join e on t.id = e.id and si <= te + 100000000000000 and ei >= ts - 100000000000000 group by tr_id""")
def interval_header_join(spark, d):
    """Each trace with the first header of its id whose validity overlaps it (within 100,000,000 s)."""
    slack = 100_000_000_000_000
    t = load(spark, d, "traces").where("fs > 0 and size(t) > 0 and nx > 0")
    ts = F.col("t")[0]["us"]
    t = t.select("tr_id", "id", (ts - slack).alias("s1"), (ts + F.rint(F.col("nx") * 1e6 / F.col("fs")).cast("long") + slack).alias("e1"))
    e = _ch(spark, d).where("updated is not null").select("ch", "id", F.unix_micros("updated").alias("s2"), (F.unix_micros("updated") + 30 * DAY).alias("e2"))
    return select.interval_join(t, e, "id", ("s1", "e1"), ("s2", "e2"), slack).groupBy("tr_id").agg(F.min("ch").alias("ch"))


@query("""with o as (select o_orderkey, o_custkey, epoch_us(o_orderdate) as t from orders), e as (select c_custkey as k, 757382400000000 + (c_custkey % 900) * 86400000000 as ts, 757382400000000 + (c_custkey % 900 + 400) * 86400000000 as te from customer)
select o_orderkey, o_custkey from o join e on o_custkey = k and ts <= t and t <= te""")
def point_in_epoch_join(spark, d):
    """Events inside the epoch of their key's header."""
    base = 757_382_400_000_000
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", model.us("o_orderdate").alias("t")).withColumn("t2", F.col("t"))
    k = F.col("c_custkey") % 900
    e = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (base + k * DAY).alias("ts"), (base + (k + 400) * DAY).alias("te"))
    return select.interval_join(o, e, "o_custkey", ("t", "t2"), ("ts", "te"), 100 * DAY).select("o_orderkey", "o_custkey")


@query(CH + ", g as (select fs, units, min(ch) as grp, count(*) as members from c group by fs, units) select c.ch, grp, members from c join g on c.fs is not distinct from g.fs and c.units is not distinct from g.units")
def property_groups(spark, d):
    """A8."""
    return select.property_groups(_ch(spark, d), ["fs", "units"])


@query(CH + """, u as (select ch, id, fs, case when lower(trim(units)) in ('', '?', 'see notes') then null else units end as units from c where id is not null), h as (select id, fs, units, min(ch) as grp, (fs is not null)::int + (units is not null)::int as n from u group by id, fs, units),
b as (select a.id, a.fs, a.units, max_by(h.grp, h.n * 1000000000000 - h.grp) as grp from h a join h on a.id = h.id and (a.fs is null or a.fs is not distinct from h.fs) and (a.units is null or a.units is not distinct from h.units) group by a.id, a.fs, a.units)
select u.ch, u.id, b.grp from u join b on u.id = b.id and u.fs is not distinct from b.fs and u.units is not distinct from b.units""")
def merge_subgroups(spark, d):
    """Headers of one id grouped with unset as wildcard, the most specified first."""
    c = _ch(spark, d).where("id is not null").withColumn("units", F.when(~F.lower(F.trim("units")).isin("", "?", "see notes"), F.col("units")))
    return select.merge_groups(c)


@query("""with e as (select regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '\\1\\2'), '_-/', '...'), '\\s+', '', 'g') as id, rec_id, unnest(map_keys(misc)) as k, unnest(map_values(misc)) as v from channels where id is not null),
w as (select id, k, max_by(v, rec_id) as v from e group by id, k) select id, count(*) as n, string_agg(k || '=' || v, ';' order by k) as merged from w group by id""")
def map_merge(spark, d):
    """A10: one misc map per channel, the last record wins."""
    c = load(spark, d, "channels").select(ids.canonical_id("id").alias("id"), "rec_id", "misc").where("id is not null")
    m = select.merge_maps(c, ["id"], "misc", "rec_id")
    return m.select("id", F.size("misc").cast("long").alias("n"), F.array_join(F.transform(F.map_entries("misc"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query(WIN + ", e as (select id, tr_id, max(t1_us) as te from win group by id, tr_id), rk as (select *, row_number() over (partition by id order by te desc, tr_id desc) as k from e) select id, tr_id, te from rk where k = 1")
def latest_end(spark, d):
    """The trace with each channel's latest end, of equal ends that of the highest number."""
    e = timeaxis.windows(load(spark, d, "traces"), ["id", "tr_id"])
    return e.groupBy("id").agg(F.max(F.struct(F.col("t1_us").alias("te"), "tr_id")).alias("m")).select("id", "m.tr_id", "m.te")


@query("select event_id, abs(epoch_us(ts) - 1704067200000000) as away from events order by 2, 1 limit 10")
def nearest_events_topk(spark, d):
    """The ten events nearest to a time."""
    e = load(spark, d, "events").select("event_id", model.us("ts").alias("ot_us"))
    return select.nearest(e, 1_704_067_200_000_000, 10).select("event_id", F.abs(F.col("ot_us") - 1_704_067_200_000_000).alias("away"))


@query("with q as (select distinct c_mktsegment as seg, n_name as what from customer join nation on c_nationkey = n_nationkey) select seg, string_agg(what, ',' order by what) as what from q group by seg")
def compact_requests(spark, d):
    """Requests that differ in one column only become one."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("what"))
    return select.compact_requests(load(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_mktsegment").alias("seg"), "what"), "what", ["seg"])


# --- scalar functions


@query("""with c as (select rec_id, fs / power(10, rec_id % 9) as fs from channels) select rec_id, case when fs >= 1000 then 'G' when fs >= 250 then 'C' when fs >= 80 then 'E' when fs >= 10 then 'S' when fs > 1 then 'M' when fs > 0.1 then 'L' when fs > 0.01 then 'V' when fs > 0.001 then 'U' when fs > 0.0001 then 'R' when fs > 0.00001 then 'P' when fs > 0.000001 then 'T' when fs is not null then 'Q' end as short,
case when fs >= 1000 then 'F' when fs >= 250 then 'D' when fs >= 80 then 'H' when fs >= 10 then 'B' when fs > 1 then 'M' when fs > 0.1 then 'L' when fs > 0.01 then 'V' when fs > 0.001 then 'U' when fs > 0.0001 then 'R' when fs > 0.00001 then 'P' when fs > 0.000001 then 'T' when fs is not null then 'Q' end as broad from c""")
def bandcode(spark, d):
    """letters of rates from 1000 Hz down to a millionth, and below."""
    c = load(spark, d, "channels").select("rec_id", (F.col("fs") / F.pow(F.lit(10.0), F.col("rec_id") % 9)).alias("fs"))
    return c.select("rec_id", scalar.bandcode("fs").alias("short"), scalar.bandcode("fs", 0.05).alias("broad"))


@query("""select event_id, year(ts) as y, dayofyear(ts) as j, month(ts) as m, day(ts) as dm, epoch_us(ts) as us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as s from events""")
def julian_day(spark, d):
    """Day of year and month/day, time fields and back, time text and back."""
    e = load(spark, d, "events").select("event_id", model.us("ts").alias("us"))
    e = e.withColumn("a", scalar.t_arr("us")).withColumn("md", scalar.j2md(F.col("a")[0], F.col("a")[1]))
    back = scalar.mktime(F.col("a")[0], F.col("a")[1], F.col("a")[2], F.col("a")[3], F.col("a")[4], F.pmod(F.col("us"), F.lit(1_000_000)))
    return e.select("event_id", F.col("a")[0].alias("y"), scalar.md2j(F.col("a")[0], "md.m", "md.d").alias("j"), "md.m", F.col("md.d").alias("dm"), F.when(back == scalar.tstr2int(scalar.int2tstr("us")), back).alias("us"), scalar.int2tstr("us").alias("s"))


_STRICT = "[\\x00-\\x1f !\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^`{|}~\\x7f]"


@query(f"select rec_id, regexp_replace(coalesce(name, ''), '{_STRICT}', '', 'g') as strict, regexp_replace(coalesce(name, ''), '[\\x00-\\x1f.\\x7f]', '', 'g') as seed from channels")
def namestrip(spark, d):
    """F12."""
    n = F.coalesce("name", F.lit(""))
    return load(spark, d, "channels").select("rec_id", scalar.namestrip(n, "Strict").alias("strict"), scalar.namestrip(n, "SEED").alias("seed"))


@query("""with c as (select rec_id, tan(radians(loc.lat)) as ta, loc.lat as lat, loc.lon as lon from channels where loc.lat between -90 and 90 and loc.lon between -180 and 180), s as (select r_name as source, -60.0 + 25.5 * r_regionkey as la, -170.0 + 71.25 * r_regionkey as lo from region),
p as (select rec_id, source, atan(ta * 0.9933056) as p2, radians(lon) as l2, atan(tan(radians(la)) * 0.9933056) as p1, radians(lo) as l1 from c, s),
h as (select *, power(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * power(sin((l2 - l1) / 2), 2) as h, atan2(sin(l2 - l1) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(l2 - l1)) as az, atan2(sin(l1 - l2) * cos(p1), cos(p2) * sin(p1) - sin(p2) * cos(p1) * cos(l1 - l2)) as baz from p)
select rec_id, source, round(degrees(2 * asin(least(1.0, sqrt(h)))), 5) as dist, round(degrees(case when az < 0 then az + 2 * pi() else az end), 5) as az, round(degrees(case when baz < 0 then baz + 2 * pi() else baz end), 5) as baz from h""")
def gcdist(spark, d):
    """Distance and azimuths from several sources to every channel with a point on Earth."""
    c = load(spark, d, "channels").where("loc.lat between -90 and 90 and loc.lon between -180 and 180").select("rec_id", "loc")
    s = [(r["r_name"], -60.0 + 25.5 * r["r_regionkey"], -170.0 + 71.25 * r["r_regionkey"]) for r in load(spark, d, "region").collect()]
    return quake.source_receiver(s, c).select("rec_id", "source", *[F.round(k, 5).alias(k) for k in ("dist", "az", "baz")])


@query("select rec_id, round(2 * pi() * resp.f0 * -sqrt(0.5), 6) as re, round(2 * pi() * resp.f0 * sqrt(0.5), 6) as im, round(resp.f0, 6) as fc from channels where resp.f0 > 0 and not isnan(resp.f0)")
def fctoresp(spark, d):
    """Response of a corner frequency, and the corner of that response."""
    c = load(spark, d, "channels").where("resp.f0 > 0 and not isnan(resp.f0)").select("rec_id", scalar.fctoresp("resp.f0").alias("p"))
    return c.select("rec_id", F.round(F.col("p")[0]["re"], 6).alias("re"), F.round(F.col("p")[0]["im"], 6).alias("im"), F.round(scalar.resptofc("p"), 6).alias("fc"))


@query("""with c as (select rec_id, 2 * pi() * resp.f0 as w, resp.p as p, resp.z as z from channels where resp.f0 > 0 and not isnan(resp.f0) and len(resp.p) > 0)
select rec_id, round(ln(list_product(list_transform(p, lambda q: sqrt(q.re * q.re + power(w - q.im, 2)))) / coalesce(list_product(list_transform(z, lambda q: sqrt(q.re * q.re + power(w - q.im, 2)))), 1)), 6) as ln_a0 from c""")
def resp_a0(spark, d):
    """normalisation of poles and zeros at f0."""
    c = load(spark, d, "channels").where("resp.f0 > 0 and not isnan(resp.f0) and size(resp.p) > 0")
    return c.select("rec_id", F.round(F.log(scalar.resp_a0("resp.p", "resp.z", "resp.f0")), 6).alias("ln_a0"))


@query("with e as (select vec_id, embedding[1]::double as x, list_transform(embedding[2:5], lambda v: v::double) as c from embeddings) select vec_id, round(((c[1] * x + c[2]) * x + c[3]) * x + c[4], 6) as y from e")
def polyval(spark, d):
    """Horner's rule."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(scalar.polyval(F.slice("e", 2, 4), F.col("e")[0]), 6).alias("y"))


@query("select l_orderkey, l_linenumber, l_quantity * case when l_linenumber % 3 = 0 then 1.0 / 10 when l_linenumber % 3 = 1 then 10 else 1 end as v, upper(lpad(case when l_linenumber < 10 then l_linenumber::varchar else '' end, 2, '0')) as lc from lineitem")
def header_scaling(spark, d):
    """header coordinates with their scalar, location codes in base 36."""
    s = F.when(F.col("l_linenumber") % 3 == 0, -10).when(F.col("l_linenumber") % 3 == 1, 10).otherwise(0)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.scaled_coord("l_quantity", s).alias("v"), scalar.mk_lc("l_linenumber").alias("lc"))



# --- whole-segment processing


@query("""with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
h as (select a.vec_id, a.i, any_value(a.x) as x, sum(case when (a.i - b.i) % 2 <> 0 then b.x * 2.0 / 64 / tan(pi() * (a.i - b.i) / 64) else 0 end) as y from e a join e b on a.vec_id = b.vec_id group by a.vec_id, a.i)
select vec_id, i, round(sqrt(x * x + y * y), 5) as env from h""")
def env_hilbert(spark, d):
    """V7: envelopes of the embeddings as 64-sample segments."""
    e = dsp.envelope_traces(model.emb(load(spark, d, "embeddings")))
    return e.select(F.col("id").alias("vec_id"), F.posexplode("x").alias("i", "env")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("env", 5).alias("env"))


@query()
def filtfilt_bandpass(spark, d):
    """V6: zero-phase band-pass of the embeddings at 1 Hz."""
    return dsp.filtfilt_traces(model.emb(load(spark, d, "embeddings")), fl=0.05, fh=0.2).select("id", "t0_us", "fs", "x")


@query()
def resample_half(spark, d):
    """V8."""
    return dsp.resample_traces(model.emb(load(spark, d, "embeddings")), 0.5).select("id", "t0_us", "fs", F.size("x").cast("long").alias("n"), "x")


@query()
def remove_resp(spark, d):
    """A damped oscillator's response taken off the embeddings."""
    one = F.struct(F.lit(1.0).alias("a0"), scalar.fctoresp(F.lit(0.05)).alias("p"), F.array(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))).alias("z"))
    e = model.emb(load(spark, d, "embeddings")).withColumn("resp", one)
    return dsp.translate_traces(e).select("id", "t0_us", "fs", "x")


@query("""with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as t, unnest(embedding)::double as x from embeddings), f as (select vec_id, regr_slope(x, t - 31.5) as b, avg(x) as a from e group by vec_id)
select vec_id, t as i, round(x - a - b * (t - 31.5), 5) as x from e join f using (vec_id)""")
def detrend_segments(spark, d):
    """V2: polynomial of order 1 off whole segments (order n by the same kernel)."""
    e = dsp.apply_segments(model.emb(load(spark, d, "embeddings")), lambda x, _: dsp.detrend_poly(x, 1))
    return e.select(F.col("id").alias("vec_id"), F.posexplode("x").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


# --- streams, lineage, synthetic data


@query("""with p as (select id, tr_id as ord, t[1].us as t0, nx as n, cast(round_even(1e6 / fs, 0) as bigint) as d from traces where fs > 0 and len(t) > 0 and nx > 0), e as (select *, t0 + (n - 1) * d as t1 from p),
g as (select *, t0 - lag(t1) over (partition by id order by ord) - d as gap from e), s as (select *, case when gap is null or abs(gap) > d // 2 then 1 else 0 end as new from g)
select id, cast(sum(new) over w as bigint) - 1 as seg, cast(sum(n) over w as bigint) - n as i0, t0 as t0_us, t1 as t1_us, n, case when new = 1 and gap is not null then gap else 0 end as gap_us from s window w as (partition by id order by ord rows unbounded preceding)""")
def packet_segments(spark, d):
    """Packets appended to their channels in order of arrival, as the stream operator does."""
    t = load(spark, d, "traces").where("fs > 0 and size(t) > 0 and nx > 0")
    p = t.select("id", F.col("tr_id").alias("ord"), F.col("t")[0]["us"].alias("t0_us"), F.col("nx").alias("n"), timeaxis.delta_us("fs").alias("dt_us"))
    return packets.segments_batch(p)


@query("select id, max(epoch_us(arrived)) as end_us from traces where arrived is not null group by id having max(epoch_us(arrived)) > (select max(epoch_us(arrived)) from traces) - 3600000000")
def live_streams(spark, d):
    """Channels whose last packet came within an hour of the latest one."""
    s = load(spark, d, "traces").groupBy("id").agg(F.max(F.unix_micros("arrived")).alias("end_us"))
    last = F.broadcast(s.agg(F.max("end_us").alias("now")))
    return s.join(last, F.col("end_us") > F.col("now") - 3_600_000_000).select("id", "end_us")


@query("with n as (select rec_id as ch, unnest(notes) as note from channels) select note, count(*) as n, count(distinct ch) as channels from n group by note")
def notes_by_text(spark, d):
    """Notes of channel records, parsed and counted."""
    n = lineage.parse(load(spark, d, "channels").select(F.col("rec_id").alias("ch"), F.explode("notes").alias("note")))
    return n.groupBy(F.col("descr").alias("note")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ch").alias("channels"))


@query()
def synthetic_traces(spark, d):
    """2.16: random channels with gaps, as many as nations."""
    n = load(spark, d, "nation").count()
    return synth.traces(synth.channels(spark, n), 60, 0).select("ch", "seg", "t0_us", "dt_us", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("sum_x"))


@query("select r.id, s.src, max(s.title) as title, count(*) as n from runs r left join sources s on r.src = s.src group by r.id, s.src")
def station_lookup(spark, d):
    """A small station table looked up."""
    r = load(spark, d, "runs").join(F.broadcast(load(spark, d, "sources")), "src", "left")
    return r.groupBy("id", F.when(F.col("title").isNotNull(), F.col("src")).alias("src")).agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("n"))


# --- files: encoded and decoded again on the executors

_FILE_SQL = "select vec_id, 64 as n, cast(sum(v) as bigint) as total, cast(sum(v * i) as bigint) as weighted from (select vec_id, cast(round(v * 1000) as bigint) as v, i from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)) group by vec_id"


def _roundtrip(spark, d: str, write, read) -> DataFrame:
    """Embeddings in thousandths as 64-sample channels through a file format and back: samples, sum, weighted sum."""
    e = load(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v * 1000)).alias("x"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for k, x in zip(b["vec_id"], b["x"]):
                p = formats.piece(id="XX.EMB.00.BHZ", fs=32.0, t0_us=1_577_836_800_000_000, x=x, misc={"hex_id": "0001"})
                y = np.rint(np.concatenate([q["x"] for q in read(write(p))])).astype(int)
                rows.append((k, len(y), int(y.sum()), int((y * np.arange(1, len(y) + 1)).sum())))
            yield pd.DataFrame(rows, columns=["vec_id", "n", "total", "weighted"])

    return e.mapInPandas(run, "vec_id bigint, n bigint, total bigint, weighted bigint")


def _file_query(name: str, write, read) -> None:
    def run(spark, d):
        return _roundtrip(spark, d, write, read)

    run.__name__ = f"file_{name}"
    query(_FILE_SQL)(run)


_file_query("mseed_steim1", lambda p: formats.mseed_write([p], 10), lambda b: formats.mseed_records(b))
_file_query("mseed_steim2", lambda p: formats.mseed_write([p], 11), lambda b: formats.mseed_records(b))
_file_query("mseed_int32", lambda p: formats.mseed_write([p], 3), lambda b: formats.mseed_records(b))
_file_query("sac", lambda p: formats.sac_write(p), lambda b: formats.sac_read(b))
_file_query("segy_ibm", lambda p: formats.segy_write([p], 1), lambda b: formats.segy_read(b))
_file_query("ah2", lambda p: formats.ah2_write(p), lambda b: formats.ah2_read(b))
_file_query("bottle", lambda p: formats.bottle_write(p), lambda b: formats.bottle_read(b, "B001.CH1"))
_file_query("win32", lambda p: formats.win32_write([p]), lambda b: formats.win32_read(b))
_file_query("suds", lambda p: formats.suds_write([p]), lambda b: formats.suds_read(b))
_file_query("uw", lambda p: formats.uw_write([p]), lambda b: formats.uw_read(b))
_file_query("tdms", lambda p: formats.tdms_write([p], 16), lambda b: formats.tdms_read(b))
_file_query("geocsv_pairs", lambda p: formats.geocsv_write(p), lambda b: formats.geocsv_read(b))
_file_query("geocsv_slist", lambda p: formats.geocsv_write(p, False), lambda b: formats.geocsv_read(b))
_file_query("slist", lambda p: formats.slist_write(p), lambda b: formats.slist_read(b))


@query(SQL["packet_segments"])
def stream_append_equals_batch(spark, d):
    """T4: the packets as a stream with state per channel; its rows land in a Parquet folder that is read back."""
    import uuid

    src = load(spark, d, "traces")
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    t = spark.readStream.schema(src.schema).parquet(f"{d}/traces.parquet*").where("fs > 0 and size(t) > 0 and nx > 0")
    p = t.select("id", F.col("tr_id").alias("ord"), F.col("t")[0]["us"].alias("t0_us"), F.col("nx").alias("n"), timeaxis.delta_us("fs").alias("dt_us"))
    q = packets.segments_stream(p).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(packets.OUT).parquet(f"{at}/out")


@query("""with q as (select event_id, user_id as k, epoch_us(ts) as t from events), r as (select user_id as k, epoch_us(ts) as t, max(value) as v from events where event_type in (select min(event_type) from events) group by 1, 2)
select q.event_id, q.k, q.t, r.v as v from q asof left join r on q.k = r.k and q.t >= r.t""")
def asof_join(spark, d):
    """Each event with its user's last value of one type known by then (many candidates each)."""
    e = load(spark, d, "events").select("event_id", F.col("user_id").alias("k"), model.us("ts").alias("t"), "value", "event_type")
    kind = e.agg(F.min("event_type")).first()[0]
    return select.asof_join(e.select("event_id", "k", "t"), e.where(F.col("event_type") == kind).select("k", "t", F.col("value").alias("v")), "k", "t", "v")


@query("select rec_id, regexp_replace(translate(regexp_replace(upper(trim(id)), '([./])\\s*(?:--|__|\\s+)\\s*([./])', '\\1\\2'), '_-/', '...'), '\\s+', '', 'g') as id, cast(round_even(1e6 / fs, 0) as bigint) as step from channels where fs > 0")
def sql_functions(spark, d):
    """The SQL surface: registered functions used from spark.sql."""
    sqlapi.register(spark)
    sqlapi.views(spark, tremolite_channels=load(spark, d, "channels"))
    return spark.sql("SELECT rec_id, canonical_id(id) AS id, delta_us(fs) AS step FROM tremolite_channels WHERE fs > 0")


@query("select count(*) as channels, count(distinct id) as ids, cast(sum((fs > 0)::int) as bigint) as regular, cast(sum((fs = 0)::int) as bigint) as irregular, cast(sum(coalesce(nx, 0)) as bigint) as samples from traces")
def summary(spark, d):
    """I7."""
    return select.summary(load(spark, d, "traces"))


@query("select tr_id, id, nx from traces where tr_id in (3, 5, 8)")
def by_position(spark, d):
    """Rows at positions."""
    return select.by_position(load(spark, d, "traces").withColumnRenamed("tr_id", "ch"), [3, 5, 8]).select(F.col("ch").alias("tr_id"), "id", "nx")


@query("select tr_id, id from traces where coalesce(not regexp_matches(id, '^QX'), true)")
def delete_pattern(spark, d):
    """Without ids that match."""
    return select.delete(load(spark, d, "traces"), pattern="^QX").select("tr_id", "id")


@query("select r_regionkey as ch, r_name as id from region union all select n_nationkey + 1 + (select max(r_regionkey) from region), n_name from nation")
def append_channels(spark, d):
    """Rows added, positions continued."""
    r = load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ch"), F.col("r_name").alias("id"))
    n = load(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("ch"), F.col("n_name").alias("id"))
    return select.append(r, n)


@query(CH + " select ch, id from c where id is not null order by id, ch")
def sorted_channels(spark, d):
    """O1."""
    return select.sorted_by_id(_ch(spark, d).where("id is not null")).select("ch", "id")


@query("select distinct id from traces")
def unique_ids(spark, d):
    """A13."""
    return load(spark, d, "traces").select("id").distinct()


@query(EV + ", lg as (select *, t_us - lag(t_us) over (partition by id order by t_us) - 3600000000 as gap from ev) select id, count(*) as n_gaps, cast(sum(gap) as bigint) as gap_us from lg where gap > 0 group by id")
def gap_totals(spark, d):
    """Number and total length of gaps."""
    s = timeaxis.segment_table(_ev(spark, d), ["id"], "t_us", HOUR)
    g = s.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n_gaps"), (F.max("end_us") - F.min("start_us") - F.sum(F.col("end_us") - F.col("start_us")) - (F.count(F.lit(1)) - 1) * F.lit(HOUR)).cast("long").alias("gap_us"))
    return g.where("n_gaps > 0")


@query("""with c as (select rec_id, loc.lat as lat, loc.lon as lon from channels where loc.lat between -90 and 90), p as (select rec_id, lat, atan(tan(radians(lat)) * 0.9933056) as p2, radians(lon) as l2, atan(tan(radians(10.0)) * 0.9933056) as p1, radians(20.0) as l1 from c where not isnan(lon))
select rec_id from p where degrees(2 * asin(least(1.0, sqrt(power(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * power(sin((l2 - l1) / 2), 2))))) between 5 and 60 and lat between -50.5 and 70.5""")
def in_radius(spark, d):
    """Channels 5 to 60 degrees from a point."""
    return select.in_radius(load(spark, d, "channels"), 10.0, 20.0, 5.0, 60.0).select("rec_id")


@query("select rec_id from channels where loc.lat between -30 and 40 and (loc.lon >= 150 or loc.lon <= -120) and not isnan(loc.lon) and loc.dep <= 50")
def in_region(spark, d):
    """Channels in a rectangle over the date line, down to a depth."""
    return select.in_region(load(spark, d, "channels").where("not isnan(loc.lon)"), -30.0, 40.0, 150.0, -120.0, dep_max=50.0).select("rec_id")


# --- set operations and comparisons of whole tables


@query("""with a as (select c_nationkey as id, cast(floor(c_acctbal / 1000) as bigint) as v, c_custkey as ch from customer), n as (select *, row_number() over (partition by id, v order by ch desc) as rn from a), b as (select s_nationkey as id, cast(floor(s_acctbal / 1000) as bigint) as v, count(*) as m from supplier group by 1, 2)
select n.ch, n.id, n.v from n left join b on n.id = b.id and n.v = b.v where rn > coalesce(m, 0)""")
def bag_diff(spark, d):
    """For each row of the second table one matching row of the first goes, the last ones first."""
    return select.bag_difference(_accounts(spark, d, "customer", "c"), _accounts(spark, d, "supplier", "s"), ["id", "v"], "ch").select("ch", "id", "v")


@query("""with u as (select c_nationkey as id, cast(floor(c_acctbal / 1000) as bigint) as v, c_custkey as ch, 0 as s from customer union all select s_nationkey, cast(floor(s_acctbal / 1000) as bigint), s_suppkey, 1 from supplier)
select id, v, max_by(ch, s * 1000000000000 + ch) as ch from u group by id, v""")
def add_union(spark, d):
    """Both tables, exact duplicates once (the last)."""
    return select.union_unique(_accounts(spark, d, "customer", "c"), _accounts(spark, d, "supplier", "s"), ["id", "v"], "ch").select("id", "v", "ch")


def _accounts(spark, d, table: str, p: str) -> DataFrame:
    key = {"c": "c_custkey", "s": "s_suppkey"}[p]
    return load(spark, d, table).select(F.col(f"{p}_nationkey").alias("id"), F.floor(F.col(f"{p}_acctbal") / 1000).alias("v"), F.col(key).alias("ch"))


@query("""with a as (select id, cast(sum(nx) as bigint) as was from traces where src is not null group by id), b as (select id, cast(sum(nx) as bigint) as now from traces where fs > 0 group by id)
select coalesce(a.id, b.id) as id, coalesce(was, 0) as was, coalesce(now, 0) as now from a full join b on a.id = b.id where was is distinct from now""")
def changed_channels(spark, d):
    """Channels that differ between two states of the store (traces of known source, regular traces)."""
    t = load(spark, d, "traces")
    return select.changed(t.where("src is not null"), t.where("fs > 0")).na.fill(0, ["was", "now"])


@query("select rec_id as ch from channels where name is distinct from upper(name)")
def changed_headers(spark, d):
    """Records whose header hash differs from before (track_hdr): names in upper case."""
    a = load(spark, d, "channels").select(F.col("rec_id").alias("ch"), "id", "name", "gain", "units")
    return lineage.changed_headers(a, a.withColumn("name", F.upper("name")), ("id", "name", "gain", "units"))


@query("""with s as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as k from lineitem) select o_orderkey as event_id, o_orderstatus as typ, coalesce(l_linenumber, 0) as src_id, coalesce(l_suppkey, 0) as m0 from orders left join s on l_orderkey = o_orderkey and k = 1""")
def event_channels(spark, d):
    """Event headers with the first source of each event."""
    h = load(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("typ"))
    s = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("src_id"), F.col("l_suppkey").alias("m0"))
    return quake.source_headers(h, s).na.fill(0, ["src_id", "m0"])


@query(GAPPED + " select id, cast(seg as bigint) as seg, min(t_us) as start_us, max(t_us) as end_us, count(*) as n, round(sum(x + 0.5), 4) as sum_x from sg group by id, seg")
def merge_overlaps(spark, d):
    """Hourly channels cut into two-day traces that overlap by a day, every other one raised by 1, merged again."""
    s = _seg(spark, d).withColumn("k", F.expr("t_us div 86400000000"))
    two = s.select("id", "seg", "t_us", F.explode(F.array("k", F.col("k") - 1)).alias("k"), "x").withColumn("x", F.col("x") + F.pmod("k", F.lit(2)))
    v = two.groupBy("id", "seg", "k").agg(F.min("t_us").alias("t0_us"), F.array_sort(F.collect_list(F.struct("t_us", "x"))).alias("v"))
    m = merge.merge_traces(v.select("id", "t0_us", F.lit(1 / 3600).alias("fs"), F.col("v.x").alias("x")))
    w = merge.segments(m).withColumnRenamed("id", "_id")
    total = m.select("id", "t0_us", F.aggregate("x", F.lit(0.0), lambda a, q: a + q).alias("sx"))
    j = w.join(total, (F.col("_id") == F.col("id")) & (F.col("t0_us") >= F.col("start_us")) & (F.col("t0_us") <= F.col("end_us")))
    return j.groupBy("id", "seg", "start_us", "end_us", "n").agg(F.round(F.sum("sx"), 4).alias("sum_x"))
