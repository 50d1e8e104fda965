"""Queries for operators beside ``reference``: files through the data source and sinks, codecs, metadata formats, the store, row
operations, lineage, event traces and nodal arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite import model
from tremolite.functions import scalar
from tremolite.operators import lineage, merge, nodal, process, quake, select
from tremolite.session import load, shared_folder
from tremolite.sources import codecs, datasource, dispatch, formats, metadata, store, web
from tremolite.streaming import packets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, what: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --- files through the sinks and the data source

_VEC = "with e as (select vec_id, generate_subscripts(embedding, 1) as i, cast(round(unnest(embedding)::double * 1000) as bigint) as v from embeddings)"
_SUMS = _VEC + " select 'XX.' || lpad(vec_id::varchar, 5, '0') || '.00.BHZ' as id, count(*) as n, cast(sum(v) as bigint) as total, cast(sum(v * i) as bigint) as weighted from e group by vec_id"


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings in thousandths as channels of 64 samples at 32 Hz."""
    e = load(spark, d, "embeddings")
    n = {c: F.lit(None).cast(k) for c, k in (q.split(" ") for q in formats.PIECE.split(", ")) if not k.startswith("map")}
    cols = n | {
        "id": F.concat(F.lit("XX."), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".00.BHZ")), "fs": F.lit(32.0), "gain": F.lit(1.0), "t0_us": F.lit(1_577_836_800_000_000), "n": F.lit(64).cast("long"),
        "x": F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v * 1000)), "misc": F.create_map().cast("map<string,string>"),
    }
    return e.select(*[cols[c].alias(c) for c in formats.COLUMNS])


def _written(pieces: DataFrame, folder: str, write: Callable[[list[dict], int], bytes], suffix: str) -> None:
    """One file a partition, by the executors, in a folder they share."""
    import os

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        rows = [formats.piece(**r) for b in batches for r in b.drop(columns="misc").to_dict("records")]
        part = TaskContext.get().partitionId()
        if rows:
            os.makedirs(folder, exist_ok=True)
            at = os.path.join(folder, f"p{part:05d}.{suffix}")
            with open(f"{at}.{os.getpid()}", "wb") as f:
                f.write(write(rows, part))
            os.replace(f"{at}.{os.getpid()}", at)
        yield pd.DataFrame({"n": [len(rows)]})

    pieces.mapInPandas(run, "n bigint").write.format("noop").mode("overwrite").save()


def _sums(df: DataFrame) -> DataFrame:
    s = df.select("id", "t0_us", F.posexplode("x").alias("k", "v")).withColumn("i", F.rint((F.col("t0_us") - 1_577_836_800_000_000) * 32 / 1e6).cast("long") + F.col("k") + 1)
    v = F.rint("v").cast("long")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * F.col("i")).alias("weighted"))


@query(_SUMS)
def source_mseed(spark, d):
    """Mini-SEED files of records of 256, 512 and 4096 bytes mixed, read in splits of 5,000 bytes through the data source."""
    at = _folder(spark, "mseed")
    _written(_pieces(spark, d), at, lambda ps, _: b"".join(formats.mseed_write([p], (3, 10, 11)[k % 3], (8, 9, 12)[k % 3]) for k, p in enumerate(ps)), "mseed")
    return _sums(datasource.read_data(spark, f"{at}/*.mseed", "mseed", split=5000))


@query(_VEC + " select count(distinct vec_id) as channels, count(*) as npts, 0::bigint as ngaps, count(distinct vec_id) as nfs from e")
def source_scan(spark, d):
    """Samples, gaps and rates of all channels in files, from record headers."""
    at = _folder(spark, "scan")
    _written(_pieces(spark, d), at, lambda ps, _: formats.mseed_write(ps, 10, 8), "mseed")
    s = datasource.scan(spark, f"{at}/*.mseed", "mseed")
    return s.agg(F.countDistinct("id").alias("channels"), F.sum("npts").cast("long").alias("npts"), F.sum("ngaps").cast("long").alias("ngaps"), F.sum("nfs").cast("long").alias("nfs"))


@query(_SUMS)
def source_sac(spark, d):
    """One SAC file a channel by the sink, read through the data source."""
    at = _folder(spark, "sac")
    datasource.write_sac(_pieces(spark, d), at).write.format("noop").mode("overwrite").save()
    return _sums(datasource.read_data(spark, at, "sac"))


@query("select f as format, count(*) as n from embeddings, (values ('mseed'), ('sac'), ('segy'), ('suds')) t(f) group by f")
def guess_formats(spark, d):
    """Formats told from the first bytes of files that hold each channel."""
    write = {"mseed": lambda p: formats.mseed_write([p], 10), "sac": formats.sac_write, "segy": lambda p: formats.segy_write([p], 1), "suds": lambda p: formats.suds_write([p])}

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [formats.guess(w(formats.piece(id="XX.EMB.00.BHZ", fs=32.0, t0_us=1_577_836_800_000_000, x=x, misc={"hex_id": "0001"}))[:16384], "") for x in b["x"] for w in write.values()]
            yield pd.DataFrame({"format": out})

    return _pieces(spark, d).select("x").mapInPandas(run, "format string").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


# --- codecs against their published bit layouts


@query("""with w as (select o_orderkey, (o_orderkey * 2654435761) % 65536 as v from orders)
select o_orderkey, ((v & 4095) - 2048) / power(2, (v >> 12) & 7) as geoscope3, ((v & 4095) - 2048) / power(2, (v >> 12) & 15) as geoscope4,
cast(((v & 16383) - 8191) * case v >> 14 when 0 then 1 when 1 then 4 when 2 then 16 else 128 end as double) as cdsn, (case when (v & 4095) >= 2048 then (v & 4095) - 4096 else v & 4095 end) * power(2.0, 10 - (v >> 12)) as sro,
cast(case when v >= 32768 then v - 65536 else v end as double) as dwwssn from w""")
def gain_ranged_codes(spark, d):
    """16-bit words in the GEOSCOPE (3 and 4-bit exponents), CDSN, SRO and DWWSSN encodings."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            v = (b["o_orderkey"].to_numpy().astype(object) * 2654435761 % 65536).astype(np.uint16)
            raw = v.astype(">u2").tobytes()
            out = {"o_orderkey": b["o_orderkey"]} | {n: codecs.decode(raw, len(v), c)[0] for n, c in (("geoscope3", 13), ("geoscope4", 14), ("cdsn", 16), ("sro", 30), ("dwwssn", 32))}
            yield pd.DataFrame(out)

    return load(spark, d, "orders").select("o_orderkey").mapInPandas(run, "o_orderkey bigint, geoscope3 double, geoscope4 double, cdsn double, sro double, dwwssn double")


@query("""with w as (select o_orderkey, o_orderkey % 2 as s, (o_orderkey * 40503) % 16777216 as m, 60 + o_orderkey % 9 as e from orders) select o_orderkey, (case s when 1 then -1.0 else 1.0 end) * m / 16777216.0 * power(16.0, e - 64) as x from w""")
def ibm_floats(spark, d):
    """Hexadecimal floating point words."""
    def run(batches):
        import pandas as pd

        for b in batches:
            k = b["o_orderkey"].to_numpy()
            yield pd.DataFrame({"o_orderkey": k, "x": codecs.ibm_float(((k % 2) << 31) | ((60 + k % 9) << 24) | ((k * 40503) % 16777216))})

    return load(spark, d, "orders").select("o_orderkey").mapInPandas(run, "o_orderkey bigint, x double")


@query("select f.a as factor, m.b as multiplier, case when f.a = 0 or m.b = 0 then 0.0 else (case when f.a > 0 then f.a else -1.0 / f.a end) * (case when m.b > 0 then m.b else -1.0 / m.b end) end as fs from (select distinct (n_nationkey - 12) * 4 as a from nation) f, (select distinct (r_regionkey - 2) * 10 as b from region) m")
def rate_factors(spark, d):
    """Sampling rates of rate factors and multipliers."""
    a = [(int(r[0]) - 12) * 4 for r in load(spark, d, "nation").select("n_nationkey").distinct().collect()]
    b = [(int(r[0]) - 2) * 10 for r in load(spark, d, "region").select("r_regionkey").distinct().collect()]
    return spark.createDataFrame([(x, y, formats.mseed_rate(x, y)) for x in a for y in b], "factor bigint, multiplier bigint, fs double")


# --- metadata formats

_META_SQL = """select rec_id, round(loc.lat, 4) as lat, round(loc.lon, 4) as lon, round(log(gain), 4) as log_gain, len(resp.p) as n_poles, round(coalesce(list_sum(list_transform(resp.p, lambda q: q.re)), 0), 3) as re
from channels where loc.lat between -90 and 90 and loc.lon between -180 and 180 and gain > 0 and gain < 1e300 and not isnan(gain) and len(resp.p) > 0 and abs(coalesce(list_sum(list_transform(resp.p, lambda q: q.re)), 0)) < 1e9"""


def _meta(spark: SparkSession, d: str, write: Callable[[list[dict]], object], read: Callable[[object], list[dict]]) -> DataFrame:
    """Every channel record with a place, a gain and poles through a metadata format and back."""
    re = F.aggregate(F.col("resp.p"), F.lit(0.0), lambda a, q: a + q["re"])
    c = load(spark, d, "channels").where("loc.lat between -90 and 90 and loc.lon between -180 and 180 and gain > 0 and gain < 1e300 and not isnan(gain) and size(resp.p) > 0").where(F.abs(re) < 1e9)

    def run(batches):
        import math

        import pandas as pd

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                poles = [{"re": float(q["re"]), "im": float(q["im"] or 0.0)} for q in r["p"]]
                one = {"id": "CC.VALT.00.BHZ", "name": "x", "start_us": 946_684_800_000_000, "end_us": 1_893_456_000_000_000, "lat": r["lat"], "lon": r["lon"], "el": 0.0, "dep": 0.0, "az": 0.0, "inc": 0.0, "fs": 50.0, "gain": r["gain"], "units": "m/s", "a0": 1.0, "f0": 1.0, "p": poles, "z": [], "stages": []}
                g = read(write([one]))[0]
                rows.append((r["rec_id"], round(g["lat"], 4), round(g["lon"], 4), round(math.log10(g["gain"]), 4), len(g["p"]), round(sum(q["re"] for q in g["p"]), 3)))
            yield pd.DataFrame(rows, columns=["rec_id", "lat", "lon", "log_gain", "n_poles", "re"])

    return c.select("rec_id", "loc.lat", "loc.lon", "gain", F.col("resp.p").alias("p")).mapInPandas(run, "rec_id bigint, lat double, lon double, log_gain double, n_poles bigint, re double")


@query(_META_SQL)
def meta_sxml(spark, d):
    """S19/K6."""
    return _meta(spark, d, metadata.sxml_write, metadata.sxml_read)


@query(_META_SQL)
def meta_sacpz(spark, d):
    """S23/K5."""
    return _meta(spark, d, metadata.sacpz_write, metadata.sacpz_read)


@query("select event_id, epoch_us(ts) // 1000 * 1000 as ot_us, floor(value * 10) / 1000 as mag from events")
def meta_qml(spark, d):
    """Events through QuakeML and back."""
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k, t, m in zip(b["event_id"], b["us"], b["m"]):
                e = {"event_id": f"e{k}", "typ": "earthquake", "name": "", "ot_us": int(t), "lat": 1.0, "lon": 2.0, "dep": 3.0, "nst": 0, "gap": 0.0, "rms": 0.0, "mag": m, "mag_scale": "Mw", "picks": []}
                g = metadata.qml_read(metadata.qml_write([e]))[0]
                rows.append((k, g["ot_us"], round(g["mag"], 3)))
            yield pd.DataFrame(rows, columns=["event_id", "ot_us", "mag"])

    e = load(spark, d, "events").select("event_id", (F.expr("unix_micros(cast(ts as timestamp)) div 1000") * 1000).alias("us"), (F.floor(F.col("value") * 10) / 1000).alias("m"))
    return e.mapInPandas(run, "event_id bigint, ot_us bigint, mag double")


# --- the store

_HOURS = "with ev as (select event_type as id, epoch_us(ts) // 3600000000 * 3600000000 as t_us, sum(value) as x from events group by 1, 2)"
_DAYS = "with dd as (select l_returnflag || l_linestatus as id, epoch_us(l_shipdate) // 86400000000 * 86400000000 as t_us, sum(l_quantity) as x from lineitem group by 1, 2)"


@query(_HOURS + ", m as (select id, t_us, case when (t_us // 3600000000) % 3 = 0 then -x when (t_us // 3600000000) % 3 = 1 then 2 * x else x end as x from ev) select id, (t_us // 86400000000) % 7 as y, count(*) as n, round(sum(x), 3) as x from m group by 1, 2")
def store_modes(spark, d):
    """Samples written to a new store, some added to, some overwritten, then read by day."""
    s = model.ev_hour(load(spark, d, "events"))
    at, k = _folder(spark, "store"), F.pmod(F.expr("t_us div 3600000000"), F.lit(3))
    store.write(s.where(k != 2), at)
    store.write(s.withColumn("x", F.when(k == 2, F.col("x")).otherwise(0.0)), at, "add")  # stored values stay
    store.write(s.where(k == 0).withColumn("x", -F.col("x")), at, "ovr")
    store.write(s.where(k == 1).withColumn("x", 2 * F.col("x")), at, "ovr")
    y = F.pmod(F.expr("t_us div 86400000000"), F.lit(7))
    return store.read(spark, at).groupBy("id", y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"))


# --- row operations


@query("select tr_id, id, case when fs = 0 then 0 else nx end as nx from traces")
def replace_rows(spark, d):
    """Irregular traces replaced by empty ones."""
    t = load(spark, d, "traces").select(F.col("tr_id").alias("ch"), "id", "nx", "fs")
    return select.replace_rows(t, t.where("fs = 0").withColumn("nx", F.lit(0).cast("long"))).select(F.col("ch").alias("tr_id"), "id", "nx")


@query("select coalesce(src = 'NDC', false) as pulled, count(*) as n, cast(sum(tr_id) as bigint) as ids from traces group by 1")
def pull_rows(spark, d):
    """Rows pulled out, and the others."""
    a, b = select.pull(load(spark, d, "traces"), F.col("src") == "NDC")
    u = a.select(F.lit(True).alias("pulled"), "tr_id").unionByName(b.select(F.lit(False).alias("pulled"), "tr_id"))
    return u.groupBy("pulled").agg(F.count(F.lit(1)).alias("n"), F.sum("tr_id").alias("ids"))


@query("select tr_id, id from traces where id is distinct from (select min(id) from traces) and tr_id not in (1, 4, 9)")
def delete_channels(spark, d):
    """Without an exact id and without positions."""
    t = load(spark, d, "traces").withColumnRenamed("tr_id", "ch")
    low = t.agg(F.min("id")).first()[0]
    return select.delete(select.delete(t, id=low), [1, 4, 9]).select(F.col("ch").alias("tr_id"), "id")


@query("select tr_id, id from traces where regexp_matches(id, '\\.[BH]H.$')")
def find_pattern(spark, d):
    """Ids that contain a match."""
    return select.find_pattern(load(spark, d, "traces"), r"\.[BH]H.$").select("tr_id", "id")


@query("with w as (select distinct id from traces union select 'XX.NONE..ZZZ') select id, id in (select id from runs) as present from w")
def id_in_table(spark, d):
    """P10: whether a table has an id."""
    w = load(spark, d, "traces").select("id").distinct().unionByName(spark.createDataFrame([("XX.NONE..ZZZ",)], "id string"))
    return select.present(load(spark, d, "runs"), w)


@query("select tr_id, id from traces where not coalesce(nx = 0, false)")
def delete_flagged(spark, d):
    """Flagged rows (here empty traces) deleted."""
    return select.without_flagged(load(spark, d, "traces").withColumn("flagged", F.col("nx") == 0)).select("tr_id", "id")


@query("select src, -1 as run_id, trust from sources union all select src, run_id, -1 from runs")
def splat_tables(spark, d):
    """Tables of different kinds in one."""
    return select.splat(load(spark, d, "sources").select("src", "trust"), load(spark, d, "runs").select("src", "run_id")).select("src", "run_id", "trust").na.fill(-1, ["run_id", "trust"])


@query("select tr_id, id, nx, 0.0::double as az, 0.0::double as dist, 0 as n_pha from traces")
def event_trace_columns(spark, d):
    """Channels as event traces, and back."""
    t = load(spark, d, "traces").select("tr_id", "id", "nx")
    e = select.as_event_traces(t)
    back = select.as_channels(e)
    return e.select("tr_id", "id", "nx", F.lit(0.0).alias("az") if back.columns == t.columns else "pha", "dist", F.size("pha").alias("n_pha"))


# --- scalar functions


@query("select event_id, (epoch_us(ts) // 1000) / 1000.0 as s, epoch_us(ts) // 1000 * 1000 as us from events")
def unix_seconds(spark, d):
    """timestamps to unix seconds with milliseconds, and back."""
    e = load(spark, d, "events").select("event_id", scalar.d2u(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", "s", F.unix_micros(scalar.u2d("s")).alias("us"))


@query("select event_id, epoch_us(ts) // 10000 * 10000 as us from events")
def bcd_dates(spark, d):
    """F8: times as binary coded decimals."""
    e = load(spark, d, "events").select("event_id", F.unhex(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.substring(F.date_format("ts", "SSSSSS"), 1, 2))).alias("b"))
    return e.select("event_id", scalar.bcd_time("b").alias("us"))


@query("with t as (select * from (values ('Float32', 49), ('Float64', 50), ('Int16', 33), ('String', 1), ('UInt8', 16)) v(name, code)), a as (select name, code from t union all select 'Array{' || name || '}', code + 128 from t) select distinct name, code, name as back from a")
def type_codes(spark, d):
    """storage codes of types."""
    names = [n for k in ("Float32", "Float64", "Int16", "String", "UInt8") for n in (k, f"Array{{{k}}}")]
    return spark.createDataFrame([(n, scalar.typ2code(n), scalar.code2typ(scalar.typ2code(n))) for n in names], "name string, code int, back string")


# --- lineage


@query("""with n as (select rec_id as ch, unnest(notes) as note from channels), c as (select rec_id as ch from channels where src = 'NDC')
select category, count(*) as n, count(distinct ch) as channels from (select ch, 'note' as category from n where ch not in (select ch from c) union all select ch, 'processing' from c) group by category""")
def clear_notes(spark, d):
    """L2/L4: notes of one source's channels cleared, with a row that says so."""
    c = load(spark, d, "channels")
    n = lineage.parse(c.select(F.col("rec_id").alias("ch"), F.explode("notes").alias("note")))
    out = lineage.clear(n, c.where("src = 'NDC'").select(F.col("rec_id").alias("ch")))
    shown = lineage.show(out, "processing").unionByName(lineage.show(out, "note"))
    return shown.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ch").alias("channels"))


@query("with c as (select rec_id as ch, id, name from channels), t as (select min(id) as id from c), h as (select ch from c, t where (length(c.id) > 0 and contains('see ' || t.id || ' of today', c.id)) or (length(c.name) > 0 and contains('see ' || t.id || ' of today', c.name))) select ch, 'see ' || t.id || ' of today' as descr from h, t")
def note_channels(spark, d):
    """L1: a note goes to the channels its text names."""
    c = load(spark, d, "channels").select(F.col("rec_id").alias("ch"), "id", "name")
    text = f"see {c.agg(F.min('id')).first()[0]} of today"
    return lineage.note(c, text).select("ch", "descr")


@query("select rec_id as ch, '+source' as category, coalesce(src, '') || ' -> ' || 'NEW' as descr from channels where src is distinct from 'NEW' and units is not null union all select rec_id, '+source', coalesce(src, '') || ' -> ' || '' from channels where units is null and src is not null")
def track_sources(spark, d):
    """Channels whose source changed, as notes."""
    c = load(spark, d, "channels").select(F.col("rec_id").alias("ch"), "src", "units")
    now = c.withColumn("src", F.when(F.col("units").isNotNull(), F.lit("NEW")))
    return lineage.changed_sources(c, now).select("ch", "category", "descr")


# --- events


@query("""with e as (select n_nationkey as k, -50.0 + 4 * n_nationkey as la, -120.0 + 10 * n_nationkey as lo from nation), c as (select rec_id, rec_id % 25 as k, loc.lat as lat, loc.lon as lon from channels where loc.lat between -90 and 90 and loc.lon between -180 and 180),
p as (select rec_id, atan(tan(radians(lat)) * 0.9933056) as p2, radians(lon) as l2, atan(tan(radians(la)) * 0.9933056) as p1, radians(lo) as l1 from c join e using (k))
select rec_id, round(degrees(2 * asin(least(1.0, sqrt(power(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * power(sin((l2 - l1) / 2), 2))))), 5) as dist from p""")
def event_distances(spark, d):
    """channels of events with their distances."""
    e = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("event_id"), (-50.0 + 4 * F.col("n_nationkey")).alias("lat"), (-120.0 + 10 * F.col("n_nationkey")).alias("lon"))
    c = load(spark, d, "channels").where("loc.lat between -90 and 90 and loc.lon between -180 and 180").select("rec_id", (F.col("rec_id") % 25).alias("event_id"), "loc")
    return quake.distaz(c, e).select("rec_id", F.round("dist", 5).alias("dist"))


@query("select event_id::varchar as id, p as phase, value * f as tt from events, (values ('P', 1.0), ('S', 1.8)) t(p, f)")
def show_phases(spark, d):
    """Picks of every event, a row a phase."""
    pick = lambda f: F.struct((F.col("value") * f).alias("tt"))
    e = load(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.create_map(F.lit("P"), pick(1.0), F.lit("S"), pick(1.8)).alias("pha"))
    return quake.show_phases(e).select("id", "phase", "tt")


@query("""with e as (select user_id, event_type, event_id, value as dist, case when event_id % 3 = 0 then 0.0 else value + 1 end as az from events), r as (select *, row_number() over (partition by user_id order by (dist <> 0)::int desc, event_id desc) as kd, row_number() over (partition by user_id order by (az <> 0)::int desc, event_id desc) as ka from e),
p as (select user_id, event_type, arg_max(value, event_id) as v from events group by 1, 2), m as (select user_id, count(*) as n_pha, round(sum(v), 4) as sum_pha from p group by 1)
select a.user_id, round(a.az, 6) as az, round(b.dist, 6) as dist, n_pha, sum_pha from (select user_id, az from r where ka = 1) a join (select user_id, dist from r where kd = 1) b using (user_id) join m using (user_id)""")
def event_trace_merge(spark, d):
    """Distances, azimuths and phase maps of merged event traces."""
    e = load(spark, d, "events").select("user_id", "event_id", F.col("value").alias("dist"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value") + 1).alias("az"), F.lit(0.0).alias("baz"), F.create_map("event_type", "value").alias("pha"))
    f, p = quake.merge_trace_fields(e, ["user_id"], "event_id"), quake.merge_phases(e, ["user_id"], "event_id")
    total = F.round(F.aggregate(F.map_values("pha"), F.lit(0.0), lambda a, v: a + v), 4)
    return f.join(p, "user_id").select("user_id", F.round("az", 6).alias("az"), F.round("dist", 6).alias("dist"), F.size("pha").cast("long").alias("n_pha"), total.alias("sum_pha"))


# --- merges


@query(_VEC + ", w as (select 'V' || vec_id % 50 as id, (vec_id // 50) * 32 + i as k, v from e), m as (select id, k, avg(v) as v from w group by id, k) select id, count(*) as n, min(k) as first, round(sum(v), 4) as total from m group by id")
def merge_three(spark, d):
    """Channels of overlapping pieces, given in three tables, merged into one (half of each piece overlaps the next)."""
    e = load(spark, d, "embeddings").select("vec_id", F.concat(F.lit("V"), F.col("vec_id") % 50).alias("id"), (F.expr("vec_id div 50") * 32_000_000).alias("t0_us"), F.lit(1.0).alias("fs"), F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v * 1000)).alias("x"))
    parts = [e.where(F.col("vec_id") % 3 == k).drop("vec_id") for k in range(3)]
    m = merge.merge_many(*parts)
    return m.groupBy("id").agg(F.sum(F.size("x")).alias("n"), (F.min("t0_us") / 1_000_000 + 1).cast("long").alias("first"), F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)), 4).alias("total"))


@query(_DAYS + " select id, count(*) as n, round(sum(x), 3) as x from dd group by id")
def law_union(spark, d):
    """S + U = U + S, (S + U) + V = S + (U + V) and S + U - U = S: the rows if all three laws hold, else none."""
    s = model.ship_day(load(spark, d, "lineitem")).withColumn("ch", F.expr("t_us div 86400000000"))
    keys = ["id", "t_us", "x"]
    a, b, c = (s.where(F.pmod("ch", F.lit(3)) == k) for k in range(3))
    u = lambda p, q: select.union_unique(p, q, keys, "ch").select(*s.columns)
    ab, ba = u(a, b), u(b, a)
    left, right = u(ab, c), u(a, u(b, c))
    back = select.bag_difference(a.unionByName(b), b, keys, "ch")
    bad = ab.exceptAll(ba).unionByName(left.exceptAll(right)).unionByName(back.exceptAll(a)).unionByName(a.exceptAll(back)).agg(F.count(F.lit(1)).alias("_bad"))
    return left.join(F.broadcast(bad.where("_bad = 0")), F.lit(True)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"))


# --- nodal arrays, requests, streams


@query("select r_regionkey as ch, r_name as id from region union all select n_nationkey + 1 + (select max(r_regionkey) from region), n_name from nation")
def nodal_append(spark, d):
    """Nd1: channels of two arrays side by side."""
    r = load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ch"), F.col("r_name").alias("id"))
    n = load(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("ch"), F.col("n_name").alias("id"))
    return nodal.append(r, n)


@query("with e as (select 0 as o, r_name as k, 'r' || r_regionkey as v from region union all select 1, case when n_nationkey < 3 then (select min(r_name) from region) else n_name end, 'n' || n_nationkey from nation), b as (select o, k, max(v) as v from e group by o, k) select k as key, arg_max(v, o) as value from b group by k")
def nodal_info(spark, d):
    """Nd1/I6: info maps of two arrays merged and dumped."""
    low = load(spark, d, "region").agg(F.min("r_name")).first()[0]
    m = lambda df, k, v: df.groupBy(k.alias("k")).agg(F.max(v).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("info"))
    a = m(load(spark, d, "region"), F.col("r_name"), F.concat(F.lit("r"), F.col("r_regionkey")))
    b = m(load(spark, d, "nation"), F.when(F.col("n_nationkey") < 3, low).otherwise(F.col("n_name")), F.concat(F.lit("n"), F.col("n_nationkey")))
    return nodal.info_dump(nodal.merge_info(a, b))


@query("with s as (select regexp_extract(id, '^[^.]*\\.[^.]*') as station, max(epoch_us(arrived)) as e from traces where arrived is not null group by 1), n as (select max(e) as now from s), w as (select distinct regexp_extract(id, '^[^.]*\\.[^.]*') as station from traces union select 'XX.NONE') select w.station, coalesce(now - e < 3600000000, false) as live from w left join s on s.station = w.station, n")
def live_stations(spark, d):
    """Which stations sent something within the hour before the last packet."""
    t = load(spark, d, "traces")
    now = t.agg(F.max(F.unix_micros("arrived"))).first()[0]
    w = [r[0] for r in t.select(F.regexp_extract("id", r"^([^.]*\.[^.]*)", 1)).distinct().collect()] + ["XX.NONE"]
    return web.live_stations(t.select("id", F.unix_micros("arrived").alias("end_us")), now, w)


@query("select id, epoch_us(date_trunc('day', arrived)) as start, count(*) as packets, cast(sum(nx) as bigint) as samples from traces where arrived is not null group by 1, 2")
def packet_windows(spark, d):
    """Packets and samples per channel and day."""
    return packets.windowed(load(spark, d, "traces").where("arrived is not null").withColumnRenamed("nx", "n"), "arrived", "1 day", "1 hour").withColumn("start", F.unix_micros("start"))


@query(f"select * from (values {', '.join(str(r) for r in dispatch.SUPPORT)}) t(format, access, detail)")
def support_table(spark, d):
    """What is read and written."""
    return dispatch.support(spark)


@query(_DAYS + ", g as (select id, min(t_us) as a, max(t_us) as z, avg(x) as mu from dd group by id), q as (select id, unnest(generate_series(a, z, 86400000000)) as t_us, mu from g), f as (select q.id, q.t_us, coalesce(dd.x, mu) as x from q left join dd on dd.id = q.id and dd.t_us = q.t_us) select id, t_us, round(x - avg(x) over (partition by id), 4) + 0.0 as x from f")
def download_steps(spark, d):
    """What follows a download, here demean and ungap."""
    s = model.ship_day(load(spark, d, "lineitem"))
    f = web.finish(s, ["id"], model.DAY, 1 / 86400, demean=True, ungap=True)
    return process.demean(f, ["id"]).select("id", "t_us", (F.round("x", 4) + 0.0).alias("x"))


# --- compositions


@query("select event_id, round(case when event_id % 5 = 0 then -value when event_id % 2 = 0 then value else value + 1 end, 6) as value from events")
def store_events(spark, d):
    """K9: a table of events written, added to and overwritten by key."""
    e, at = load(spark, d, "events").select("event_id", "value"), _folder(spark, "events")
    store.write_table(e.where("event_id % 2 = 0"), at, "event_id")
    store.write_table(e.withColumn("value", F.col("value") + 1), at, "event_id", "add")
    store.write_table(e.where("event_id % 5 = 0").withColumn("value", -F.col("value")), at, "event_id", "ovr")
    return spark.read.parquet(at).select("event_id", F.round("value", 6).alias("value"))


@query("with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, cast(round(unnest(embedding)::double * 1000) as bigint) as v from embeddings), w as (select 'V' || vec_id % 25 as id, (vec_id // 25) * 32 + i as k, v from e where vec_id % 2 = 0 or label < 7), m as (select id, k, avg(v) as v from w group by id, k) select id, count(*) as n, round(sum(v), 4) as total from m group by id")
def merge_matching(spark, d):
    """Odd-numbered channels merged into even-numbered ones of their id where the units agree or are unset."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("ch"), F.concat(F.lit("V"), F.col("vec_id") % 25).alias("id"), F.lit(1.0).alias("fs"), F.lit(1.0).alias("gain"), "label", (F.expr("vec_id div 25") * 32_000_000).alias("t0_us"), F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v * 1000)).alias("x"))
    units = F.when(F.col("ch") % 2 == 0, "m").when(F.col("label") < 3, None).when(F.col("label") < 7, "m").otherwise("Pa")
    h, t = e.select("ch", "id", "fs", "gain", units.alias("units")), e.select("ch", "t0_us", "fs", "x")
    even = F.col("ch") % 2 == 0
    m = merge.merge_matching(h.where(even), t.where(even), h.where(~even), t.where(~even))
    return m.groupBy("id").agg(F.sum(F.size("x")).alias("n"), F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)), 4).alias("total"))


@query(_HOURS + ", r as (select r_regionkey as event_id, 1704067200000000 + r_regionkey * 259200000000 as ot from region), c as (select event_id, ot, id from r, (select distinct id from ev)) select c.event_id, c.id, count(ev.t_us) as n, coalesce(min(ev.t_us), 0) as t0_us, round(c.event_id * 10.0, 6) as dist from c left join ev on ev.id = c.id and ev.t_us between ot - 86400000000 and ot + 86400000000 group by c.event_id, c.id")
def event_data(spark, d):
    """Events with their channels, distances and samples around the origin time."""
    ev = model.ev_hour(load(spark, d, "events"))
    r = load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("event_id"), (F.lit(1_704_067_200_000_000) + F.col("r_regionkey") * 259_200_000_000).alias("ot_us"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    kinds = [q[0] for q in ev.select("id").distinct().collect()]
    c = r.select("event_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("id"))
    c = c.withColumn("loc", F.named_struct(F.lit("lat"), F.lit(0.0), F.lit("lon"), F.col("event_id") * 10.0))
    t = quake.event_table(r, c, ev, model.DAY, model.DAY)
    return t.select("event_id", "id", "n", F.coalesce("t0_us", F.lit(0).cast("long")).alias("t0_us"), F.round("dist", 6).alias("dist"))
