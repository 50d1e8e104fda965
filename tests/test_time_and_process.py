"""Goldens and laws of the time axis, processing, selection and scalar functions."""

import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite import timeaxis
from tremolite.functions import ids, scalar
from tremolite.operators import dsp, lineage, merge, nodal, process, quake, select, synth

NAN = float("nan")
S = "id string, t_us bigint, x double"


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).collect()[0]["o"]


def series(spark, xs, step=10, id="A", t0=0, skip=()):
    return spark.createDataFrame([(id, t0 + k * step, float(x)) for k, x in enumerate(xs) if k not in skip], S)


def got(df, c="x"):
    return {(r["id"], r["t_us"]): r[c] for r in df.collect()}


def test_units_goldens(spark):
    cases = {}
    for a in ("m/s^1", "m/s**1", "m s^-1", "m*s^-1", "m.s^-1", "m⋅s^-1", "m × s^-1", "m s**-1", "M/S"):
        cases[a] = "m/s"
    for a in ("m/s^2", "m s^-2", "m/s**2", "M/S**2", "M/S/S"):
        cases[a] = "m/s2"
    cases |= {"s^43/s**3": "s43/s3", "s**10/m^4": "s10/m4", "s^43 m**-3": "s43/m3", "s^43 cm^-3 g": "s43/cm3.g", "s^43 cm**+3 g": "s43.cm3.g", "m s^-1 K": "m/s.K", "s^43.cm^-3*V^-4": "s43/cm3.V4", "COUNTS": "{counts}"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", scalar.units2ucum("v").alias("o"))
    assert {r["v"]: r["o"] for r in df.collect()} == cases


def test_times(spark):
    for s in ("2018-01-01T00:00:00.000001", "2018-01-01T00:00:00", "2018-01-01T00:00:00.035", "2016-02-29T00:00:00.02", "1969-12-31T23:59:59.5", "2255-06-05T00:00:00"):
        us = col(spark, s, scalar.tstr2int)
        d = datetime.fromisoformat(s).replace(tzinfo=timezone.utc)
        assert us == round((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6)
        assert col(spark, us, scalar.int2tstr, "bigint") == d.strftime("%Y-%m-%dT%H:%M:%S.%f")
        assert col(spark, us, lambda c: scalar.tstr2int(scalar.int2tstr(c)), "bigint") == us
    assert col(spark, "nonsense", scalar.tstr2int) is None and col(spark, "2018-02-30T00:00:00", scalar.tstr2int) is None
    a = col(spark, 1_583_455_810_004_000, scalar.t_arr, "bigint")
    assert list(a) == [2020, 66, 0, 50, 10, 4]
    assert col(spark, 60, lambda c: scalar.j2md(F.lit(2020), c), "int").asDict() == {"m": 2, "d": 29}
    assert col(spark, 29, lambda c: scalar.md2j(F.lit(2020), F.lit(2), c), "int") == 60
    assert col(spark, 2020, scalar.y2us, "int") == 1_577_836_800_000_000
    now = datetime(2020, 1, 1, 12, 34, 56)
    assert scalar.parse_window(-60, 0, now) == (1_577_881_980_000_000, 1_577_882_040_000_000)
    assert scalar.parse_window("2020-01-02", "2020-01-01", now) == (1_577_836_800_000_000, 1_577_923_200_000_000)
    assert scalar.parse_window("2020-01-01", 5, now)[1] - scalar.parse_window("2020-01-01", 5, now)[0] == 5_000_000
    assert col(spark, bytes.fromhex("2013010203040506"), scalar.bcd_time, "binary") == 1_357_095_845_060_000


def test_codes(spark):
    for fs, fc, b in ((1000, 1, "G"), (1000, 0.05, "F"), (250, 1, "C"), (100, 1, "E"), (100, 0.01, "H"), (20, 1, "S"), (20, 0.02, "B"), (10, 1, "S"), (5, 1, "M"), (1, 1, "L"), (0.1, 1, "V"), (0.005, 1, "U"), (1e-7, 1, "Q")):
        assert col(spark, float(fs), lambda c: scalar.bandcode(c, fc), "double") == b, (fs, fc)
    assert list(col(spark, "AA.BBB.CC", ids.split_id)) == ["AA", "BBB", "CC", ""] and col(spark, "AA.BBB.00.EHZ", ids.inst_code) == "H" and col(spark, "AA.BBB.00.E", ids.inst_code) == ""
    assert col(spark, "a_b__c ", ids.canonical_id) == "A.B..C" and col(spark, " q.x.--.z", ids.canonical_id) == "Q.X..Z" and col(spark, None, ids.canonical_id) is None
    assert ids.wildcard_to_regex("C?.*.B") == r"C.\..*\.B"
    assert col(spark, "a b\x01/c~", lambda c: scalar.namestrip(c, "File")) == "a bc" and col(spark, "a.b", lambda c: scalar.namestrip(c, "SEED")) == "ab" and col(spark, "x?y", lambda c: scalar.namestrip(c, "zzz")) == "xy"
    assert col(spark, 37, scalar.mk_lc, "int") == "11" and col(spark, 12, lambda c: scalar.trid(c, F.lit(100.0)), "int") == "EHZ"
    for name in ("Char", "UInt8", "Complex{Float64}", "Array{Complex{Float32}}"):
        assert scalar.code2typ(scalar.typ2code(name)) == name
    assert scalar.typ2code("Complex{Int8}") == 0x60 and scalar.typ2code("Array{Float64}") == 0xB2


def test_geometry_and_responses(spark):
    g = col(spark, 0.0, lambda c: scalar.gcdist(c, F.lit(0.0), F.lit(0.0), F.lit(90.0)), "double")
    assert g["dist"] == pytest.approx(90) and g["az"] == pytest.approx(90) and g["baz"] == pytest.approx(270)
    p = col(spark, 0.2, scalar.fctoresp, "double")
    assert p[0]["re"] == pytest.approx(-0.2 * 2 * math.pi * math.sqrt(0.5)) and p[0]["im"] == pytest.approx(-p[1]["im"])
    z0 = F.array(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
    for fc, a0 in ((0.2, 1.7771534), (2.0, 17.771534)):
        got_a0 = col(spark, fc, lambda c: scalar.resp_a0(scalar.fctoresp(c), z0, F.lit(1.0) * 0 + c, F.lit("m/s")), "double")
        assert abs(got_a0) == pytest.approx(a0, rel=1e-4) and got_a0 < 0
        assert col(spark, fc, lambda c: scalar.resptofc(scalar.fctoresp(c)), "double") == pytest.approx(fc)
    assert list(col(spark, [1.0, 2.0], scalar.poly, "array<double>")) == [1, -3, 2] and col(spark, [1.0, -3.0, 2.0], lambda c: scalar.polyval(c, F.lit(3.0)), "array<double>") == 2
    t = np.arange(1.0, 1001)
    assert np.allclose(dsp.polyfit(t, 2 * t, 1), [2, 0], atol=1e-5) and np.allclose(dsp.polyfit(t, t**3, 3), [1, 0, 0, 0], atol=1e-3)


def test_process_with_nans(spark):
    df = series(spark, [1, 2, NAN, 5]).unionByName(series(spark, [NAN, NAN], id="B"))
    d = got(process.demean(df, ["id"]))
    assert [d["A", k] for k in (0, 10, 30)] == pytest.approx([-5 / 3, -2 / 3, 7 / 3]) and math.isnan(d["A", 20])
    n = got(process.nanfill(df, ["id"]))
    assert n["A", 20] == pytest.approx(8 / 3) and n["B", 0] == 0
    line = got(process.detrend(series(spark, [1, 3, NAN, 7, 9]), ["id"]))
    assert all(abs(v) < 1e-9 or math.isnan(v) for v in line.values())
    one = got(process.detrend(series(spark, [4]), ["id"]))
    assert one["A", 0] == 0


def test_ungap_sync_taper(spark):
    df = series(spark, [1, 2, 3, 4, 5, 6], skip=(2, 3))
    u = process.ungap(df, ["id"], 10, chunk=2)
    assert got(u) == {("A", 10 * k): v for k, v in enumerate([1, 2, 3.5, 3.5, 5, 6])} and got(u, "filled")["A", 20]
    assert math.isnan(got(process.ungap(df, ["id"], 10, mean=False))["A", 20])
    two = df.unionByName(series(spark, [7, 8, 9], id="B", t0=20))
    assert set(got(process.sync(two, ["id"], 10, "last"))) == {("A", 40), ("A", 50), ("B", 20), ("B", 30), ("B", 40)}
    p = got(process.sync(two, ["id"], 10, "first", "last", pad=True))
    assert p["B", 0] == 8 and p["B", 10] == 8 and p["B", 50] == 8 and len(p) == 10
    assert process.sync(two, ["id"], 10, 1000, 900).count() == 0
    n = 200
    t = timeaxis.segments_of_samples(series(spark, np.ones(n) * 3), ["id"], "t_us", 10)
    v = got(process.taper(t, ["id"], 1.0, t_max=10.0, alpha=0.05))
    assert all(abs(x - 3) < 1e-12 for x in v.values())  # a constant is its own mean
    w = got(process.taper(timeaxis.segments_of_samples(series(spark, [0.0] * 100 + [2.0] * 100), ["id"], "t_us", 10), ["id"], 1.0))
    assert w["A", 0] == 1 and w["A", 1990] == 1 and w["A", 500] == 0 and 0 < w["A", 50] < 1


def test_calculus_is_self_inverse(spark):
    x = np.random.default_rng(0).normal(size=40)
    df = timeaxis.segments_of_samples(series(spark, x, skip=(13, 14)), ["id"], "t_us", 10)
    back = got(process.integrate(process.differentiate(df, ["id"], 50.0), ["id"], 50.0))
    assert all(back["A", 10 * k] == pytest.approx(x[k]) for k in range(40) if k not in (13, 14))
    there = process.convert_seismic(df, ["id"], "m", "m/s2", 1e5)
    again = got(process.convert_seismic(there, ["id"], "m/s2", "m", 1e5))
    assert again["A", 390] == pytest.approx(x[39])
    with pytest.raises(ValueError):
        process.convert_seismic(df, ["id"], "m", "Pa", 1.0)


def test_merges(spark):
    a, b = series(spark, [1, 2, 3, NAN]), series(spark, [30, 40, 50], t0=20)
    assert got(process.merge_overlap(a, b, ["id"])) == {("A", 0): 1, ("A", 10): 2, ("A", 20): 16.5, ("A", 30): 40, ("A", 40): 50}
    assert process.merge_irregular(a, a, ["id"]).count() == 4
    near = spark.createDataFrame([("A", 0, 1.0), ("A", 4, 3.0), ("A", 20, NAN), ("A", 22, 5.0), ("A", 60, NAN)], S)
    m = got(process.merge_near(near, ["id"], 10))
    assert m["A", 0] == 2 and m["A", 20] == 5 and math.isnan(m["A", 60])
    nx, x = 100, np.random.default_rng(1).normal(size=(2, 100))
    t = lambda off, v, i="V": (i, off, 100.0, [float(q) for q in v], 32.0)
    df = spark.createDataFrame([t(0, x[0]), t((nx - 3) * 10_000, x[1]), t(5_000_000, x[0], "W"), ("W", 0, 100.0, [], 1.0), ("W", 0, None, None, 1.0)], "id string, t0_us bigint, fs double, x array<double>, gain double")
    for shard, steps in ((3_600_000_000, 65536), (300_000, 1)):
        g = merge.merge_traces(df, shard_us=shard, shard_steps=steps)
        y = np.concatenate([r["x"] for r in g.where("id = 'V'").orderBy("t0_us").collect()])
        assert len(y) == 2 * nx - 3 and np.allclose(y[97:100], (x[0][97:] + x[1][:3]) / 2)
        s = {r["id"]: (r["start_us"], r["n"]) for r in merge.segments(g).collect()}
        assert s == {"V": (0, 197), "W": (5_000_000, 100)}


def test_shifted_copies_are_aligned(spark):
    x = np.random.default_rng(2).normal(size=300)
    d = 10_000
    rows = [("A", 0, 100.0, x[:200]), ("A", 150 * d + 3 * d, 100.0, x[150:]), ("B", 0, 100.0, x[:50]), ("B", 40 * d, 100.0, x[100:150]), ("C", 100 * d, 100.0, x[100:200]), ("C", 104 * d, 100.0, x[100:180]), ("D", 0, 0.0, x[:3]), ("E", 5, 100.0, x[:3])]
    df = spark.createDataFrame([(i, t, fs, [float(v) for v in q], n) for n, (i, t, fs, q) in enumerate(rows)], "id string, t0_us bigint, fs double, x array<double>, n int")
    got = {r["n"]: r["t0_us"] for r in merge.align_traces(df.unionByName(df.where("n = 0"))).collect()}
    assert got == {0: 0, 1: 150 * d, 2: 0, 3: 40 * d, 4: 100 * d, 5: 100 * d, 7: 5}
    y = merge.merge_traces(merge.align_traces(df.where("id = 'A'"))).orderBy("t0_us").collect()
    assert np.allclose(np.concatenate([r["x"] for r in y]), x)


def test_selection(spark):
    c = spark.createDataFrame([(1, "A.B..BHZ", 1.0, "m"), (2, "A.C..BYZ", 2.0, None), (3, "A.B..BHZ", 1.0, "m"), (4, None, None, None)], "ch bigint, id string, fs double, units string")
    ch = lambda d: sorted(r["ch"] for r in d.collect())
    assert ch(select.by_position(c, [1, 3])) == [1, 3] and ch(select.delete(c, [1])) == [2, 3, 4] and ch(select.delete(c, id="A.B..BHZ")) == [2, 4] and ch(select.delete(c, pattern="C")) == [1, 3, 4]
    a, b = select.pull(c, F.col("id") == "A.B..BHZ")
    assert ch(a) == [1, 3] and ch(b) == [2, 4]
    assert ch(select.append(c, c)) == [1, 2, 3, 4, 5, 6, 7, 8] and ch(select.seismic(c)) == [1, 3] and ch(select.find_pattern(c, "B.Z$")) == [1, 2, 3]
    assert ch(select.replace_rows(c, c.where("ch = 2").withColumn("fs", F.lit(9.0)))) == [1, 2, 3, 4]
    f = {r["id"]: r["ch"] for r in select.find_ids(c, spark.createDataFrame([("A.B..BHZ",), ("no",)], "id string")).collect()}
    assert f == {"A.B..BHZ": 1, "no": 0}
    assert {tuple(r) for r in select.channel_match(c, c.where("ch <> 4"), keys=("id", "fs", "units")).collect()} == {("a", 1, 1, 2), ("a", 3, 1, 2), ("b", 1, 1, 2), ("b", 3, 1, 2), ("a", 2, 2, 1), ("b", 2, 2, 1)}
    d = spark.createDataFrame([("k", 0, 10), ("k", 20, 30), ("l", 0, 9)], "k string, s bigint, e bigint")
    e = spark.createDataFrame([("k", 10, 25), ("k", 5, 5), ("k", 11, 19)], "k string, a bigint, b bigint")
    j = select.interval_join(d, e, "k", ("s", "e"), ("a", "b"), 4)
    assert sorted((r["s"], r["a"]) for r in j.collect()) == [(0, 5), (0, 10), (20, 10)]
    assert "CartesianProduct" not in j._jdf.queryExecution().toString() and "NestedLoop" not in j._jdf.queryExecution().toString()
    x = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "id string, ch bigint")
    assert ch(select.bag_difference(x, x.where("ch = 1"), ["id"], "ch")) == [1, 2, 4]
    s = select.splat(x, spark.createDataFrame([("z", 9.0)], "id string, az double"))
    assert s.count() == 5 and "az" in s.columns


def test_lineage_quake_nodal_synth(spark):
    c = spark.createDataFrame([(1, "A.B..C", "Hill"), (2, "A.D..C", "Lake")], "ch bigint, id string, name string")
    assert [r["ch"] for r in lineage.note(c, "A.B..C was moved").collect()] == [1] and lineage.note(c, "all moved").count() == 2 and [r["ch"] for r in lineage.note(c, "Lake froze").collect()] == [2]
    n = lineage.processed(c, "demean", "mean removed", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    t = lineage.text(n)
    assert t.collect()[0]["note"] == "2020-01-01T00:00:00 ¦ processing ¦ demean ¦ mean removed"
    assert lineage.show(lineage.parse(t), "processing").count() == 2 and lineage.clear(n, c.where("ch = 1")).count() == 2
    e = spark.createDataFrame([("e", 0.0, 0.0)], "event_id string, lat double, lon double")
    loc = "event_id string, ch bigint, loc struct<lat double, lon double>"
    assert quake.distaz(spark.createDataFrame([("e", 1, (0.0, 90.0))], loc), e).collect()[0]["dist"] == pytest.approx(90)
    with pytest.raises(Exception, match="no geographic location"):
        quake.distaz(spark.createDataFrame([("e", 1, None)], loc), e).collect()
    tt = spark.createDataFrame([("P", 0.0, 0.0), ("P", 2.5, 50.0), ("S", 0.0, 9.0)], "phase string, dist double, tt double")
    assert quake.travel_times(spark.createDataFrame([(1, 1.25)], "ch bigint, dist double"), tt).collect()[0]["tt"] == pytest.approx(25)
    m = quake.merge_trace_fields(spark.createDataFrame([("a", 1, 5.0, 0.0, 0.0), ("a", 2, 0.0, 7.0, 0.0)], "id string, te bigint, az double, baz double, dist double"), ["id"], "te").collect()[0]
    assert (m["az"], m["baz"], m["dist"]) == (5, 7, 0)
    tr = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "ch bigint, x array<double>")
    assert nodal.to_nodal(tr).count() == 2 and nodal.append(tr, tr).agg(F.max("ch")).collect()[0][0] == 4
    with pytest.raises(Exception, match="equal lengths"):
        nodal.to_nodal(tr.unionByName(spark.createDataFrame([(3, [1.0])], "ch bigint, x array<double>"))).collect()
    with pytest.raises(TypeError):
        nodal.merge()
    a, b = (synth.traces(synth.channels(spark, 5), 30, 0).orderBy("ch", "seg").collect() for _ in range(2))
    assert a == b and len(a) == 20 and all(len(r["x"]) >= 1 for r in a)


def test_signal_kernels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=64)
    k = np.arange(64)
    h = np.array([sum(x[m] * 2 / 64 / math.tan(math.pi * (n - m) / 64) for m in range(64) if (n - m) % 2) for n in range(64)])
    assert np.allclose(dsp.envelope(x), np.hypot(x, h)) and len(dsp.envelope(np.zeros(0))) == 0
    for family in dsp.FAMILIES:
        for response in dsp.RESPONSES:
            s = dsp.design(50.0, 1.0, 15.0, response=response, family=family)
            assert max(np.abs(np.roots(q[3:])).max() for q in s) < 1
            band = {"Bandpass": (5.0, 0.02), "Bandstop": (0.02, 4.0), "Lowpass": (2.0, 24.5), "Highpass": (20.0, 0.01)}[response]
            g = np.abs(dsp.frequency_response(s, np.array(band), 50.0))
            assert g[0] > 0.35 and g[1] < 0.5
    t = np.arange(4000) / 50
    y = dsp.filtfilt(np.sin(2 * math.pi * 5 * t) + 10, dsp.design(50.0, 1.0, 15.0))
    assert np.abs(y - np.sin(2 * math.pi * 5 * t))[300:-300].max() < 0.02  # no phase shift, no offset
    assert np.isfinite(dsp.filtfilt(rng.normal(size=5), dsp.design(50.0, 1.0, 15.0))).all() and len(dsp.filtfilt(np.zeros(0), s)) == 0
    many = rng.normal(size=(9, 300))
    assert np.allclose(dsp.filtfilt_many(many, s), [dsp.filtfilt(v, s) for v in many]) and np.allclose(dsp.filtfilt_many(many[:, :20], s), [dsp.filtfilt(v, s) for v in many[:, :20]])
    assert len(dsp.resample(x, 50.0, 25.0)) == 32 and np.allclose(dsp.resample(x, 50.0, 50.0), x) and len(dsp.resample(np.zeros(194240), 40.0, 10.0)) == 48560
    old = (3.0, np.zeros(1, complex), np.array([-1 + 2j, -1 - 2j]))
    back = dsp.translate(dsp.translate(np.r_[x, np.zeros(64)], 10.0, dsp.FLAT, old), 10.0, old)
    assert np.corrcoef(back[:64], x - x.mean())[0, 1] > 0.9
    assert np.abs(dsp.detrend_poly(5 + 2 * k + 0.5 * k**2, 2)).max() < 1e-6
