"""Options of operators, compositions, stream modes and tables beside the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import T0, packets
from tests.test_time_and_process import got, series
from tremolite.operators import dsp, merge, process, quake
from tremolite.sources import store, web
from tremolite.sources.datasource import PacketStream


def test_demean_leaves_irregular_channels(spark):
    s = series(spark, [1, 3], id="A").withColumn("fs", F.lit(1.0)).unionByName(series(spark, [1, 3], id="B").withColumn("fs", F.lit(0.0)))
    assert got(process.demean(s, ["id"], "fs")) == {("A", 0): -1, ("A", 10): 1, ("B", 0): 1, ("B", 10): 3}
    assert got(process.demean(s, ["id"], "fs", irr=True))["B", 0] == -1


def test_ungap_tapers_first(spark):
    s = series(spark, [5.0] * 50 + [9.0] * 50, skip=(50,), step=1_000_000)
    a, b = got(process.ungap(s, ["id"], 1_000_000)), got(process.ungap(s, ["id"], 1_000_000, tap=True))
    assert a.keys() == b.keys() and a["A", 0] == 5.0 and b["A", 0] == pytest.approx(np.mean([5.0] * 50 + [9.0] * 49))


def test_resampling_to_the_lowest_rate(spark):
    x = [float(v) for v in np.sin(np.arange(400) / 20)]
    t = spark.createDataFrame([("a", 0, 20.0, x), ("b", 0, 40.0, x + x)], "id string, t0_us bigint, fs double, x array<double>")
    r = {q["id"]: q for q in dsp.resample_traces(t).collect()}
    assert r["a"]["fs"] == r["b"]["fs"] == 20.0 and len(r["a"]["x"]) == 400 and abs(len(r["b"]["x"]) - 400) <= 1
    assert dsp.resample_traces(t.where("fs > 99")).count() == 0


def test_acceleration_responses_get_two_zeros(spark):
    resp = (1.0, [(-0.5, 0.0), (-900.0, 0.0)], [])
    kind = "id string, fs double, units string, resp struct<a0 double, p array<struct<re double, im double>>, z array<struct<re double, im double>>>, x array<double>"
    x = [float(v) for v in np.random.default_rng(0).normal(size=64)]
    t = spark.createDataFrame([("a", 10.0, "m/s2", resp, x), ("b", 10.0, "m/s", resp, x)], kind)
    same = spark.createDataFrame([("a", 10.0, "m/s", (1.0, [(-0.5, 0.0)], [(0.0, 0.0), (0.0, 0.0)]), x)], kind)
    r = {q["id"]: q["x"] for q in dsp.translate_traces(t).collect()}
    assert np.allclose(r["a"], dsp.translate_traces(same).collect()[0]["x"]) and not np.allclose(r["a"], r["b"])


def test_channels_merge_where_their_headers_agree(spark):
    h = "ch bigint, id string, fs double, gain double, units string"
    c = spark.createDataFrame([(1, "A", 1.0, 2.0, None)], h)
    d = spark.createDataFrame([(1, "A", 1.0, 2.0, "m"), (2, "A", 1.0, 3.0, "m"), (3, "B", 1.0, 2.0, "m")], h)
    t = "ch bigint, t0_us bigint, fs double, x array<double>"
    ct = spark.createDataFrame([(1, 0, 1.0, [1.0, 2.0])], t)
    dt = spark.createDataFrame([(1, 1_000_000, 1.0, [4.0, 5.0]), (2, 0, 1.0, [99.0]), (3, 0, 1.0, [99.0])], t)
    r = merge.merge_matching(c, ct, d, dt).collect()
    assert len(r) == 1 and r[0]["id"] == "A" and r[0]["x"] == [1.0, 3.0, 5.0]


def test_event_table(spark):
    e = spark.createDataFrame([("e", 100, 0.0, 0.0)], "event_id string, ot_us bigint, lat double, lon double")
    c = spark.createDataFrame([("e", "A", (0.0, 5.0)), ("e", "B", (0.0, 7.0))], "event_id string, id string, loc struct<lat double, lon double>")
    s = spark.createDataFrame([("A", k * 10, 1.0) for k in range(30)], "id string, t_us bigint, x double")
    r = {q["id"]: q for q in quake.event_table(e, c, s, 20, 50).collect()}
    assert r["A"]["n"] == 8 and r["A"]["t0_us"] == 80 and r["B"]["n"] == 0 and r["A"]["dist"] == pytest.approx(5.0) and r["A"]["tt"] is None
    table = spark.createDataFrame([("P", float(k), 10.0 * k) for k in range(10)], "phase string, dist double, tt double")
    assert {q["id"]: round(q["tt"], 6) for q in quake.event_table(e, c, s, 20, 50, table).collect()} == {"A": 50.0, "B": 70.0}


def test_tables_beside_the_store(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = lambda *v: spark.createDataFrame(v, "event_id string, mag double")
    store.write_table(rows(("a", 1.0), ("b", 2.0)), path, "event_id")
    store.write_table(rows(("b", 9.0), ("c", 3.0)), path, "event_id", "add")
    store.write_table(rows(("a", 7.0)), path, "event_id", "ovr")
    assert {r["event_id"]: r["mag"] for r in spark.read.parquet(path).collect()} == {"a": 7.0, "b": 2.0, "c": 3.0}
    with pytest.raises(ValueError):
        store.write_table(rows(("a", 7.0)), path, "event_id", "zzz")


def test_stream_modes(tmp_path):
    packets(tmp_path, 3)
    live = PacketStream({"path": f"{tmp_path}/*.mseed", "fmt": "mseed", "mode": "data", "log": str(tmp_path / "l1")})
    at = live.initialOffset()
    assert live.latestOffset() == at
    packets(tmp_path, 5)
    new = live.partitions(at, live.latestOffset())
    assert {"p003.mseed", "p004.mseed"} <= {p.path.rsplit("/", 1)[1] for p in new}
    some = PacketStream({"path": f"{tmp_path}/*.mseed", "fmt": "mseed", "mode": "time", "start_us": str(T0 + 3_100_000), "end_us": str(T0 + 3_200_000), "log": str(tmp_path / "l2")})
    rows = [r for p in some.partitions({"n": 0}, some.latestOffset()) for r in some.read(p)]
    assert rows and all(r[11] <= T0 + 3_200_000 for r in rows) and len(rows) < 5
    with pytest.raises(ValueError):
        PacketStream({"path": str(tmp_path), "mode": "zzz"})


def test_servers_and_download_order(spark):
    assert web.server("IRIS") == "http://service.iris.edu/fdsnws" and web.server("IRISPH5") == "http://service.iris.edu/ph5ws" and web.server("http://my.host/x/") == "http://my.host/x" and "ODC" in web.SERVERS
    s = spark.createDataFrame([("A.B..BHZ", 10 * k, float(k)) for k in range(4)] + [("A.B..BYZ", 10 * k, 5.0) for k in range(4)] + [("A.C..BHZ", 0, float("nan"))], "id string, t_us bigint, x double")
    r = got(web.finish(s, ["id"], 10, 1e5, prune=True, demean=True, seismic_only=True))
    assert r["A.B..BHZ", 0] == -1.5 and r["A.B..BYZ", 0] == 5.0 and len(r) == 8
    flat = spark.createDataFrame([("A.B..BHZ", (2.0, [], []))], "id string, resp struct<a0 double, p array<struct<re double, im double>>, z array<struct<re double, im double>>>")
    q = got(web.finish(s.where("id <> 'A.C..BHZ'"), ["id"], 10, 1e5, rr=flat))
    assert q["A.B..BYZ", 10] == 5.0 and len(q) == 8
