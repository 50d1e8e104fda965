"""Dispatchers, web requests, streams and the SQL surface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import CH, T0, packets
from tremolite import timeaxis
from tremolite.operators import merge, select, synth
from tremolite.sources import dispatch, formats, metadata, web
from tremolite.streaming import packets as live


def test_dispatchers(spark, tmp_path):
    (tmp_path / "a.xml").write_text(metadata.sxml_write([CH, CH | {"id": "CC.VALT.00.BHN"}]))
    m = dispatch.read_meta(spark, str(tmp_path / "a.xml"), "sxml").collect()
    assert [r["id"] for r in m] == ["CC.VALT.00.BHZ", "CC.VALT.00.BHN"] and m[0]["p"][0]["im"] == 2.0 and '"stage": 2' in m[0]["stages"]
    assert dispatch.read_meta(spark, str(tmp_path / "a.xml"), "sxml", end_us=0).count() == 0
    (tmp_path / "d.bin").write_bytes(metadata.dataless_write([CH]))
    assert dispatch.read_meta(spark, str(tmp_path / "d.bin"), "dataless").collect()[0]["gain"] == pytest.approx(CH["gain"])
    e = {"event_id": "e1", "typ": "earthquake", "name": "", "ot_us": T0, "lat": 1.0, "lon": 2.0, "dep": 3.0, "nst": 0, "gap": 0.0, "rms": 0.0, "mag": 5.0, "mag_scale": "Mw", "picks": []}
    (tmp_path / "q.xml").write_text(metadata.qml_write([e]))
    assert dispatch.read_quake(spark, str(tmp_path / "q.xml")).collect()[0]["mag"] == 5.0
    card = "AL2020030600 5010.00 46N5113 121W4562  1.50  4.5"
    card = f"{'AL202003060050':<14}{'10.00':>6} {'46N5113':<8}{'121W4562':<8}{'  1.50':>6} {'4.50':>4}"
    (tmp_path / "p.pick").write_text(card + "\n.VALT.EHZ (P P D 0 12.34 0.05 -0.02)\n")
    h, p = formats.uw_picks((tmp_path / "p.pick").read_text())
    assert h["lat"] == pytest.approx(46 + 5113 / 6000) and h["lon"] < -121 and p[0]["time_s"] == 12.34 and p[0]["station"] == "VALT"
    ts = [formats.piece(id="a", fs=100.0, t0_us=T0, x=np.arange(64) + k) for k in range(3)]
    (tmp_path / "n.tdms").write_bytes(formats.tdms_write(ts, 16))
    n = dispatch.read_nodal(spark, str(tmp_path / "n.tdms"), "tdms", chans=[0, 2], start_s=0.1, end_s=0.2).collect()
    assert sorted(r["id"] for r in n) == ["N0.00000..", "N0.00002.."] and n[0]["n"] == 11 and n[0]["t0_us"] == T0 + 100_000
    assert dispatch.sac_header(formats.sac_write(ts[0]))["i010"] == "64" and dispatch.segy_header(formats.segy_write(ts))["trace_114"] == "64"
    assert dispatch.support(spark).count() == len(dispatch.SUPPORT)
    for f in (dispatch.read_meta, dispatch.read_nodal):
        with pytest.raises(ValueError):
            f(spark, "x", "zzz")


def test_web_requests(spark):
    r = web.parse_channels("UW.TDH.  .EHZ, CC.VALT..BHZ,CC.VALT..BHN\nCC.PALM")
    assert r[0] == ("UW", "TDH", "*", "EHZ") and r[3] == ("CC", "PALM", "*", "*")
    assert web.compact(r) == [("CC", "PALM", "*", "*"), ("CC", "VALT", "*", "BHN,BHZ"), ("UW", "TDH", "*", "EHZ")]
    w = web.windows(0, 25 * 3_600_000_000, 0.5)
    assert w == [(0, 43_200_000_000), (43_200_000_001, 86_400_000_000), (86_400_000_001, 90_000_000_000)]
    plan = web.plan("CC.A..Z,CC.B..N", 0, 1_000_000)
    assert "start=1970-01-01T00:00:00" in plan[0].url() and "net=CC" in plan[0].url()

    def fetch(q):
        if q.sta == "A":
            raise OSError("refused")
        return formats.mseed_write([formats.piece(id="CC.B..N", fs=10.0, t0_us=0, x=np.arange(10))], 3)

    got = {x["id"]: x for x in web.fetch_all(spark, plan, fetch).collect()}
    assert got["CC.B..N"]["n"] == 10 and got["XX.FAIL..001"]["misc"]["error"] == "refused"
    s = spark.createDataFrame([("A", 10 * k, float(k)) for k in (0, 1, 2, 5)], "id string, t_us bigint, x double")
    d = web.finish(s, ["id"], 10, 1e5, demean=True, ungap=True)
    assert d.count() == 6 and abs(d.agg(F.sum("x")).collect()[0][0]) < 1e-9
    assert [r["live"] for r in web.live_stations(spark.createDataFrame([("A.B..C", 10)], "id string, end_us bigint"), 20, ["A.B", "X.Y"]).orderBy("station").collect()] == [True, False]


def test_packet_stream_equals_batch(spark, tmp_path):
    from tremolite.sources.datasource import WaveformSource

    folder = tmp_path / "in"
    folder.mkdir()
    packets(folder)
    spark.dataSource.register(WaveformSource)
    s = spark.readStream.format("waveform").option("fmt", "mseed").option("maxFilesPerTrigger", 2).load(f"{folder}/*.mseed")
    p = lambda d: d.select("id", F.col("t0_us").alias("ord"), "t0_us", "n", timeaxis.delta_us("fs").alias("dt_us"))
    q = live.segments_stream(p(s)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.read.schema(live.OUT).parquet(str(tmp_path / "out")).agg(F.sum("n")).collect()[0][0] == 900:
                break
    finally:
        q.stop()
    got = sorted(map(tuple, spark.read.schema(live.OUT).parquet(str(tmp_path / "out")).collect()))
    batch = p(spark.read.format("waveform").option("fmt", "mseed").load(f"{folder}/*.mseed"))
    want = sorted(map(tuple, live.segments_batch(batch).collect()))
    assert got == want and max(r[1] for r in got) == 1 and sum(r[5] for r in got) == 900


def test_continuation_goldens():
    d, at, s = 10_000, 1_583_020_800_000_000, None
    for off, n in ((0, 1000), (10, 999), (20.01, 1), (20.02, 100)):
        rows, s = live.continue_channel(s, [(at + round(off * 1e6), n, d)])
    assert s[1] == 2100 and s[2] == 1 and rows[0][5] == 0
    rows, s2 = live.continue_channel((at, 5, 0), [(at - 10 * d, 3, d), (at, 0, d)])
    assert rows[0][0] == 1 and rows[0][5] < 0 and s2[1] == 8  # late packets open a segment of their own


def test_sql_surface_and_asof(spark):
    from tremolite.plans import sqlapi

    sqlapi.register(spark)
    t = spark.createDataFrame([([(1, 0), (6, 980000), (8, 100000), (10, 0)],)], "t array<struct<i bigint, us bigint>>")
    sqlapi.views(spark, tt=t)
    rows = spark.sql("SELECT e.* FROM tt, LATERAL t_expand(t, 10000) e ORDER BY i").collect()
    assert [r["t_us"] for r in rows] == [0, 10000, 20000, 30000, 40000, 1030000, 1040000, 1150000, 1160000, 1170000]
    assert spark.sql("SELECT inst_code('A.B..EHZ') a, grid_slot(149, 100) b, grid_slot(-51, 100) c, julian_day(2020, 3, 1) d, canonical_id('a_b__c') e").collect()[0] == ("H", 100, -100, 61, "A.B..C")
    a = spark.createDataFrame([("k", 5), ("k", 10), ("l", 1), (None, 1)], "k string, t bigint")
    b = spark.createDataFrame([("k", 5, 1.0), ("k", 7, None), ("k", 9, 2.0), ("l", 2, 3.0)], "k string, t bigint, v double")
    assert sorted((r["t"], r["v"]) for r in select.asof_join(a, b, "k", "t", "v").where("k = 'k'").collect()) == [(5, 1.0), (10, 2.0)]
    e = select.as_event_traces(a)
    assert select.as_channels(e).columns == a.columns and select.without_flagged(a.withColumn("flagged", F.col("t") > 5)).count() == 3
    assert synth.events(spark, 4).count() == 4
    x = spark.createDataFrame([("A", 0, 1.0, [1.0])], "id string, t0_us bigint, fs double, x array<double>")
    assert merge.merge_many(x, x).collect()[0]["x"] == [1.0]
