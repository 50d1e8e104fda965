"""Metadata round trips, the data source, the store and streams."""

import numpy as np
import pytest

from tremolite.sources import formats as f
from tremolite.sources import metadata as m

T0 = 1_583_455_810_004_000
CH = {"id": "CC.VALT.00.BHZ", "name": "Valley & <Top>", "start_us": T0 // 1_000_000 * 1_000_000, "end_us": f.iso_us("2030-01-01T00:00:00"), "lat": 46.5, "lon": -121.25, "el": 1500.0, "dep": 2.0, "az": 90.0, "inc": 45.0, "fs": 50.0, "gain": 1.5e9, "units": "m/s", "a0": 2.5, "f0": 1.0, "p": [{"re": -1.0, "im": 2.0}, {"re": -1.0, "im": -2.0}], "z": [{"re": 0.0, "im": 0.0}], "stages": [{"stage": 1, "gain": 1500.0, "fg": 1.0, "fs": 0.0, "fac": 0, "os": 0, "delay": 0.0, "corr": 0.0}, {"stage": 2, "gain": 1e6, "fg": 1.0, "fs": 100.0, "fac": 2, "os": 0, "delay": 0.5, "corr": 0.5}]}


def same(a, b, keys):
    for k in keys:
        assert a[k] == (pytest.approx(b[k], rel=1e-5) if isinstance(b[k], float) else b[k]), k


def test_station_xml_round_trip_and_epochs():
    text = m.sxml_write([CH, CH | {"id": "CC.VALT.00.BHN"}])
    got = m.sxml_read(text)
    assert len(got) == 2
    same(got[0], CH, CH.keys())
    assert m.sxml_read(text, end_us=CH["start_us"] - 1) == [] and len(m.sxml_read(text, start_us=CH["end_us"])) == 2


def test_quake_ml_prefers_and_round_trips():
    e = {"event_id": "ev1", "typ": "earthquake", "name": "x", "ot_us": T0, "lat": 1.5, "lon": -2.5, "dep": 10.0, "nst": 7, "gap": 90.0, "rms": 0.5, "mag": 4.5, "mag_scale": "Mw", "picks": [{"id": "CC.VALT.00.BHZ", "phase": "P", "us": T0 + 5, "d": 1.0, "res": 0.25}]}
    text = m.qml_write([e])
    got = m.qml_read(text)[0]
    same(got, e, [k for k in e if k != "picks"])
    assert got["picks"][0]["id"] == "CC.VALT.00.BHZ" and got["picks"][0]["us"] == T0 + 5
    other = text.replace("<origin ", '<origin publicID="smi:local/origin/none"><time><value>2000-01-01T00:00:00Z</value></time><latitude><value>9</value></latitude></origin><origin ', 1)
    assert m.qml_read(other)[0]["lat"] == 1.5


def test_sacpz_and_dataless_round_trip():
    keys = ("id", "name", "start_us", "end_us", "lat", "lon", "el", "az", "inc", "fs", "gain", "a0", "p", "z")
    got = m.sacpz_read(m.sacpz_write([CH, CH | {"id": "CC.VALT.00.BHN"}]))
    assert len(got) == 2
    same(got[1], CH | {"id": "CC.VALT.00.BHN"}, keys)
    got = m.dataless_read(m.dataless_write([CH, CH | {"id": "CC.VALT..BHE", "units": "m"}]))
    assert [c["id"] for c in got] == ["CC.VALT.00.BHZ", "CC.VALT..BHE"] and got[1]["units"] == "m"
    same(got[0], CH, keys)


def test_resp():
    text = """B050F03     Station:     VALT
B050F16     Network:     CC
B052F03     Location:    ??
B052F04     Channel:     BHZ
B052F22     Start date:  2006,001,00:00:00
B052F23     End date:    No Ending Time
B053F03     Transfer function type:  A [Laplace Transform (Rad/sec)]
B053F04     Stage sequence number:   1
B053F05     Response in units lookup:  M/S - velocity
B053F07     A0 normalization factor:  5.714e8
B053F08     Normalization frequency:  1.0
B053F10-13    0  0.0e0  0.0e0  0.0e0  0.0e0
B053F15-18    0  -1.5e2  2.5e1  0.0e0  0.0e0
B058F03     Stage sequence number:  1
B058F04     Gain:  1500.0
B057F03     Stage sequence number:  2
B057F04     Input sample rate:  100.0
B057F05     Decimation factor:  2
B058F03     Stage sequence number:  0
B058F04     Sensitivity:  6.0e8
"""
    c = m.resp_read(text)[0]
    assert c["id"] == "CC.VALT..BHZ" and c["gain"] == 6e8 and c["p"] == [{"re": -150.0, "im": 25.0}] and c["units"] == "M/S" and c["start_us"] == f.iso_us("2006-01-01T00:00:00")
    assert [s["stage"] for s in c["stages"]] == [1, 2] and c["stages"][1]["fac"] == 2


def packets(folder, n=6):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.integers(-9, 9, 900))
    skip = 0
    for k in range(n):
        skip += 2_000_000 if k == 3 else 0
        p = f.piece(id="XX.A..BHZ", fs=50.0, t0_us=T0 + k * 150 * 20_000 + skip, x=x[k * 150 : k * 150 + 150])
        (folder / f"p{k:03d}.mseed").write_bytes(f.mseed_write([p], 10))
    return x


def test_data_source_splits_and_windows(spark, tmp_path):
    from tremolite.sources.datasource import read_data, write_sac

    x = packets(tmp_path)
    df = read_data(spark, f"{tmp_path}/*.mseed", "mseed")
    rows = df.orderBy("t0_us").collect()
    assert np.array_equal(np.concatenate([r["x"] for r in rows]), x) and {r["id"] for r in rows} == {"XX.A..BHZ"}
    big = tmp_path / "all.bin"
    big.write_bytes(b"".join((tmp_path / f"p{k:03d}.mseed").read_bytes() for k in range(6)))
    cut = read_data(spark, str(big), "auto", split=600)
    assert cut.rdd.getNumPartitions() > 3 and sum(r["n"] for r in cut.select("n").collect()) == len(x)
    few = read_data(spark, str(big), "mseed", start_us=T0 + 10_000_000, end_us=T0 + 11_000_000)
    assert 0 < few.count() < len(rows)
    from tremolite.sources.datasource import guess_files

    assert {r["format"] for r in guess_files(spark, f"{tmp_path}/*").collect()} == {"mseed"}
    out = tmp_path / "sac"
    done = write_sac(df, str(out)).collect()
    assert sum(r["samples"] for r in done) == len(x) and len(list(out.iterdir())) == len(done)
    assert read_data(spark, f"{tmp_path}/none*").count() == 0


def test_store_modes(spark, tmp_path):
    from tremolite.sources import store

    path = str(tmp_path / "s")
    rows = lambda *v: spark.createDataFrame(v, "id string, t_us bigint, x double")
    store.write(rows(("A.B..Z", 0, 1.0), ("A.B..Z", 86_400_000_000, 2.0), ("A.C..Z", 5, 3.0)), path)
    store.write(rows(("A.B..Z", 0, 9.0), ("A.B..Z", 7, 8.0)), path, "add")
    got = {(r["id"], r["t_us"]): r["x"] for r in store.read(spark, path).collect()}
    assert got == {("A.B..Z", 0): 1.0, ("A.B..Z", 7): 8.0, ("A.B..Z", 86_400_000_000): 2.0, ("A.C..Z", 5): 3.0}
    store.write(rows(("A.B..Z", 0, 9.0)), path, "ovr")
    assert {r["x"] for r in store.read(spark, path, "A.B*", 0, 6).collect()} == {9.0}
    assert sorted(r[0] for r in store.scan(spark, path).collect()) == ["A.B", "A.C"]
    assert store.version(spark, path) is None
    store.set_version(spark, path, "0.54")
    assert store.version(spark, path) == "0.54" and store.scan(spark, path).count() == 2
    ev = spark.createDataFrame([("e", 3), ("f", 10**15)], "event_id string, ot_us bigint")
    assert store.read_event(spark, path, ev, "e", 3, 5).count() == 3
    with pytest.raises(Exception):
        store.write(rows(("A.B..Z", 0, 9.0)), path)


def test_store_keeps_ids_of_any_shape(spark, tmp_path):
    from tremolite.sources import store

    path = str(tmp_path / "s")
    rows = lambda *v: spark.createDataFrame(v, "id string, t_us bigint, x double")
    ids = ("click", "007", "007.1", "", None, "A.B..Z")
    store.write(rows(*[(i, t, 1.0) for i in ids for t in (0, 1, 2)]), path)
    store.write(rows(*[(i, 1, 5.0) for i in ids]), path, "ovr")
    store.write(rows(*[(i, 3, 7.0) for i in ids]), path, "add")
    got = store.read(spark, path).collect()
    assert sorted((str(r["id"]), r["t_us"], r["x"]) for r in got) == sorted((str(i), t, x) for i in ids for t, x in ((0, 1.0), (1, 5.0), (2, 1.0), (3, 7.0)))


def mixed(n: int = 40) -> tuple[bytes, int]:
    """Records of 512, 4096 and 256 bytes in turn, with their number of samples."""
    rng = np.random.default_rng(4)
    out, total = [], 0
    for k in range(n):
        x = np.cumsum(rng.integers(-9, 9, 60 + 50 * (k % 3)))
        r = f.mseed_write([f.piece(id=f"XX.A{k % 2}..BHZ", fs=50.0, t0_us=T0 + k * 60_000_000, x=x)], 3, (9, 12, 8)[k % 3])
        out.append(r)
        total += len(x)
    return b"".join(out), total


@pytest.mark.parametrize("split", [64, 512, 700, 2048, 5000, 100_000])
def test_records_of_mixed_lengths_are_split_whole(spark, tmp_path, split):
    from tremolite.sources import datasource as ds

    data, total = mixed()
    p = tmp_path / "m.mseed"
    p.write_bytes(data)
    whole = sorted((r[1], r[11], r[12]) for r in ds.read_range("mseed", str(p)))
    r = ds.WaveformReader({"path": str(p), "fmt": "mseed", "split": split})
    got = sorted((x[1], x[11], x[12]) for part in r.partitions() for x in r.read(part))
    assert got == whole and sum(n for _, _, n in got) == total
    if split == 700:
        assert sorted((x["id"], x["t0_us"], x["n"]) for x in ds.read_data(spark, str(p), "auto", split=split).collect()) == whole


def test_split_records_longer_than_what_is_read_beyond_a_split(tmp_path, monkeypatch):
    from tremolite.sources import datasource as ds

    data, total = mixed(9)
    (tmp_path / "m.mseed").write_bytes(data)
    monkeypatch.setattr(ds, "BEYOND", 64)
    r = ds.WaveformReader({"path": str(tmp_path / "m.mseed"), "fmt": "mseed", "split": 128})
    assert sum(x[12] for part in r.partitions() for x in r.read(part)) == total


def test_a_file_that_comes_late_with_an_early_name_is_read_once(spark, tmp_path):
    from tremolite.sources.datasource import PacketStream

    src, land = tmp_path / "src", tmp_path / "land"
    src.mkdir(), land.mkdir()
    packets(src)
    opts = {"path": f"{land}/*.mseed", "fmt": "mseed", "maxFilesPerTrigger": "2"}
    s, read, at = PacketStream(opts), [], PacketStream(opts).initialOffset()

    def go(s, at):
        while (end := s.latestOffset()) != at:
            for part in s.partitions(at, end):
                read.append(part.path.rsplit("/", 1)[1])
            at = end
        return at

    for names in (("p003", "p004", "p005"), ("p000",), ("p002", "p001")):
        for n in names:
            (land / f"{n}.mseed").write_bytes((src / f"{n}.mseed").read_bytes())
        at = go(s, at)
        s = PacketStream(opts)  # a restart forgets nothing
    assert sorted(read) == [f"p{k:03d}.mseed" for k in range(6)] and len(read) == 6
    assert s.partitions({"n": 0}, at)[0].path.endswith(read[0]) and s.latestOffset() == at
    other = PacketStream(opts)
    assert sum(1 for _ in other.partitions({"n": 0}, other.latestOffset())) == 6


def test_remote_paths_and_scans(spark, tmp_path):
    from tremolite.sources import datasource as ds

    x = packets(tmp_path)
    uri = f"file://{tmp_path}/p*.mseed"
    assert ds.listing(uri) == [f"file://{tmp_path}/p{k:03d}.mseed" for k in range(6)] and ds.listing(f"file://{tmp_path}") == ds.listing(uri)
    assert ds.read_data(spark, uri, "mseed").select("n").groupBy().sum().collect()[0][0] == len(x)
    big = tmp_path / "all.bin"
    big.write_bytes(b"".join((tmp_path / f"p{k:03d}.mseed").read_bytes() for k in range(6)))
    assert [tuple(r)[1:] for r in ds.scan(spark, str(big), "mseed", split=512).collect()] == [("XX.A..BHZ", len(x), 1, 1)]
