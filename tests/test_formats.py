"""Round trips of file formats: what is written is read back."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolite.sources import codecs
from tremolite.sources import formats as f

T0 = 1_583_455_810_004_000


def one(n=500, fs=50.0, t0=T0, ints=True, **kw):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(-300, 300, n)) if ints else rng.normal(size=n)
    return f.piece(**({"id": "XX.STA.00.BHZ", "fs": fs, "t0_us": t0, "x": x} | kw))


@given(st.lists(st.integers(-(2**28), 2**28), min_size=1, max_size=300), st.sampled_from([1, 2]))
@settings(max_examples=60, deadline=None)
def test_steim(xs, version):
    x = np.array(xs)
    y, ok = codecs.steim(codecs.steim_encode(x, version), len(x), version)
    assert ok and (x == y).all()


def test_steim_integrity_is_reported():
    b = bytearray(codecs.steim_encode(np.arange(40), 1))
    b[11] ^= 1
    assert codecs.steim(bytes(b), 40, 1)[1] is False


@pytest.mark.parametrize("enc", [1, 3, 4, 5, 10, 11])
def test_mseed(enc):
    p = one(1000)
    p["x"] = np.clip(p["x"], -32000, 32000)
    rs = f.mseed_records(f.mseed_write([p], enc))
    assert np.array_equal(np.concatenate([r["x"] for r in rs]), p["x"])
    assert {r["id"] for r in rs} == {p["id"]} and rs[0]["t0_us"] == p["t0_us"] and rs[0]["fs"] == p["fs"]
    d = np.diff([r["t0_us"] for r in rs])
    assert (d == [r["n"] * 20000 for r in rs[:-1]]).all()
    assert all(len(r["x"]) == 0 and r["n"] for r in f.mseed_records(f.mseed_write([p], enc), headers_only=True))


@pytest.mark.parametrize("fs", [0.1, 1.0, 62.5, 100.0])
def test_mseed_rates(fs):
    assert f.mseed_records(f.mseed_write([one(60, fs)], 3))[0]["fs"] == pytest.approx(fs)


@pytest.mark.parametrize("version", [6, 7])
@pytest.mark.parametrize("order", ["<", ">"])
def test_sac(version, order):
    p = one(300, ints=False, lat=46.85, lon=-121.76, el=4392.0, az=90.0, inc=45.0, gain=32.0)
    q = f.sac_read(f.sac_write(p, version, order))[0]
    assert np.allclose(q["x"], p["x"], atol=1e-6) and q["id"] == p["id"] and q["t0_us"] == p["t0_us"] and q["fs"] == pytest.approx(50.0)
    assert q["lat"] == pytest.approx(46.85, abs=1e-5) and q["gain"] == 32.0
    e = f.sac_write(p, version, order, {"event_id": "ev000001x", "lat": 1.5, "lon": 2.5, "dep": 10.0, "mag": 4.5, "ot_us": p["t0_us"] - 3_000_000, "dist": 12.0})
    head = np.frombuffer(e, order + "f4", 70)
    assert head[35] == 1.5 and head[39] == 4.5 and head[53] == 12.0 and head[7] == pytest.approx(-3.0, abs=1e-3) and e[448:464] == b"ev000001x       "
    assert f.sac_name(p) == "2020.066.00.50.10.004.XX.STA.00.BHZ.R.SAC"


@pytest.mark.parametrize("fmt", [1, 2, 3, 5])
def test_segy(fmt):
    ps = [one(200, lat=46.5, lon=-121.25, el=10.0, t0=T0 // 1_000_000 * 1_000_000) for _ in range(3)]
    for p in ps:
        p["x"] = np.clip(p["x"], -32000, 32000)
    qs = f.segy_read(f.segy_write(ps, fmt))
    assert len(qs) == 3 and all(np.allclose(q["x"], p["x"]) and q["t0_us"] == p["t0_us"] for q, p in zip(qs, ps))
    assert qs[0]["lat"] == pytest.approx(46.5) and len(f.segy_read(f.segy_write(ps, fmt), 1, 2)) == 1


def test_ibm_float():
    x = np.array([0.0, 1.0, -1.0, 118.625, -0.15625, 1e-10, 7e20])
    assert np.allclose(codecs.ibm_float(codecs.to_ibm(x)), x, rtol=1e-6)
    assert codecs.ibm_float(np.array([0xC276A000]))[0] == -118.625


def test_other_binaries():
    p = one(120, 20.0, lat=1.0, lon=2.0, el=3.0)
    q = f.ah2_read(f.ah2_write(p) * 2)
    assert len(q) == 2 and np.allclose(q[1]["x"], p["x"]) and q[0]["fs"] == 20.0 and abs(q[0]["t0_us"] - p["t0_us"]) <= 1
    b = one(50, 1.0)
    b["x"] = np.where(np.arange(50) == 7, np.nan, b["x"])
    q = f.bottle_read(f.bottle_write(b), "/x/B001220000CH1")[0]
    assert np.isnan(q["x"][7]) and q["id"] == "PB.B001..CH1" and np.array_equal(q["x"][8:], b["x"][8:])
    ps = [one(100, 20.0, T0 // 1_000_000 * 1_000_000, misc={"hex_id": h}) for h in ("01A0", "01A1")]
    qs = f.win32_read(f.win32_write(ps))
    assert [q["misc"]["hex_id"] for q in qs] == ["01A0", "01A1"] and all(np.array_equal(q["x"], p["x"]) and q["t0_us"] == p["t0_us"] for q, p in zip(qs, ps))
    q = f.uw_read(f.uw_write([p]))[0]
    assert np.array_equal(q["x"], p["x"]) and q["t0_us"] == p["t0_us"] and q["fs"] == 20.0
    q = f.suds_read(f.suds_write([p]))[0]
    assert np.allclose(q["x"], p["x"]) and q["lat"] == 1.0 and q["fs"] == 20.0
    ts = [one(64, 100.0) for _ in range(3)]
    for k, t in enumerate(ts):
        t["x"] = np.clip(t["x"] + k, -32000, 32000)
    raw = f.tdms_write(ts, 16)
    assert all(np.array_equal(q["x"], t["x"]) for q, t in zip(f.tdms_read(raw), ts))
    part = f.tdms_read(raw, ts[0]["t0_us"] + 200_000, ts[0]["t0_us"] + 300_000)
    assert part[0]["t0_us"] == ts[0]["t0_us"] + 160_000 and len(part[0]["x"]) == 16


def test_texts():
    p = one(30, ints=False, units="m/s")
    for q in (f.geocsv_read(f.geocsv_write(p))[0], f.geocsv_read(f.geocsv_write(p, False))[0], f.slist_read(f.slist_write(p))[0]):
        assert np.allclose(q["x"], p["x"]) and q["t0_us"] == p["t0_us"] and q["fs"] == 50.0 and q["id"] == p["id"]
    gap = f.geocsv_write(p).splitlines()
    del gap[15:20]
    assert len(f.geocsv_read("\n".join(gap))) == 2
    q = f.lennartz_read("MHR1 10.000 ms 2013-01-02 03:04:05.5 counts\n1\n2\n3\n", "a/b.BHE")[0]
    assert q["fs"] == 100.0 and q["id"] == ".MHR1..BHE" and q["x"].tolist() == [1, 2, 3]


def test_packed_and_guess():
    assert codecs.packed_differences(bytes([0x1F, 0x70]), 3, 0.5).tolist() == [1, -1, 7]
    assert codecs.packed_differences(bytes([0xFF, 0xFF, 0xFE, 0, 0, 5]), 2, 3).tolist() == [-2, 5]
    p = one(1000)
    for name, raw in {"mseed": f.mseed_write([p], 10), "sac": f.sac_write(p), "segy": f.segy_write([p]), "ah2": f.ah2_write(p), "suds": f.suds_write([p]), "slist": f.slist_write(p).encode(), "geocsv": f.geocsv_write(p).encode(), "bottle": f.bottle_write(p), "tdms": f.tdms_write([f.piece(id="a", fs=1.0, t0_us=0, x=np.zeros(16))], 16), "unknown": b"nothing"}.items():
        assert f.guess(raw) == name
