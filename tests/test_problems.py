"""The general data problems against brute force on small fixtures, and their edge cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite import timeaxis
from tremolite.operators import drift, intervals, regular, spikes, unitgraph

INF, NAN = float("inf"), float("nan")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- 1: control charts

READ = "rd_id bigint, id string, run_id bigint, t bigint, x double, arrived timestamp"
RUNS = "run_id bigint, id string, fs double, units string, src string, notes array<string>"


def readings(spark, series, extra=()):
    """series: {run: (id, values)} one reading a second."""
    out, k = [], 0
    for run, (i, xs) in series.items():
        for n, x in enumerate(xs):
            k += 1
            out.append((k, i, run, n * 1_000_000, None if x is None else float(x), None))
    return spark.createDataFrame(out + list(extra), READ)


def runs(spark, units):
    return spark.createDataFrame([(r, f"C{r}", 1.0, u, None, []) for r, u in units.items()], RUNS)


def noise(n, seed=0, s=10.0):
    return np.rint(np.random.default_rng(seed).normal(0, s, n))


def test_spikes_stuck_and_impossible(spark):
    a = noise(900, 1)
    a[100] += 200
    a[200], a[201] = a[200] + 150, a[201] + 160  # two in succession
    a[300], a[301] = 300, -300  # on either side
    a[400:412] = 7  # stuck
    a[500:509] = 3  # nine are not
    a[399], a[412], a[499], a[509] = 20, -15, 20, -15
    a[600] = 9e6  # beyond a 24-bit digitizer
    burst = 400 * np.sin(np.arange(80) * 2 * math.pi / 20) * np.hanning(80)
    a[700:780] += burst  # genuine
    b = 290 + np.round(np.random.default_rng(2).normal(0, 0.5, 300), 2)
    b[50], b[60] = -5.0, INF
    df = spikes.flagged(readings(spark, {1: ("A", a), 2: ("B", b)}), runs(spark, {1: "{counts}", 2: "K"}))
    got = {(r["id"], r["t_us"] // 1_000_000): r["reason"] for r in df.collect()}
    want = {("A", 100): "spike", ("A", 200): "spike", ("A", 201): "spike", ("A", 300): "spike", ("A", 301): "spike", ("A", 600): "impossible", ("B", 50): "impossible", ("B", 60): "impossible"}
    want |= {("A", k): "stuck" for k in range(400, 412)}
    assert got == want


def test_shards_and_repeats_do_not_matter(spark):
    a = noise(1500, 3)
    for k in (5, 255, 256, 511, 767, 1023, 1498):
        a[k] += 300
    a[505:520] = a[505]
    a[1010:1030] = 4
    df = readings(spark, {1: ("A", a)})
    whole = rows(spikes.flagged(df, runs(spark, {1: "counts"})), "id", "t_us", "reason")
    twice = df.unionByName(df.withColumn("rd_id", F.col("rd_id") + 10_000))
    cut = rows(spikes.flagged(twice, runs(spark, {1: "counts"}), shard=256, halo=64), "id", "t_us", "reason")
    assert whole == cut and len(whole) == 5 + 15 + 20


def test_readings_edge_cases(spark):
    u = runs(spark, {1: "counts"})
    assert rows(spikes.flagged(spark.createDataFrame([], READ), u), "id") == []
    odd = [(9, None, 1, 5, 1e30, None), (10, "Z", None, 5, 1e30, None), (11, "Z", 77, None, 1e30, None), (12, "Z", 77, 6, NAN, None), (13, "Z", 77, 7, None, None)]
    df = readings(spark, {1: ("A", [1, 1, 1])}, odd).withColumn("units", F.lit("x")).withColumn("bad", F.lit(1)).withColumn("k", F.lit(1))
    assert rows(spikes.flagged(df, u.withColumn("n", F.lit(1))), "id", "t_us", "reason") == [("Z", 5, "impossible")]


def test_chart_clips_suspects():
    r = np.random.default_rng(0).normal(0, 1, 3000)
    r[1000] = 1e6
    (m, s), (m2, s2) = spikes.charts([r, r[:50]])
    assert abs(m[1001] - m[1000]) < 0.1 and 0.7 < s[1500] < 1.4 and len(s2) == 50


def test_last_digit_and_stuck_range():
    assert spikes.last_digit(np.array([1.0, 2.0])) == 1.0 and spikes.last_digit(np.array([1.25, 2.0])) == 0.01 and spikes.last_digit(np.array([1e-9])) == 0.0
    x = np.r_[np.arange(5.0), np.full(10, 9.0), 1.0]
    r = spikes.stuck_range(x)
    assert (r[5:15] == 0).all() and r[4] > 0 and np.isinf(spikes.stuck_range(x[:9])).all()


# --- 2: schema drift


def files_of(spark, files):
    """files: list of (producer, written, list of raw)."""
    f = [(k, p, "x", w, None, len(r)) for k, (p, w, r) in enumerate(files)]
    r = [(1000 * k + n, k, n, raw) for k, (_, _, rs) in enumerate(files) for n, raw in enumerate(rs)]
    return (
        spark.createDataFrame(r, "line_id bigint, file_id bigint, line_no bigint, raw string"),
        spark.createDataFrame([x[:3] + (None if x[3] is None else __import__("datetime").datetime(2020, 1, x[3]),) + x[4:] for x in f], "file_id bigint, producer string, fmt string, written timestamp, arrived timestamp, n_lines bigint"),
    )


def rec(i, **kw):
    return json.dumps({"id": i} | kw)


def test_drift_of_every_kind(spark):
    a = [rec(f"C{k}", loc={"lat": k + 0.5, "az": 3}, misc={"team": f"t{k}", "x": 1}) for k in range(5)]
    b = [rec(f"C{k}", **{"loc.latitude": float(f"{k}.50"), "loc.az": "3", "misc.team": f"t{k}", "resp.z": [k]}) for k in range(5)] + ['{"id":"C9","misc":{"late":']
    c = [rec(f"C{k}", misc={"latitude": [k + 0.5], "team": f"t{k}"}, loc={"az": None}, resp={"z": [k]}) for k in range(5)] * 2
    r, f = files_of(spark, [("P", 3, c), ("P", 1, a), ("P", 2, b), ("Q", 1, a)])
    got = rows(drift.changes(r, f), "file_id", "change_kind", "field", "new_field")
    assert got == sorted([
        (2, "renamed", "loc.lat", "loc.latitude"), (2, "retyped", "loc.az", ""), (2, "removed", "misc.x", ""), (2, "added", "resp.z", ""),
        (0, "renamed", "loc.latitude", "misc.latitude"), (0, "removed", "loc.az", ""),
    ])
    v = {x["file_id"]: x["version"] for x in drift.fingerprints(r, f).collect()}
    assert v == {1: 1, 2: 2, 0: 3, 3: 1}
    t = {(x["file_id"], x["id"]): x for x in drift.consistent_table(r, f).collect()}
    assert t[1, "C1"]["misc"]["latitude"] == t[0, "C1"]["misc"]["latitude"] == "[1.5]" or t[1, "C1"]["misc"]["latitude"] == "1.5"
    assert t[2, "C2"]["misc"]["team"] == "t2" and len(t) == 20


def test_drift_edge_cases(spark):
    r, f = files_of(spark, [("P", 1, [rec("A", misc={"a": 1})]), ("P", 1, []), ("P", None, ["[]", "7", "", "null", None])])
    got = rows(drift.changes(r.withColumn("kind", F.lit(1)), f.withColumn("seq", F.lit(0))), "file_id", "change_kind", "field")
    assert got == [(0, "added", "misc.a"), (1, "removed", "misc.a")]  # a file without a time is the first, ties go by file_id
    assert rows(drift.changes(r.limit(0), f.limit(0)), "file_id") == []
    assert drift.consistent_table(r.limit(0), f).count() == 0


# --- 3: intervals


def brute_periods(iv, slack):
    out, cur = [], None
    for s, e in sorted(iv):
        if cur and s <= cur[1] + slack:
            cur[1] = max(cur[1], e)
        else:
            if cur:
                out.append(("gap", cur[1], s))
            cur = [s, e]
            out.append(("period", cur))
    return sorted((k, *(v[0] if isinstance(v[0], list) else v)) for k, *v in out)


@pytest.mark.parametrize("shard", [7, 50, 10**9])
def test_periods(spark, shard):
    rng = random.Random(shard)
    iv = {k: [(s := rng.randint(-300, 300), s + rng.choice([0, 1, 5, 40, 200])) for _ in range(60)] for k in "AB"}
    df = spark.createDataFrame([(k, s, e) for k, v in iv.items() for s, e in v * 2] + [(None, 1, 2), ("A", None, 2), ("A", 9, 3)], "id string, s bigint, e bigint")
    got = rows(intervals.periods_and_gaps(df.withColumn("kind", F.lit(1)), "id", "s", "e", F.lit(3), shard), "id", "kind", "start_us", "end_us")
    assert got == sorted((k, *p) for k, v in iv.items() for p in brute_periods(v, 3))
    assert intervals.periods_and_gaps(df.limit(0), "id", "s", "e", F.lit(3)).count() == 0


def test_windows_of_time_matrices(spark):
    t = "array<struct<i bigint, us bigint>>"
    m = [[(1, 0), (6, 980000), (8, 100000), (10, 0)], [(1, 10), (1000, -2000 * 10000), (1200, 0)], [(1, 5), (1, 0)], [(1, 0), (6, 20000), (7, 40000), (8, 10000), (10, 10000)], [], None, [(1, None), (2, 0)]]
    df = spark.createDataFrame([(k, 100.0, [] if v == [] else v) for k, v in enumerate(m)] + [(90, 0.0, [(1, 1)]), (91, None, [(1, 1)]), (92, NAN, [(1, 1)]), (93, INF, [(1, 1)]), (94, 1e-300, [(1, 1)]), (95, -1.0, [(1, 1)])], f"tr_id bigint, fs double, t {t}")
    got = rows(timeaxis.windows(df, ["tr_id"]), "tr_id", "t0_us", "t1_us")
    assert [g[1:] for g in got if g[0] == 0] == [(0, 40000), (1030000, 1040000), (1150000, 1170000)]
    assert min(g[1] for g in got if g[0] == 1) == 10 - 1001 * 10000
    assert [g[1:] for g in got if g[0] == 2] == [(5, 5)]
    assert [g[1:] for g in got if g[0] == 3] == [(0, 40000), (70000, 70000), (120000, 120000), (140000, 150000), (170000, 170000)]
    assert {g[0] for g in got} == {0, 1, 2, 3}


# --- 5: regular grid


def test_grid_matches_unsharded_brute_force(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.choice(np.arange(0, 400), 180, replace=False)) * 500_000 + rng.integers(-200_000, 200_000, 180)
    t = t[(t < 60_000_000) | (t > 110_000_000)]
    x = np.sin(t / 9e6)
    data = [(k, "A", 1, int(a), float(b), None) for k, (a, b) in enumerate(zip(t, x))]
    df = spark.createDataFrame(data + data[:5] + [(998, "A", 1, 130_000_000, NAN, None), (999, "A", 1, 131_000_000, None, None), (1, "A", 5, 7, 1.0, None)], READ)
    u = spark.createDataFrame([(1, "A", 1.0, "V", None, []), (2, "B", 0.0, "V", None, [])], RUNS)
    a = {r["slot_us"]: r for r in regular.regularise(df, u, max_gap=4).collect()}
    b = {r["slot_us"]: r for r in regular.regularise(df, u, max_gap=4, shard_slots=16).collect()}
    assert a.keys() == b.keys() and all(a[k]["status"] == b[k]["status"] for k in a)
    assert all((a[k]["x"] is None) == (b[k]["x"] is None) and (a[k]["x"] is None or abs(a[k]["x"] - b[k]["x"]) < 1e-9) for k in a)
    have = {(int(v) + 500_000) // 1_000_000 * 1_000_000 for v in t}
    lo, hi = min(min(have), 131_000_000), max(max(have), 131_000_000)
    assert set(a) == set(range(lo, hi + 1, 1_000_000))
    assert {k for k, r in a.items() if r["status"] != "observed"} == set(a) - have
    assert any(r["status"] == "missing" for r in a.values()) and all(r["x"] is None for r in a.values() if r["status"] == "missing")
    ys = [r["x"] for r in a.values() if r["status"] == "filled"]
    assert ys and max(map(abs, ys)) <= 1 + 1e-9


def test_interpolation_keeps_shape():
    t, y = np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 0, 1, 1, 5])
    m = regular.monotone_slopes(t, y, np.zeros(4, bool))
    at = np.linspace(0, 3.999, 400)
    v = regular.hermite(t, y, m, at, np.searchsorted(t, at, "right") - 1)
    assert (np.diff(v) >= -1e-12).all() and v.min() >= 0 and v.max() <= 5
    assert (regular.monotone_slopes(t[:1], y[:1], np.zeros(0, bool)) == 0).all()


def test_grid_edge_cases(spark):
    u = spark.createDataFrame([(1, "A", 1.0, "V", None, []), (2, "A", None, None, None, None), (3, "A", NAN, None, None, None), (4, "A", INF, None, None, None)], RUNS)
    assert regular.regularise(spark.createDataFrame([], READ), u).count() == 0
    df = spark.createDataFrame([(1, "A", 1, 5_400_000, 2.0, None), (2, "A", 2, 5, 1.0, None), (3, "A", 1, None, 1.0, None), (4, "A", 1, 8_000_000, INF, None), (5, "A", 3, 1, 1.0, None), (6, "A", 4, 1, 1.0, None)], READ)
    got = rows(regular.regularise(df.withColumn("k", F.lit(1)).withColumn("d", F.lit(1)), u.withColumn("lo", F.lit(0))), "slot_us", "status")
    assert got == [(5_000_000, "observed"), (6_000_000, "missing"), (7_000_000, "missing"), (8_000_000, "observed")]


# --- 6: units


@pytest.mark.parametrize("text, si, scale", [
    ("m/s", "m/s", 1), ("NM/S", "m/s", 1e-9), ("micron/sec", "m/s", 1e-6), ("µm/s", "m/s", 1e-6), ("m s^-1", "m/s", 1), ("m*s**-1", "m/s", 1), ("m.s-1", "m/s", 1), ("meters per second", "m/s", 1),
    ("in/s", "m/s", 0.0254), ("kine", "m/s", 0.01), ("nm s^-1", "m/s", 1e-9), ("m s^-2", "m/s2", 1), ("M/S/S", "m/s2", 1), ("cm/s**2", "m/s2", 0.01), ("Gal", "m/s2", 0.01), ("mGal", "m/s2", 1e-5), ("g", "m/s2", 9.80665), ("[g]", "m/s2", 9.80665), ("milli-g", "m/s2", 9.80665e-3),
    ("hPa", "Pa", 100), ("mbar", "Pa", 100), ("psi", "Pa", 6894.757293168), ("pascals", "Pa", 1), ("degF", "K", 5 / 9), ("Cel", "K", 1), ("C", "K", 1), ("mK", "K", 1e-3), ("uV", "V", 1e-6), ("volts", "V", 1), ("deg", "rad", math.pi / 180), ("arcsec", "rad", math.pi / 648000), ("nrad", "rad", 1e-9),
    ("fraction", "%", 100), ("PERCENT", "%", 1), ("mm", "m", 1e-3), ("metre per second squared", "m/s2", 1), ("degree of arc", "rad", math.pi / 180), ("nanometre per second", "m/s", 1e-9), ("unit fraction", "%", 100), ("see notes", None, None), ("", None, None),
])
def test_unit_spellings(spark, text, si, scale):
    if not hasattr(test_unit_spellings, "keys"):
        texts = [m.args[1] for m in test_unit_spellings.pytestmark][0]
        d = spark.createDataFrame([(v[0],) for v in texts], "t string").select("t", unitgraph.unit_key(F.col("t")).alias("k")).collect()
        test_unit_spellings.keys = {r["t"]: r["k"] for r in d}
    c = unitgraph.compositions().get(test_unit_spellings.keys[text])
    assert (c is None) == (si is None) and (si is None or (c[0] == si and c[1] == pytest.approx(scale, rel=1e-12)))


def test_graph_is_consistent_and_bad_cycles_raise():
    c = unitgraph.compositions()
    assert c["degf"][2] == pytest.approx(273.15 - 160 / 9) and all(n <= 4 for *_, n in c.values())
    with pytest.raises(ValueError):
        unitgraph.compositions(unitgraph.edges() + [("mbar", "kpa", 0.2, 0.0)])
    with pytest.raises(ValueError):
        unitgraph.compositions(unitgraph.edges() + [("v", "k", 1.0, 0.0)])


def test_units_from_anywhere(spark):
    resp = "struct<kind string, a0 double, f0 double, fu string, descr string, p array<struct<re double, im double>>, z array<struct<re double, im double>>, i string, o string>"
    P = [(1.0, 2.0)]
    r = lambda f0=2.0, fu=None, de=None, p=P, i=None: ("PZ", 1.0, f0, fu, de, p, [], i, "V")
    data = [
        (1, 5.0, "cm/s", r(), {}, []), (2, 5.0, "counts", r(0.5, "s"), {}, ["vault temp 281 K", "gain refers to one mbar"]), (3, 5.0, "?", r(2000.0, "mHz"), {"gain_units": "cts per degF"}, None),
        (4, 5.0, None, r(math.pi, "", "corner is an angular frequency", i="um/s"), None, []), (5, 1.0, "m", r(-1.0), {}, []), (6, NAN, "m", None, {}, []), (7, 5.0, "counts", r(p=[]), {}, ["Supply 12 V nominal."]),
        (8, 3.0, "", r(4.0, None, "corner stated as period in seconds"), {"Sensitivity": "counts/(m s^-2)", "depth": "12 m"}, []), (9, None, "m", r(NAN), {}, [None]), (10, INF, "m", r(None), {}, []),
    ]
    df = spark.createDataFrame(data, f"rec_id bigint, gain double, units string, resp {resp}, misc map<string,string>, notes array<string>").withColumn("unit", F.lit(1)).withColumn("scale", F.lit(1))
    got = {(a, b): (c, v) for a, b, c, v in rows(unitgraph.to_si(df), "rec_id", "what", "si_units", "si_value")}
    assert got == {
        (1, "gain"): ("m/s", 500), (1, "f0"): ("Hz", 2000), (2, "gain"): ("Pa", 0), (2, "f0"): ("Hz", 2000), (3, "gain"): ("K", 9), (3, "f0"): ("Hz", 2000),
        (4, "gain"): ("m/s", 5_000_000), (4, "f0"): ("Hz", 500), (8, "gain"): ("m/s2", 3), (8, "f0"): ("Hz", 250),
    }
    assert unitgraph.to_si(df.limit(0)).count() == 0


def test_spikes_of_a_noisy_recorder_are_held_against_the_channel(spark):
    rng = np.random.default_rng(4)
    quiet, noisy = rng.normal(size=3072), 3 * rng.normal(size=512)
    at = np.arange(40, 480, 40)
    for o in (-3, -2, -1, 1, 2, 3):
        noisy[at + o] = rng.normal(size=len(at)) * 0.3
    noisy[at] = 10.5  # more than 8 usual scatters, less than 4 of the recorder's own
    rows = [("A", run, int(k) * 10_000, float(v)) for run, x in ((1, quiet), (2, noisy)) for k, v in enumerate(x)]
    rows = [(i, r, t + r * 10**9, v) for i, r, t, v in rows]
    readings = spark.createDataFrame(rows, "id string, run_id bigint, t bigint, x double")
    runs = spark.createDataFrame([(1, "A", 100.0, "m/s2"), (2, "A", 100.0, "m/s2")], "run_id bigint, id string, fs double, units string")
    got = {r["t_us"] for r in spikes.flagged(readings, runs, shard=512).collect() if r["reason"] == "spike"}
    assert {int(k) * 10_000 + 2 * 10**9 for k in at} <= got and not any(t < 2 * 10**9 for t in got)


def test_offsets_of_absolute_quantities(spark):
    df = spark.createDataFrame([(1, 0.0, "degC", "K"), (2, 32.0, "degF", "degC"), (3, 300.0, "K", "degF"), (4, 1013.25, "mbar", "pascals"), (5, 1.0, "nonsense", "K"), (6, None, "K", "K"), (7, 1.0, "K", "Pa"), (8, 1.0, None, None), (9, -40.0, "deg F", "Celsius")], "k int, x double, u string, w string")
    got = {r["k"]: r["y"] for r in unitgraph.convert(df, "x", "u", "w", "y").collect()}
    want = {1: 273.15, 2: 0.0, 3: 80.33, 4: 101325.0, 5: None, 6: None, 7: None, 8: None, 9: -40.0}
    assert got.keys() == want.keys() and all(v is None if want[k] is None else v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    si = {r["k"]: (r["si_units"], r["si_value"]) for r in unitgraph.convert(df, "x", "u").collect()}
    assert si[2] == ("K", pytest.approx(273.15)) and si[5] == (None, None) and len(si) == 9
    assert unitgraph.convert(df.limit(0), "x", "u").count() == 0


def test_losses_name_what_the_table_cannot_keep(spark):
    files = spark.createDataFrame([(k, "P", k) for k in (1, 2, 3)], "file_id bigint, producer string, w int").withColumn("written", F.timestamp_seconds("w"))
    # a field is removed, and later another one takes its name: the first file then has two fields of one canonical name
    rows = [(k, 1, f'{{"id": "c{k}", "loc": {{"elev": {k}.5, "el": {k + 50}}}}}') for k in range(1, 5)] + [(5, 1, '{"id": "c5", "loc": {"elev": 5.5, "el": 5.5}}')]
    rows += [(10 + k, 2, f'{{"id": "c{k}", "loc": {{"elev": {k}.5}}}}') for k in range(1, 6)] + [(16, 2, '{"id": "c6", "loc": {"elev": "no idea"}}')]
    rows += [(20 + k, 3, f'{{"id": "c{k}", "loc": {{"el": {k}.5}}}}') for k in range(1, 6)] + [(26, 3, "broken"), (27, 3, None), (28, 3, "[1]"), (29, 3, '{"loc": NaN}')]
    rec = spark.createDataFrame(rows, "line_id bigint, file_id bigint, raw string")
    got = sorted(tuple(r) for r in drift.losses(rec, files).collect())
    assert got == [(k, 1, "loc.elev", "loc.el", "collision", f"{k}.5") for k in range(1, 5)] + [(16, 2, "loc.elev", "loc.el", "cast", "no idea")]
    table = {r["line_id"]: r["loc"] for r in drift.consistent_table(rec, files).collect()}
    assert table[1] == {"el": "51.0"} and table[5] == {"el": "5.5"} and table[11] == {"el": "1.5"} and table[16] == {"el": None} and table.keys() == {r[0] for r in rows} - {26, 27, 28, 29}
    assert drift.losses(rec.limit(0), files).count() == 0


def test_chained_renames_against_brute_force():
    import pandas as pd

    rng = random.Random(6)
    for _ in range(200):
        ren = {}
        for _ in range(rng.randint(0, 12)):
            a, b = rng.sample("abcdef", 2)
            ren[rng.randint(2, 9), a] = b
        g = pd.DataFrame([(s, a, b) for (s, a), b in ren.items()], columns=["seq", "field", "new_field"])
        rules = drift.chained(g)
        for s in range(1, 10):
            for name in "abcdef":
                c, n = name, 0
                for later in range(s + 1, 10):
                    if (later, c) in ren:
                        c, n = ren[later, c], n + 1
                hit = rules[(rules["field"] == name) & (rules["lo"] <= s) & (rules["hi"] > s)]
                got = (name, 0) if hit.empty else (hit["canonical"].iloc[0], hit["steps"].iloc[0])
                assert len(hit) <= 1 and got == (c, n)
