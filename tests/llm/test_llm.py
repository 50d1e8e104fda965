"""The text and duplicate-group problems against brute force, round trips and edge cases."""

import os
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremolite.llm import leak, listpages, packing, survivor
from tremolite.llm import text as T


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- text


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abz9 É.,\n-’—ß", max_size=40)), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_like_a_regular_expression(texts):
    import regex

    w = T.words(texts)
    want = [regex.findall(r"[a-z0-9éß-ÿ]+", T.normal(t)) for t in texts]
    got = [[w.word(k) for k in range(a, z)] for a, z in zip(w.first[:-1], w.first[1:])]
    assert got == want
    flat = [x for ws in want for x in ws]
    by = {}
    for x, h in zip(flat, w.h):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_normal_forms():
    assert T.normal("Exam-\nple ﬁne so­ft​") == "example fine soft" and T.normal(None) == ""


# --- 4: survivors

PZ = [{"re": 1.0, "im": 2.0}]
CH = "rec_id bigint, id string, name string, loc struct<datum string, lat double, lon double, el double, dep double, az double, inc double>, fs double, gain double, resp struct<kind string, a0 double, f0 double, fu string, descr string, p array<struct<re double, im double>>, z array<struct<re double, im double>>, i string, o string>, units string, src string, misc map<string,string>, notes array<string>, updated timestamp"


def record(k, id="A.B..C", name=None, lat=None, gain=None, f0=None, src=None, day=None, p=True):
    loc = None if lat is None else ("WGS84", lat, 5.0, 1.0, 0.0, 0.0, 0.0)
    resp = None if f0 is None else ("PZ", 1.0, f0, None, None, [(1.0, 2.0)] if p else [], [], None, None)
    return (k, id, name, loc, 1.0, gain, resp, None, src, {}, [], None if day is None else datetime(2020, 1, day))


def sources(spark):
    return spark.createDataFrame([("HI", "x", 9), ("LO", "x", 1)], "src string, title string, trust int")


def test_field_by_field(spark):
    rs = [
        record(1, "a_b__c", "Old Name", 10.0, 5.0, 2.0, "LO", 3), record(2, " A.B..C ", "Unknown", 95.0, -12345.0, 0.0, "HI", 4), record(3, "A-B--C", "New Name", None, float("nan"), 1.0, "HI", 2),
        record(4, "A/B/__/C", "New  Name", 0.0, 1.0, 3.0, "HI", 2, p=False), record(5, "X.Y.00.Z", "alone", 1.0, 2.0, 2.0), record(6, None, "n"), record(7, None, "n"), record(8, "E.F..G", "?", None, 0.0), record(9, "E.F..G", "xxx"),
    ]
    df = spark.createDataFrame(rs, CH)
    got = rows(survivor.survivors(df.withColumn("rank", F.lit(1)).withColumn("_trust", F.lit(1)), sources(spark)), "id", "field", "rec_id")
    assert got == [("A.B..C", "gain", 1), ("A.B..C", "loc", 4), ("A.B..C", "name", 4), ("A.B..C", "resp", 3)]
    assert survivor.survivors(df.limit(0), sources(spark)).count() == 0


def test_rank_votes_equal_brute_force_also_in_blocks(spark):
    rng = random.Random(3)
    words = ["north", "south", "hill", "lake", "vault", "east"]
    rs = [record(k, f"N.S{rng.randint(0, 4) if rng.random() < 0.6 else 0}..Z", " ".join(rng.choices(words, k=rng.randint(1, 4))) if rng.random() < 0.8 else rng.choice(["", None, "N/A"]), None, rng.choice([None, 1.0, 2.0, 3.5]), None, rng.choice(["HI", "LO", None, "?"]), rng.choice([None, 1, 2, 3])) for k in range(150)]
    df = spark.createDataFrame(rs, CH)
    trust = {"HI": 9, "LO": 1}
    best, n = {}, Counter(r[1] for r in rs)
    for r in rs:
        rank = (trust.get(r[8], 0), r[11] or datetime.min, r[0])
        for field, ok in (("name", r[2] not in ("", None, "N/A")), ("gain", r[5] not in (None, 1.0))):
            if ok and n[r[1]] > 1:
                best[r[1], field] = max(best.get((r[1], field), rank), rank)
    want = sorted((i, f, r[2]) for (i, f), r in best.items())
    for block in (64, 3):
        assert rows(survivor.survivors(df, sources(spark), block=block), "id", "field", "rec_id") == want


def test_sum_votes_outvote(spark):
    df = spark.createDataFrame([record(1, name="Lake Hill East", src="LO"), record(2, name="Lake Hill West", src="LO"), record(3, name="Lake Hill West", src="LO"), record(4, name="Lak Hil", src=None)], CH)
    assert rows(survivor.survivors(df, sources(spark), votes="sum"), "field", "rec_id") == [("name", 3)]


def test_profiles():
    one = lambda s, w: ([{t: (w,)} for t in s.split()], (w,))
    add = lambda a, b: (a[0] + b[0],)
    p, w = survivor.progressive([one("a b c", 2), one("a c", 1), one("a b d", 2), one("b c", 1)], add)
    assert survivor.consensus(p) == ["a", "b", "c"] and w == (6,)


# --- 7: packing


def check_plan(counts, cap):
    kinds = packing.plan(dict(counts), cap)
    used = Counter()
    for parts, m in kinds:
        assert m > 0 and sum(parts) <= cap
        for n in parts:
            used[n] += m
    assert used == Counter({k: v for k, v in counts.items() if v})
    return kinds


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=40), st.integers(60, 64))
@settings(max_examples=150, deadline=None)
def test_plans_place_every_item_once(counts, cap):
    kinds = check_plan(counts, cap)
    total = sum(k * v for k, v in counts.items())
    boxes = sum(m for _, m in kinds)
    # no two containers of a valid best fit could be poured together
    assert boxes <= max(1, 2 * total / cap + 1)


def test_plans_fill_well_and_repeat():
    rng = np.random.default_rng(0)
    n = np.clip(rng.lognormal(5, 1, 20000).astype(int), 1, 2048)
    kinds = check_plan(Counter(n.tolist()), 2048)
    boxes = sum(m for _, m in kinds)
    assert n.sum() / (boxes * 2048) > 0.995
    exact = sum(m for parts, m in kinds if sum(parts) == 2048)
    assert exact / boxes > 0.97
    big = packing.plan({k: v * 10**9 for k, v in Counter(n.tolist()).items()}, 2048)
    assert len(big) < 4 * 2048
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)
    assert packing.plan({}, 4) == []


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer here")
def test_pack_documents(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randint(1, 300) for _ in range(150)] + ["", None, "long text " * 4000, "a" * 50_000] + ["same text"] * 30
    df = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[7])], "doc_id bigint, text string").withColumn("box", F.lit("x")).withColumn("tokens", F.lit(1))
    boxes = spark.createDataFrame([("s", 64), ("m", 512)], "box string, cap_tokens int")
    n = packing.token_counts(df)
    placed = packing.pack(n, boxes, rank_items=50)
    by = {}
    for r in placed.collect():
        by.setdefault((r["box"], r["doc_id"]), []).append((r["piece"], r["first_token"], r["tokens"], r["container"]))
    caps = {"s": 64, "m": 512}
    for box, cap in caps.items():
        for k, t in n.collect():
            ps = sorted(by.get((box, k), []))
            if k == 7:
                assert len(ps) % 2 == 0 and sum(p[2] for p in ps) == 2 * t
                continue
            assert sum(p[2] for p in ps) == t and (t > cap or len(ps) == (t > 0))
            assert [p[1] for p in ps] == [cap * j for j in range(len(ps))] and all(p[2] == cap for p in ps[:-1])
    f = packing.filling(placed, boxes).collect()
    assert all(0 < r["used"] <= r["cap_tokens"] for r in f)
    for box, cap in caps.items():
        ids = sorted(r["container"] for r in f if r["box"] == box)
        assert ids == list(range(len(ids)))
        total = sum(r["used"] for r in f if r["box"] == box)
        assert total == sum(t for _, t in n.collect()) and total / (cap * len(ids)) > 0.95
    assert packing.pack(n.limit(0), boxes).count() == 0 and packing.pack(n, boxes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(n, spark.createDataFrame([("z", 0)], "box string, cap_tokens int"))


# --- 8: leaks

_SYL = ["ba", "ko", "li", "mu", "ne", "po", "ri", "su", "ta", "ve", "xa", "zy"]
VOCAB = [a + b + c + d for a in _SYL for b in _SYL for c in _SYL for d in ("n", "st")]


def test_leaks_against_planted_cases(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choices(VOCAB, k=n))
    formula = say(22)
    items = [(100 + k, say(40) + " " + formula + " " + say(40)) for k in range(30)] + [(200, ""), (201, None), (202, say(10))]
    docs, want = [], set()

    def misspell(ws, every):
        return [w[:-2] + w[-1] + w[-2] if k % every == every - 1 and w[-1] != w[-2] else w for k, w in enumerate(ws)]

    def plant(k, i, a, n, how):
        ws = items[i][1].split()[a : a + n]
        if how == "typos":
            ws = misspell(ws, 13)
        if how == "interrupted":
            ws = ws[:13] + ["(Hear,", "hear.)"] + ws[13:]
        if how == "case":
            ws = [w.upper() + "," for w in ws]
        if how == "broken":
            ws = [w[:2] + "-\n" + w[2:] if j % 9 == 4 else w for j, w in enumerate(ws)]
        if how == "invisible":
            ws = [w[:2] + "​" + w[2:] for w in ws]
        docs.append((k, say(60) + " " + " ".join(ws) + " " + say(30)))

    k = 0
    for how in ("plain", "typos", "interrupted", "case", "broken", "invisible"):
        for _ in range(8):
            i = rng.randrange(30)
            n = rng.choice([25, 28, 35])
            plant(k, i, rng.choice([0, 5, 62, 66]), n, how)
            want.add((k, 100 + i))
            k += 1
    for _ in range(20):  # too short
        plant(k, rng.randrange(30), 0, rng.choice([10, 18, 24]), "plain")
        k += 1
    for _ in range(300):  # a formula is nobody's own
        docs.append((k, say(20) + " " + formula + " " + say(20)))
        k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, say(5)), (k + 3, say(20000) + " " + " ".join(items[0][1].split()[:30]) + " " + say(20000)), (0, docs[0][1])]
    want |= {(k + 3, 100)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(1)).repartition(3)
    e = spark.createDataFrame(items, "item_id bigint, text string").withColumn("lang", F.lit("en"))
    got = leak.leaks(d, e).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs == want, (want - pairs, pairs - want)
    assert len(got) == len(pairs) + 1  # a repeated document gives its rows again
    small = leak.leaks(d, e, block_words=900)
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == pairs
    assert leak.leaks(d.limit(0), e).count() == 0 and leak.leaks(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["plain", "corrected"])
def test_copies_of_a_leak_are_no_formula(spark, how):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices(VOCAB, k=n))
    formula = say(22)
    items = [(k, say(40) + " " + formula + " " + say(40)) for k in range(3)]
    leaking = (say(100) + " " + " ".join(items[0][1].split()[:35]) + " " + say(100)).split()

    def reissue():
        ws = list(leaking)
        if how == "corrected":
            for at in rng.sample([*range(100), *range(140, 235)], 3):
                ws[at] = rng.choice(VOCAB)
        return " ".join(ws)

    docs = [reissue() for _ in range(100)] + [say(30) + " " + formula + " " + say(30) for _ in range(12)] + [say(60) for _ in range(188)]
    docs.append(say(20) + " " + " ".join(items[0][1].split()[:30]) + " " + say(20))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leak.leaks(d, e).collect())
    assert got == [(k, 0) for k in [*range(100), 300]]
    it = leak.Items([k for k, _ in items], [t for _, t in items], leak.Cgk())
    src = d.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    it.mark(leak.formulas(src, [it], "_d", "_t", leak.FORMULA_SHARE, leak.FORMULA_LEAST))
    assert [int((~o).sum()) for o in it.own] == [22] * 3


@pytest.mark.parametrize("cuts", [(13, 12), (12, 13), (3, 13, 9), (8, 9, 8), (6, 6, 7, 6)])
def test_leaks_in_short_parts_are_found_wherever_they_start(spark, cuts):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(VOCAB, k=n))
    items = [(k, say(60)) for k in range(20)]
    docs = []
    for k, (_, t) in enumerate(items):
        ws, at = t.split()[k : k + 25], 0
        for n in cuts[:-1]:
            at += n
            w = ws[at - 1]
            ws[at - 1] = w[:3] + "q" + w[4:]  # a part's last word is misspelt
        docs.append((k, say(30 + k) + " " + " ".join(ws) + " " + say(40)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    e = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leak.leaks(d, e).collect()) == [(k, k) for k in range(20)]


def fuzzy(rng: random.Random, ws: list[str], kind: str) -> list[str]:
    """25 to 40 words of an item with edits of a kind at random places."""
    ws, n = list(ws), len(ws)
    cut = rng.randrange(8, n - 8)
    other = lambda k: rng.choices(VOCAB, k=k)
    if kind == "misspelt":
        for at in sorted(rng.sample(range(n), 3)):
            w, k = ws[at], rng.randrange(1, len(ws[at]) - 2)
            ws[at] = rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k + 1 :], w[:k] + w[k] + w[k:]])
    if kind == "joined":
        ws[cut : cut + 2] = [ws[cut] + ws[cut + 1]]
    if kind == "split":
        ws[cut : cut + 1] = [ws[cut][:3], ws[cut][3:]]
    if kind == "interrupted":
        ws[cut:cut] = other(rng.randint(1, 12))
    if kind == "interrupted twice":
        ws[n - 8 : n - 8] = other(rng.randint(1, 12))
        ws[8:8] = other(rng.randint(1, 12))
    if kind == "interrupted far":
        ws[cut:cut] = other(rng.randint(13, 60))
    if kind == "misspelt and interrupted":
        ws = fuzzy(rng, fuzzy(rng, ws, "misspelt"), "interrupted")
    return ws


KINDS = ("literal", "misspelt", "joined", "split", "interrupted", "interrupted twice", "interrupted far", "misspelt and interrupted")


def whole(it: leak.Items, o: int, dw: list[str], x: T.Words) -> tuple[int, int, int]:
    """Brute force: one item against one whole document."""
    a, z, size = it.first[o], it.first[o + 1], x.z - x.a
    close = (np.bitwise_count(it.bag[a:z, None] ^ x.bag[None, :]) <= 4) & (np.abs(it.size[a:z, None] - size[None, :]) <= 2)
    return leak.align(it.words[o], it.own[o], dw, it.h[a:z, None] == x.h[None, :], close, it.size[a:z], size, it.bag[a:z], x.bag)


def test_recall_and_extents_against_brute_force_by_kind():
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choices(VOCAB, k=n))
    items = [say(90) for _ in range(40)]
    it = leak.Items(list(range(40)), items, leak.Cgk())
    it.index()
    for kind in KINDS:
        docs = []
        for k in range(40):
            n, ws = rng.randint(25, 40), items[k % 40].split()
            a = rng.randrange(0, 90 - n)
            docs.append(say(rng.randint(5, 60)) + " " + " ".join(fuzzy(rng, ws[a : a + n], kind)) + " " + say(rng.randint(5, 60)))
        x = T.words(docs)
        want = {}
        for k in range(40):
            one = T.words([docs[k]])
            dw = [one.word(m) for m in range(len(one.h))]
            for o in (k % 40, (k + 1) % 40):
                v = whole(it, o, dw, one)
                if v[0] >= leak.LEAST:
                    want[k, o] = v
        got = {(d, o): v for d, o, v in leak.search(it, x)}
        assert len(want) >= 36 and got.keys() <= want.keys()
        assert len(got) >= 0.99 * len(want), (kind, len(got), len(want))
        assert sum(got[p] == want[p] for p in got) >= 0.99 * len(got), (kind, [(got[p], want[p]) for p in got if got[p] != want[p]])


def test_alignment_by_dynamic_programming_takes_back_wrong_turns():
    def run(item: str, doc: str) -> tuple[int, int, int]:
        it = leak.Items([0], [item], leak.Cgk())
        x = T.words([doc])
        return whole(it, 0, [x.word(k) for k in range(len(x.h))], x)

    words = VOCAB[:40]
    item = " ".join(words)
    # an interruption that begins with what could be the next word misspelt, or with the very next words
    close = words[12][:-2] + words[12][-1] + words[12][-2]
    assert run(item, " ".join(words[:12] + [close, "zzz"] + words[12:])) == (40, 0, 40)
    assert run(item, " ".join(words[:12] + [words[12], "zzz", "yyy"] + words[12:])) == (40, 0, 40)
    assert run(item, " ".join(words[:12] + ["x"] * 60 + words[12:])) == (40, 0, 40)
    assert run(item, " ".join(words[:12] + ["x"] * 61 + words[12:])) == (28, 12, 40)
    assert run(item, " ".join(words[:12] + words[13:])) == (27, 13, 40)


def test_search_passes_equal_words_together_and_spells_out_few(monkeypatch):
    say = random.Random(8)
    item = say.choices(VOCAB, k=600)
    it = leak.Items([0], [" ".join(item)], leak.Cgk())
    it.index()
    reads, spelt, word = [], [], T.Words.word

    class Counted(np.ndarray):
        def __getitem__(self, k):
            reads.append(1)
            return np.asarray(self)[k]

    x = T.words([" ".join(say.choices(VOCAB, k=50) + item + say.choices(VOCAB, k=50))])
    x.h = x.h.view(Counted)
    monkeypatch.setattr(T.Words, "word", lambda self, k: spelt.append(k) or word(self, k))
    assert leak.search(it, x) == [(0, 0, (600, 0, 600))]
    # a step a word were thousands of reads, and each of the 700 words was spelt out
    assert len(reads) < 1500 and len(spelt) < 350


def test_words_and_pairs_that_come_soon():
    h = T.words([" ".join(random.Random(4).choices(VOCAB, k=50))]).h
    for step in (1, -1):
        pairs = leak.pairs_of(h, step)
        for k in range(50):
            assert int(pairs[k]) == (int(h[k]) * 0xD6E8FEB86659FD93 + int(h[min(max(k + step, 0), 49)])) % 2**64
        for v in (h, pairs):
            bits, soon = [1 << (int(c) >> 58) for c in v], leak.ahead(v, step)
            for k in range(50):
                want = 0
                for g in range(1, leak.INSERTED + 1):
                    want |= bits[k + step * g] if 0 <= k + step * g < 50 else 0
                assert int(soon[k]) == want


def test_word_hashes():
    texts = ["a bc \u00e9t\u00e9 " + "x" * 63 + " " + "y" * 200, None, "", "end"]
    w = T.words(texts)
    assert [w.word(k) for k in range(len(w.h))] == ["a", "bc", "\u00e9t\u00e9", "x" * 63, "y" * 200, "end"] and w.first.tolist() == [0, 5, 5, 5, 6]
    for k in range(len(w.h)):
        h = 0
        for n, c in enumerate(w.buf[w.a[k] : w.z[k]]):
            h = (h + int(T._BYTE[c]) * int(T._POW[n & 63])) % 2**64
        assert int(w.h[k]) == (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64


def test_items_copied_into_many_documents_are_no_formulas():
    say = random.Random(2)
    item = " ".join(say.choices(VOCAB, k=100))
    it = leak.Items([0], [item], leak.Cgk())
    g = it.grams()[0]
    it.mark(g)
    assert it.own[0].all()
    it.mark(g[:20])
    assert int((~it.own[0]).sum()) == 31


def test_too_many_items(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        leak.leaks(d, spark.createDataFrame([(1, "word " * 100)], "item_id bigint, text string"), item_words=50)


def test_embedding_keeps_near_windows_together():
    rng = np.random.default_rng(0)
    c = leak.Cgk(bits=6)
    w = rng.integers(1, 2**63, (400, 12), dtype=np.uint64)
    v = w.copy()
    v[np.arange(400), rng.integers(0, 12, 400)] = rng.integers(1, 2**63, 400, dtype=np.uint64)
    far = rng.integers(1, 2**63, (400, 12), dtype=np.uint64)
    at = np.arange(400) * 12
    hit = lambda a, b: np.mean(np.any([x == y for x, y in zip(c.keys(a.ravel(), at), c.keys(b.ravel(), at))], axis=0))
    assert hit(w, w) == 1 and hit(w, v) > 0.8 and hit(w, far) < 0.02


def test_similar_words():
    assert leak.similar("safer", "saaaer") and leak.similar("forestry", "foreseery") and leak.similar("only", "oly") and not leak.similar("100", "200") and not leak.similar("1st", "2st")
    assert leak.similar("reform", "refrom") and leak.similar("subsidies", "subsdiies") and not leak.similar("costly", "unfair") and not leak.similar("in", "on")


# --- 9: list pages

SPAM = [
    "cheap robes, quill pens, legal wigs, wall clocks, debate mugs, cheap robes, quill pens, gavel shop, lectern hire, poster print, seat cushions",
    "#sale #posterprint #new #loanadvice #seatcushions #cheap #official #flagpoles #marimarsh #norenmere #gavelshop #best #goriwick #hesinbrun",
    "\n".join(f"https://m.shop{k}.example/item/{k}" for k in range(12)),
    "\n".join(f"taxi {p} cheap" for p in ("Kelford", "Norwick", "Esthaven", "Jolmere", "Varholt", "Sunbeck", "Pelness", "Ostdal")),
    "best kettle lamp best kettle kettle lamp lamp best kettle sofa lamp kettle kettle best lamp kettle best kettle lamp kettle sofa kettle",
    "Home | Login | Kettles Norwick | Offers | Lamps Kelford | Partners | Print | Share | Sofas Jolmere | Contact | Archive | More links | Taxi Varholt",
    "Order quill pens today, our quill pens beat other quill pens. Why quill pens? Because quill pens and more quill pens. Quill pens Norwick: quill pens prices, quill pens reviews, quill pens offers.",
    "I welcome the reform, but the growers in Norwick remain short of basic supplies.\n" + "cheap robes > quill pens > legal wigs > wall clocks > debate mugs > robes > quill pens > gavel shop > lectern hire > poster print > seat cushions",
    "baux forestiers, horaires des bacs, baux forestiers, horaires des bacs, bons de logement, horaires des bacs, baux forestiers, baux forestiers, horaires des bacs",
]
SPEECH = "I have here nine letters from the teachers in Norwick about harbour dredging, and not one of them calls the reform sensible. We were told that the contract would cost us four million, yet this House has received only two."
FINE = [
    SPEECH, SPEECH + "\nHome | Sittings | Members | Search", SPEECH + " See https://papers.example/doc/9 for the tables.", SPEECH + "\nTags: school meals, road salt, care homes",
    "Members present: Eldarsen (FV), Corernell (FV), Zoloswell (FV), Grievez (LL), Fenevinger (GM), Wenoomo (NM), Rasensen (FV), Selinova (LL), Faluric (FV), Gorarsen (RA)",
    "Order paper\n" + "\n".join(f"{k}. Bill {k * 7}: road salt" for k in range(1, 15)),
    "Division 12. Ayes, 6: Ms Ulenski, Dr Bramiby, Mr Ostosen, Sir Queniomo, K. Kelaez, Dame Jolarova\nNoes, 4: Mr Toriquist, Sir Lamiko, Hon. Fenarault, Ms Corenley\nThe motion was carried.",
    "Questions on notice\n" + "\n".join(f"No. {k} Mr Hesiby: To ask the board about the dairy levies in Norwick." for k in range(200, 206)),
    "Wie soll ein enger Bericht gelten, wenn es um das Wohngeld und die Gaspreise geht und vor der Pause in Norwick nichts geschah?", "", "Order.", "(Hear, hear.)",
]


#: Short prose about a parliament; nothing in the operator knows these languages.
PROSE = {
    "fi": "Eduskunta kokoontui eilen keskustelemaan uudesta esityksestä, joka koskee kuntien rahoitusta. Ministeri vastasi kysymyksiin pitkään, mutta monet edustajat jäivät odottamaan tarkempia lukuja. Äänestys siirrettiin seuraavaan istuntoon, koska valiokunnan mietintö ei ollut vielä valmis.",
    "pl": "Sejm zebrał się wczoraj, aby omówić nowy projekt ustawy o finansowaniu gmin. Minister długo odpowiadał na pytania, lecz wielu posłów nadal czeka na dokładne liczby. Głosowanie przełożono na następne posiedzenie, ponieważ sprawozdanie komisji nie było jeszcze gotowe.",
    "es": "El Parlamento se reunió ayer para debatir el nuevo proyecto de ley sobre la financiación de los municipios. El ministro respondió largamente a las preguntas, pero muchos diputados siguen esperando cifras exactas. La votación se aplazó hasta la próxima sesión, porque el informe de la comisión aún no estaba listo.",
    "tr": "Meclis dün belediyelerin finansmanına ilişkin yeni tasarıyı görüşmek üzere toplandı. Bakan soruları uzun uzun yanıtladı, ancak birçok milletvekili hâlâ kesin rakamları bekliyor. İstanbul oturumunda oylama ertelendi, çünkü komisyon raporu henüz hazır değildi.",
    "ru": "Парламент собрался вчера, чтобы обсудить новый проект закона о финансировании общин. Министр долго отвечал на вопросы, однако многие депутаты по-прежнему ждут точных цифр. Голосование перенесли на следующее заседание, поскольку доклад комиссии ещё не был готов.",
    "el": "Η Βουλή συνεδρίασε χθες για να συζητήσει το νέο νομοσχέδιο για τη χρηματοδότηση των δήμων. Ο υπουργός απάντησε εκτενώς στις ερωτήσεις, αλλά πολλοί βουλευτές περιμένουν ακόμη ακριβή στοιχεία. Η ψηφοφορία αναβλήθηκε για την επόμενη συνεδρίαση, διότι η έκθεση της επιτροπής δεν ήταν έτοιμη.",
    "hu": "A parlament tegnap összeült, hogy megvitassa az önkormányzatok finanszírozásáról szóló új törvényjavaslatot. A miniszter hosszasan válaszolt a kérdésekre, de sok képviselő továbbra is pontos számokra vár. A szavazást a következő ülésre halasztották, mert a bizottság jelentése még nem készült el.",
    "hi": "संसद की बैठक कल नगर निकायों के वित्त पर नए विधेयक की चर्चा के लिए हुई। मंत्री ने प्रश्नों के लंबे उत्तर दिए, पर अनेक सदस्य अब भी सही आँकड़ों की प्रतीक्षा में हैं। मतदान अगली बैठक तक टाल दिया गया, क्योंकि समिति की रिपोर्ट तैयार नहीं थी।",
    "zh": "议会昨天开会讨论关于地方财政的新法案。部长详细回答了问题，但许多议员仍在等待准确的数字。表决推迟到下次会议，因为委员会的报告尚未完成。",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_prose_of_any_language_is_no_list(lang):
    t = PROSE[lang]
    wrapped = "\n".join(" ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    quoted = t.replace(" ", " “", 1).replace(". ", ".” ", 1)
    for text in (t, "\n".join([t] * 4), " ".join([t] * 4), wrapped, quoted, t + "\nHome | Login | Search | Print"):
        assert not listpages.shapes([text]).flagged().any(), text


LISTS = {
    "fi": ["halvat huonekalut Tampere", "halvat renkaat Tampere", "halvat huonekalut Turku", "halvat renkaat Turku", "halvat huonekalut Oulu", "halvat renkaat Oulu"],
    "ru": ["дешёвые шины Казань", "дешёвые лампы Казань", "дешёвые шины Пермь", "дешёвые лампы Пермь", "дешёвые шины Омск", "дешёвые лампы Омск"],
    "tr": ["ucuz lastik İzmir", "ucuz lamba İzmir", "ucuz lastik Bursa", "ucuz lamba Bursa", "ucuz lastik Ankara", "ucuz lamba Ankara"],
}


@pytest.mark.parametrize("lang", sorted(LISTS))
@pytest.mark.parametrize("sep", ["\n", ", ", " | ", " > ", " #"])
def test_lists_of_any_language_are_flagged(lang, sep):
    assert listpages.shapes([sep.join(LISTS[lang]), sep.join(LISTS[lang]) + "\n" + PROSE[lang].split(". ")[0][:60] + "."]).flagged().all()


def test_capitals_of_all_scripts():
    t = ["Hëllo “World” Ärger im Öl “Ümit” İstanbul ıslak Ωμέγα ωμέγα Жук жук ẞ ab", "", "Plain İ Ⱥx text"]
    p = [T.plain(x) for x in t]
    x = T.words_of([q.lower() for q in p])
    got = [(x.word(k), bool(c)) for k, c in enumerate(T.capitals(p, x))]
    known = {w: c for w, c in got}
    assert [known[w] for w in ("hëllo", "world", "ärger", "im", "öl", "ümit", "ıslak", "ωμέγα", "жук", "plain", "text")][:4] == [True, True, True, False]
    assert [c for w, c in got if w in ("ωμέγα", "жук")] == [True, False, True, False] and len(got) == len(x.h)
    a, b = listpages.shapes(["Hello World Again, said Tom here."]), listpages.shapes(["Hëllo World Again, said Tom here."])
    assert (a.words, a.listed) == (b.words, b.listed)


def test_list_pages(spark):
    data = list(enumerate(SPAM)) + [(100 + k, t) for k, t in enumerate(FINE)] + [(500, None), (0, SPAM[0]), (501, SPEECH * 3000), (502, (SPAM[0] + "\n") * 3000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("t", F.lit(1)).withColumn("words", F.lit(2))
    got = [r["doc_id"] for r in listpages.list_pages(df).collect()]
    assert sorted(got) == sorted([0, 0, *range(1, len(SPAM)), 502])
    assert listpages.list_pages(df.limit(0)).count() == 0


def test_shapes_of_nothing():
    assert not listpages.shapes([]).flagged().any() and not listpages.shapes([None, "", "!!!"]).flagged().any()
