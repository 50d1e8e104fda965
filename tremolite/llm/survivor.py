"""Problem 4: the best representative of each duplicate group, field by field.

Token-level consensus: the distinct usable values of a group are aligned progressively, weighted
tokens vote per column, and the existing value closest to the consensus survives.  A group of up to BLOCK values is
settled where it is aligned; larger groups are aligned in blocks, whose profiles are aligned with each other in a tree of
BLOCK profiles at a time, so no task holds a group's records.  Copies of a value are one row beforehand.

Weights are records' ranks (trust, updated, key).  'rank' votes let the highest rank in a column win
(the limit of weights of which each exceeds the sum of all lower ones); 'sum' votes add up trust + 1
over all records, so that a common value can outvote a trusted one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolite.functions.ids import canonical_id
from tremolite.session import stored

#: Distinct values that are aligned in one block.
BLOCK = 64
FIELDS = ("name", "loc", "resp", "gain")
#: Texts that stand for no value, in lower case.
PLACEHOLDERS = ("", "?", "-", "--", "n/a", "na", "null", "none", "nil", "nan", "unknown", "tbd", "tba", "todo", "test", "no name", "noname", "unnamed", "not available", "default", "-12345", "0")
GAP = ""


def usable_name(c: Column) -> Column:
    """A text that isn't blank, a placeholder, or one letter repeated."""
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return c.isNotNull() & ~s.isin(*PLACEHOLDERS) & ~s.rlike(r"^([x?.\-_*])\1*$")


def _real(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)


def usable_gain(c: Column) -> Column:
    """Positive, finite and not the default 1."""
    return _real(c) & (c > 0) & (c != 1)


def usable_loc(c: str) -> Column:
    """A point on Earth that isn't the all-zero default."""
    lat, lon = F.col(f"{c}.lat"), F.col(f"{c}.lon")
    zero = lambda k: F.coalesce(F.col(f"{c}.{k}"), F.lit(0.0)) == 0
    unset = (lat == 0) & (lon == 0) & zero("el") & zero("dep") & zero("az") & zero("inc")
    return F.col(c).isNotNull() & _real(lat) & _real(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~unset


def usable_resp(c: str) -> Column:
    """A response with poles and a positive corner frequency."""
    f0 = F.col(f"{c}.f0")
    return (F.size(f"{c}.p") > 0) & _real(f0) & (f0 > 0)


def tokens_of(field: str) -> Column:
    """The tokens of a field: words of a text, named members of a record, poles and zeros one by one."""
    if field == "name":
        return F.split(F.trim(F.regexp_replace("name", r"\s+", " ")), " ")
    if field == "gain":
        return F.array(F.col("gain").cast("string"))
    part = lambda p, k: F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"{p}.{k}").cast("string"), F.lit("")))
    if field == "loc":
        return F.array(*[part("loc", k) for k in ("datum", "lat", "lon", "el", "dep", "az", "inc")])
    many = lambda k: F.coalesce(F.transform(F.col(f"resp.{k}"), lambda r: F.concat(F.lit(f"{k}:"), F.coalesce(r["re"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["im"].cast("string"), F.lit("")))), F.array().cast("array<string>"))
    return F.concat(F.array(*[part("resp", k) for k in ("kind", "a0", "f0", "fu", "descr", "i", "o")]), many("p"), many("z"))


def group_stream(batches: Iterator[pd.DataFrame], keys: list[str], cols: list[str], fn: Callable[..., tuple], out: list[str]) -> Iterator[pd.DataFrame]:
    """Rows (columns ``out``) that fn(keys, *slices of cols) gives for every group of a partition sorted by keys.

    A group is held only while it is read; slices are arrays, so a group costs no table of its own.
    """
    def rows(b: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        ks, cs = [b[k].to_numpy() for k in keys], [b[c].to_numpy() for c in cols]
        return pd.DataFrame([fn(tuple(k[x] for k in ks), *[c[x:z] for c in cs]) for x, z in zip(at[:-1], at[1:])], columns=out)

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if len(new) > 1:
            yield rows(b, new)
        rest = b.iloc[new[-1] :].reset_index(drop=True) if new else None
    if rest is not None and len(rest):
        yield rows(rest, [0, len(rest)])


# --- profiles: a list of columns, each a dict token -> weight; GAP counts as a token


def leading(c: dict) -> str:
    """The heaviest token of a column; of equal ones the last in the alphabet."""
    return next(iter(c)) if len(c) == 1 else max(c, key=lambda t: (c[t], t))


def align(p: list[dict], q: list[dict], add: Callable, wp, wq) -> list[dict]:
    """Global alignment of two profiles; wp, wq: the weights of all of p and of q (what a gap votes with).

    Columns score 1 where their leading tokens agree, 0.5 where they share a token, -0.5 otherwise; a gap costs 0.6.
    """
    n, m = len(p), len(q)
    tp, tq = [leading(c) for c in p], [leading(c) for c in q]
    s = [[1.0 if a == b else (-0.5 if p[i].keys().isdisjoint(q[j]) else 0.5) for j, b in enumerate(tq)] for i, a in enumerate(tp)]
    d = [[-0.6 * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        up, row, si = d[-1], [-0.6 * i], s[i - 1]
        for j in range(1, m + 1):
            v = up[j - 1] + si[j - 1]
            g = up[j] - 0.6
            h = row[-1] - 0.6
            row.append(v if v >= g and v >= h else g if g >= h else h)
        d.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + s[i - 1][j - 1]:
            i, j = i - 1, j - 1
            c = dict(p[i])
            for t, w in q[j].items():
                c[t] = add(c[t], w) if t in c else w
        elif i and d[i][j] == d[i - 1][j] - 0.6:
            i -= 1
            c = dict(p[i])
            c[GAP] = add(c[GAP], wq) if GAP in c else wq
        else:
            j -= 1
            c = dict(q[j])
            c[GAP] = add(c[GAP], wp) if GAP in c else wp
        out.append(c)
    return out[::-1]


def progressive(profiles: list[tuple[list[dict], object]], add: Callable) -> tuple[list[dict], object]:
    """Aligns profiles one after the other, the weightiest first."""
    order = sorted(profiles, key=lambda x: x[1], reverse=True)
    p, w = order[0]
    for q, v in order[1:]:
        p = align(p, q, add, w, v)
        w = add(w, v)
    return p, w


def consensus(profile: list[dict]) -> list[str]:
    """The heaviest token of each column, gaps left out; of equal tokens the last in the alphabet."""
    won = [leading(c) for c in profile]
    return [t for t in won if t != GAP]


def distance(a: str, b: str) -> int:
    """Edit distance of two texts; what they begin and end with in common costs nothing to compare."""
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def away(tokens: list[str], agreed: list[str]) -> int:
    """How far a value is from the consensus: 0 if it is the same."""
    return 0 if list(tokens) == agreed else 1 + distance(" ".join(tokens), " ".join(agreed))


def survivors(
    records: DataFrame, sources: DataFrame | None = None, votes: str = "rank", fields: tuple[str, ...] = FIELDS, key: str = "rec_id", block: int = BLOCK,
) -> DataFrame:
    """id, field, rec_id: for every channel with two or more records, the record whose value survives.

    Null ids are left out; records are grouped by canonical id.  A field none of whose values is
    usable gives no row.  Null or unlisted sources have trust 0; null times rank lowest; repeated
    records are records of their own, and of equal values the highest rank's record is given.
    """
    trust = F.lit(0)
    # only what is needed, so that other columns' names can't clash
    x = records.select("id", "updated", key, *fields, *(["src"] if sources is not None else []))
    if sources is not None:
        s = sources.groupBy("src").agg(F.max("trust").alias("_trust"))
        x = x.join(s, "src", "left")
        trust = F.coalesce("_trust", F.lit(0))
    ok = {"name": usable_name(F.col("name")), "loc": usable_loc("loc"), "resp": usable_resp("resp"), "gain": usable_gain(F.col("gain"))}
    rows = F.array(*[F.when(ok[f], F.struct(F.lit(f).alias("field"), tokens_of(f).alias("tokens"))) for f in fields])
    x = x.select(canonical_id("id").alias("id"), F.struct(trust.cast("long").alias("trust"), F.unix_micros("updated").alias("us"), F.col(key).cast("long").alias("rec")).alias("rank"), rows.alias("rows")).where(F.col("id").isNotNull())
    many = x.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    # one row per distinct value: its best record and its summed weight
    v = x.select("id", "rank", F.explode("rows").alias("r")).where(F.col("r").isNotNull()).select("id", "rank", "r.field", "r.tokens")
    v = v.groupBy("id", "field", "tokens").agg(F.max("rank").alias("rank"), F.sum(F.col("rank.trust") + 1).alias("weight")).join(many, "id")
    # a channel has at most as many values of a field as records
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    v = stored(v.select("id", "field", F.pmod(F.xxhash64(F.concat_ws("\u0001", "tokens")), blocks).alias("block"), blocks.alias("blocks"), "tokens", F.col("rank.trust").alias("trust"), F.col("rank.us").alias("us"), F.col("rank.rec").alias("rec"), "weight"))
    add = max if votes == "rank" else (lambda a, c: (a[0] + c[0],))

    def place(t, u, r) -> tuple:
        return int(t), -1 if pd.isna(u) else int(u), int(r)

    def weigh(t, u, r, w) -> tuple:
        return place(t, u, r) if votes == "rank" else (int(w),)

    def pick(agreed: list[str], tokens, trust, us, rec) -> int:
        """The record of the value closest to the consensus, of equally close ones that of the highest rank."""
        far = [away(t, agreed) for t in tokens]
        return max((-d, place(*x), int(x[2])) for d, x in zip(far, zip(trust, us, rec)))[2]

    def first(keys: tuple, many, tokens, trust, us, rec, weight) -> tuple:
        if many[0] == 1 and len(tokens) == 1:  # nothing to align: the only value is its own consensus
            return *keys, 1, None, None, int(rec[0])
        ps = [([{tok: k} for tok in toks], k) for toks, k in ((t, weigh(*x)) for t, x in zip(tokens, zip(trust, us, rec, weight)))]
        p, w = progressive(ps, add)
        if many[0] == 1:
            return *keys, 1, None, None, pick(consensus(p), tokens, trust, us, rec)
        return *keys, int(many[0]), json.dumps(p), json.dumps(w), None

    def merged(keys: tuple, many, cols, weights) -> tuple:
        ps = [([{t: tuple(k) for t, k in c.items()} for c in json.loads(c_)], tuple(json.loads(w))) for c_, w in zip(cols, weights)]
        p, w = progressive(ps, add)
        return *keys, int(many[0]), json.dumps(p), json.dumps(w)

    group = ["id", "field", "block"]

    def run(df: DataFrame, cols: list[str], fn: Callable[..., tuple], out: str) -> DataFrame:
        names = [c.split()[0] for c in out.split(", ")]
        return df.select(*group, *cols).repartition(*group).sortWithinPartitions(*group).mapInPandas(lambda it: group_stream(it, group, cols, fn, names), out)

    shape = "id string, field string, block bigint, blocks bigint, cols string, w string"  # a profile travels as JSON
    values = ["tokens", "trust", "us", "rec", "weight"]
    most = v.agg(F.max("blocks")).first()[0] or 1
    done = run(v, ["blocks", *values], first, f"{shape}, found bigint")
    if most == 1:
        return done.select("id", "field", F.col("found").alias(key))
    done = stored(done)
    prof = done.where(F.col("found").isNull()).drop("found")
    for _ in range(math.ceil(math.log(most, block) - 1e-9)):
        prof = run(prof.withColumn("block", F.floor(F.col("block") / block)), ["blocks", "cols", "w"], merged, shape)
    agreed = F.udf(lambda c: json.dumps(consensus([{t: tuple(k) for t, k in x.items()} for x in json.loads(c)])))  # a row a large group
    # values of large groups are compared where they are, block by block, and the best of each block with one another
    large = v.where("blocks > 1").join(prof.select("id", "field", agreed("cols").alias("cols")), ["id", "field"])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["far"] = [away(t, json.loads(c)) for t, c in zip(b["tokens"], b["cols"])]
            yield b[["id", "field", "far", "trust", "us", "rec"]]

    far = large.select("id", "field", "cols", "tokens", "trust", "us", "rec").mapInPandas(close, "id string, field string, far bigint, trust bigint, us bigint, rec bigint")
    best = far.groupBy("id", "field").agg(F.max(F.struct((-F.col("far")).alias("d"), "trust", "us", "rec")).alias("m")).select("id", "field", F.col("m.rec").alias(key))
    return done.where(F.col("found").isNotNull()).select("id", "field", F.col("found").alias(key)).unionByName(best)
