"""Problem 7: filling fixed-capacity containers with items.

Exact-complement hashing on the histogram of lengths: for every length, from the longest down, the
sums of single lengths, pairs and triples are looked up that exactly fill the room left, and
consumed as often as their counts allow; what remains is filled best-fit.  The plan is computed from
at most ``capacity`` counts, however many items there are; items then find their container by their
rank among items of their length.  An item longer than the capacity is cut into full containers and
a rest; no other item is split.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolite.session import cut, spread

#: Rank vocabulary of the tokenizer (a file of base64 tokens and ranks).
VOCABULARY = os.environ.get("TREMOLITE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one length that are ranked in one task, about.
RANK_ITEMS = 1_000_000

_loaded: dict = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, read once per Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc, tokens: length of each whole text; null and empty texts have 0."""
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[doc, "tokens"])

    return spread(documents.select(doc, F.col(text).alias("_t"))).mapInArrow(run, f"`{doc}` {kind}, tokens bigint")


def plan(counts: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one container, number of such containers) from counts of lengths 1..cap.

    Every item is placed exactly once.  At most a few containers' kinds per length arise.
    """
    have = np.zeros(cap + 1, np.int64)
    for n, c in counts.items():
        if not 1 <= n <= cap:
            raise ValueError(f"length {n} is outside 1..{cap}")
        have[n] += c
    nz = np.flatnonzero(have)
    sums = np.zeros(2 * cap + 2, bool)  # whether some pair may have this sum; false entries are final
    for a in nz:
        sums[a + nz] = True
    out: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...]) -> bool:
        need = Counter(parts)
        m = min(int(have[k]) // c for k, c in need.items())
        if m:
            for k, c in need.items():
                have[k] -= m * c
            out.append((parts, m))
        return m > 0

    def pair(g: int, besides: Counter) -> tuple[int, int] | None:
        """Two lengths with sum g, the pair with most copies first."""
        lo = nz[(nz <= g // 2)]
        if not len(lo):
            return None
        left = have.copy() if besides else have
        for k, c in besides.items():
            left[k] -= c
        a, b = left[lo], left[g - lo]
        m = np.where(2 * lo == g, a // 2, np.minimum(a, b))
        k = int(np.argmax(m))
        return (int(lo[k]), int(g - lo[k])) if m[k] > 0 else None

    for n in range(cap, 0, -1):
        while have[n]:
            nz = nz[have[nz] > 0]
            g = cap - n
            if g == 0:
                take((n,))
                continue
            if have[g] > (g == n) and take((n, g)):
                continue
            p = pair(g, Counter([n]))
            if p and take((n, *p)):
                continue
            done = False
            small = nz[nz < g]
            for a in small[sums[g - small]][::-1]:
                p = pair(int(g - a), Counter([n, int(a)]))
                if p and take((n, int(a), *p)):
                    done = True
                    break
                if p is None and pair(int(g - a), Counter()) is None:
                    sums[g - a] = False
            if done:
                continue
            # best fit: the longest item that fits, again and again
            parts, room, left = [n], g, Counter([n])
            while room:
                fit = nz[nz <= room]
                fit = [int(k) for k in fit[::-1][:64] if have[k] > left[int(k)]] or [int(k) for k in fit[::-1] if have[k] > left[int(k)]][:1]
                if not fit:
                    break
                parts.append(fit[0])
                left[fit[0]] += 1
                room -= fit[0]
            take(tuple(parts))
    return out


class Slots:
    """Where the items of each length go: rank r of a length -> container."""

    def __init__(self, kinds: list[tuple[tuple[int, ...], int]]):
        by: dict[int, list[tuple[int, int]]] = {}
        used: Counter = Counter()
        base = 0
        for parts, m in kinds:
            for n in parts:
                by.setdefault(n, []).append((used[n], base))
                used[n] += m
            base += m
        self.containers = base
        self.by = {n: (np.array([a for a, _ in s]), np.array([b for _, b in s])) for n, s in by.items()}

    def of(self, n: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.full(len(n), -1, np.int64)
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            start, base = self.by[int(k)]
            j = np.searchsorted(start, r[at], "right") - 1
            out[at] = base[j] + r[at] - start[j]
        return out


def pieces(counts: DataFrame, caps: dict[str, int], doc: str = "doc_id") -> DataFrame:
    """box, doc, piece, first_token, tokens: items as they are, or cut where they exceed the capacity."""
    arr = F.array(*[F.struct(F.lit(b).alias("box"), F.lit(c).cast("long").alias("cap")) for b, c in sorted(caps.items())])
    x = counts.where("tokens > 0").select(doc, "tokens", F.explode(arr).alias("b"))
    x = x.select("b.box", "b.cap", doc, F.col("tokens").alias("_n"), F.explode(F.expr("sequence(0L, (tokens - 1) div b.cap)")).alias("piece"))
    return x.select("box", doc, "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.least("cap", F.col("_n") - F.col("piece") * F.col("cap")).alias("tokens"))


def pack(counts: DataFrame, boxes: DataFrame, doc: str = "doc_id", rank_items: int = RANK_ITEMS) -> DataFrame:
    """box, container, doc, piece, first_token, tokens: where every item goes.

    counts: doc, tokens.  Items of no tokens go nowhere; repeated documents are items of their own.
    boxes: box, cap_tokens, a small fixed table; capacities below 1 or null raise ValueError.
    """
    caps = {r["box"]: r["cap_tokens"] for r in boxes.select("box", "cap_tokens").collect()}
    if any(c is None or c < 1 for c in caps.values()):
        raise ValueError("a capacity must be at least 1")
    kind = counts.schema[doc].dataType.simpleString()
    if not caps:
        return counts.sparkSession.createDataFrame([], f"box string, container bigint, `{doc}` {kind}, piece bigint, first_token bigint, tokens bigint")
    src = cut(counts)  # lengths are needed twice; texts are tokenised once
    x = pieces(src, caps, doc)
    shards = -(-src.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.col("tokens") / min(caps.values()))), F.lit(0))).first()[0] // rank_items)
    x = x.withColumn("_sh", F.pmod(F.xxhash64(doc, "piece"), F.lit(max(1, int(shards)))))
    per = x.groupBy("box", "tokens", "_sh").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("box", "tokens").orderBy("_sh").rowsBetween(Window.unboundedPreceding, -1)
    # at most capacity x boxes rows: the histogram of lengths is bounded by the capacities
    hist: dict[str, dict[int, int]] = {b: {} for b in caps}
    for r in per.groupBy("box", "tokens").agg(F.sum("_c").alias("c")).collect():
        hist[r["box"]][r["tokens"]] = r["c"]
    slots = {b: Slots(plan(h, caps[b])) for b, h in hist.items()}
    shared = src.sparkSession.sparkContext.broadcast(slots)
    off = per.select("box", "tokens", "_sh", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    r = F.row_number().over(Window.partitionBy("box", "tokens", "_sh").orderBy(doc, "piece")) - 1
    x = x.withColumn("_r", r).join(off, ["box", "tokens", "_sh"]).withColumn("_r", (F.col("_r") + F.col("_off")).cast("long"))

    @F.pandas_udf("long")
    def place(box: pd.Series, n: pd.Series, rank: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(n), -1, np.int64), index=n.index)
        for b in box.unique():
            k = (box == b).to_numpy()
            out[k] = shared.value[b].of(n.to_numpy()[k], rank.to_numpy()[k])
        return out

    return x.select("box", place("box", "tokens", "_r").alias("container"), doc, "piece", "first_token", "tokens")


def filling(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """box, container, cap_tokens, items, used: the filling of each container."""
    f = placed.groupBy("box", "container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("used"))
    return f.join(F.broadcast(boxes.select("box", F.col("cap_tokens").cast("long").alias("cap_tokens"))), "box").select("box", "container", "cap_tokens", "items", "used")
