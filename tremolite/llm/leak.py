"""Problem 8: evaluation texts leaking into training text.

Item-sized windows of words are embedded with CGK random walks, which map edit distance to
Hamming distance; repeated bit sampling gives LSH keys; a document's windows look their keys
up among the items' windows, and every candidate is verified by an exact edit alignment of the
words (dynamic programming over all word pairs that agree).  Items are a stated query set of bounded size: they go to the documents in blocks, and
the whole search is one pass over the documents without a shuffle.  A first pass counts in how
many distinct documents each item's word sequences occur, to know procedural formulas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.llm import text as T
from tremolite.session import spread, stored

#: Words of a window and distance between a document's windows: a run of LEAST words holds whole windows.
WINDOW, STRIDE = 12, 3
#: Words of exact seeds, looked up at every word: 25 words with up to three edits hold one.
SEED = 6
#: CGK walks, samples of each walk, positions of a sample.
WALKS, SAMPLES, BITS = 2, 4, 16
#: Words in sequence that make a leak.
LEAST = 25
#: Words that an interruption may insert if RESUMED words agree after it, and if SEED words agree.
INSERTED, INSERTED_FAR, RESUMED = 12, 60, 2
#: Own words that the parts of a leak between interruptions have at least, if they follow on one another but for fewer than SEED words.
FIRST = 9
#: A sequence of FORMULA words in at least this share of the documents (and FORMULA_LEAST of them) is no own wording.
FORMULA, FORMULA_SHARE, FORMULA_LEAST = 12, 0.009, 8
#: ... unless it is part of a stretch of more than so many such words: no formula is so long, an item copied into many documents is.
FORMULA_MOST = 60
#: Texts are copies of one another if a band of ROWS minimal hashes of their shingles agrees in any of BANDS.
SHINGLE, BANDS, ROWS = 5, 4, 2
#: Equal words that are passed together at most.
PAD = 32
#: Windows whose keys are made at once: their arrays stay in the processor's cache.
PIECE = 1 << 13
#: Words of items sent to the documents at once, and of all items together.
BLOCK_WORDS, ITEM_WORDS = 1_000_000, 20_000_000


class Cgk:
    """Seeded CGK walks over windows of word hashes and the bit-sampling keys of their ends."""

    def __init__(self, window: int = WINDOW, walks: int = WALKS, samples: int = SAMPLES, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window, self.steps = window, 3 * window
        self.mul = rng.integers(1, 2**63, (walks, self.steps), dtype=np.uint64) | np.uint64(1)
        # positions past 2 * window mostly hold padding
        self.at = [[np.sort(rng.choice(2 * window, bits, replace=False)) for _ in range(samples)] for _ in range(walks)]
        self.coef = rng.integers(1, 2**63, (walks, samples, bits), dtype=np.uint64) | np.uint64(1)

    def keys(self, h: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
        """For each sample the keys of the windows of h that start at ``start``."""
        w, pad = self.window, np.uint64(0)
        end, tmp = start + w, np.empty(len(start), np.uint64)
        for mul, ats, coefs in zip(self.mul, self.at, self.coef):
            need = max(int(a[-1]) for a in ats) + 1
            wanted = {int(p) for a in ats for p in a}
            ptr = start.astype(np.int64)
            out = {}
            for s in range(need):
                if s >= w:  # only now a walk can be past the end
                    tok = np.where(ptr < end, h[np.minimum(ptr, end - 1)], pad)
                else:
                    tok = h[ptr]
                if s in wanted:
                    out[s] = tok
                np.multiply(tok, mul[s], out=tmp)
                np.right_shift(tmp, np.uint64(63), out=tmp)
                ptr += tmp.view(np.int64)
            for a, c in zip(ats, coefs):
                key = np.zeros(len(start), np.uint64)
                for p, m in zip(a, c):
                    key += np.multiply(out[int(p)], m, out=tmp)
                key ^= key >> np.uint64(32)
                yield key * np.uint64(0x9E3779B97F4A7C15)


def similar(a: str, b: str) -> bool:
    """Whether one word may be a misspelling of the other: they differ in one place of at most two letters
    (swapped, left out, doubled, taken for others), or from eight letters on by an edit distance of 2.  Numbers are never misspelt."""
    if a == b:
        return True
    n = min(len(a), len(b))
    if n < 3 or abs(len(a) - len(b)) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    if max(len(a), len(b)) - p - q <= 2:
        return 3 * (p + q) >= n
    if n < 8:
        return False
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        prev2, prev = prev, cur
    return prev[-1] <= 2


def pairs_of(h: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word and the one after it in the direction of ``step``; the last word stands for the one after it."""
    after = np.r_[h[1:], h[-1:]] if step > 0 else np.r_[h[:1], h[:-1]]
    return h * np.uint64(0xD6E8FEB86659FD93) + after


def slots(h: np.ndarray) -> np.ndarray:
    """The bit of a hash in a set of 64 bits."""
    return h >> np.uint64(58)


def ahead(h: np.ndarray, step: int) -> np.ndarray:
    """For each place the set (of 64 bits) of the INSERTED hashes after it in the direction of ``step``."""
    s = np.r_[np.uint64(1) << slots(h)[::step], np.zeros(INSERTED, np.uint64)][1:]
    n = 1
    while 2 * n <= INSERTED:
        s = s[: len(s) - n] | s[n:]
        n *= 2
    more = INSERTED - n  # the sets overlap
    return (s[: len(h)] | s[more : more + len(h)])[::step]


class Ahead:
    """Of a block of texts, for each word and both directions, the sets of words and word pairs that come within INSERTED words; the words with PAD
    zeros around them."""

    def __init__(self, x: T.Words):
        self.padded = np.pad(x.h, PAD)
        self.sets = {(step, insert): ahead(pairs_of(x.h, step) if insert else x.h, step) for step in (1, -1) for insert in (False, True)}


def reach(
    it: Items, x: T.Words, bounds: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, step: int, insert: bool | None, soon: Ahead
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far alignments from many candidates go, with what hashes, lengths and letters of words tell: the first item word not covered, the
    first document word, and whether they went over anything but equal words.

    A word passes for a misspelling by its length and letters only.  ``insert``: where a word may be misspelt or the first of an
    interruption, it is taken for the interruption; None: all but misspelt words ends an
    alignment.  i, j: places in it.h and x.h; bounds: the first and last
    such places + 1 of each item and document; soon: the sets of x, to look for the end of an interruption only where there may be one.
    """
    ilo, ihi, dlo, dhi = bounds
    if step < 0:
        i, j = i - 1, j - 1
    ni, nd = len(it.h), len(x.h)
    size = x.z - x.a
    i, j = i.copy(), j.copy()
    bent = np.zeros(len(i), bool)
    live = np.arange(len(i))
    g = step * np.arange(1, INSERTED + 1)

    while True:
        a, b = i[live], j[live]
        if step > 0:
            room = np.minimum(ihi[live] - a, dhi[live] - b)
        else:
            room = np.minimum(a - ilo[live], b - dlo[live]) + 1
        inside = room > 0
        if not inside.all():
            live, a, b, room = live[inside], a[inside], b[inside], room[inside]
        if not len(live):
            break
        same = it.h[a] == x.h[b]
        eq, ne = np.flatnonzero(same), np.flatnonzero(~same)
        di, dj = np.ones(len(live), np.int64), np.ones(len(live), np.int64)
        if len(eq):  # equal words are passed together
            run = PAD + step * np.arange(1, PAD + 1 if len(live) < 512 else 5)
            other = it.padded[a[eq, None] + run] != soon.padded[b[eq, None] + run]
            n = np.minimum(np.where(other.any(1), other.argmax(1), len(run)) + 1, room[eq])
            di[eq], dj[eq] = n, n
        if len(ne):
            k, a, b = live[ne], a[ne], b[ne]
            sa, sb = it.size[a], size[b]
            close = (np.bitwise_count(it.bag[a] ^ x.bag[b]) <= 4) & (np.abs(sa - sb) <= 2)
            if insert is None:
                di[ne] = close
            else:
                # run together or split words can't be told by hashes: by their lengths
                la, lb = it.size[np.minimum(np.maximum(a + step, 0), ni - 1)], size[np.minimum(np.maximum(b + step, 0), nd - 1)]
                joined = (sa + la == sb) & ~close
                split = (sb + lb == sa) & ~close & ~joined
                gi, gj = np.where(joined, 2, 1), np.where(split, 2, 1)
                go = close | joined | split
                m = np.arange(len(k)) if insert else np.flatnonzero(~go)
                m = m[(soon.sets[step, insert][b[m]] >> it.slots[step, insert][a[m]]) & np.uint64(1) != 0]
                if len(m):
                    # the nearest place after an interruption where the word comes again
                    q = b[m, None] + g
                    hit = (x.h[np.minimum(np.maximum(q, 0), nd - 1)] == it.h[a[m], None]) & (q >= dlo[k[m], None]) & (q < dhi[k[m], None])
                    if insert:
                        nxt, q2 = np.minimum(np.maximum(a[m] + step, 0), ni - 1), np.minimum(np.maximum(q + step, 0), nd - 1)
                        hit &= x.h[q2] == it.h[nxt][:, None]
                    far = hit.argmax(1)
                    found = hit[np.arange(len(m)), far]
                    gi[m[found]], gj[m[found]], go[m[found]] = 1, far[found] + 2, True
                di[ne], dj[ne] = np.where(go, gi, 0), gj
            bent[k] |= di[ne] > 0
        i[live] += step * di
        j[live] += step * dj
        live = live[di > 0]
    return (i, j, bent) if step > 0 else (i + 1, j + 1, bent)


def distinct(v: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    v = np.sort(v)
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def starts(it: Items, x: T.Words, s: np.ndarray, i: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item word, document word, words that agree from there on) to align from: seeds (q, m), and of window pairs (s, i) that hold no
    seed every diagonal up to three words off on which two words in sequence agree."""
    w, big, rows = it.cgk.window, np.int64(len(x.h) + 1), np.int64(len(it.h) + 1)
    # a window pair is settled by a seed on one of its diagonals within it
    seed = np.sort((q - m + rows) * rows + m)
    order = np.argsort((s - i + rows) * rows + i)  # what is looked up in order is found faster
    s, i = s[order], i[order]
    left = np.ones(len(s), bool)
    for shift in range(-3, 4) if len(seed) else ():
        key = (s - i + shift + rows) * rows + i
        at = np.searchsorted(seed, key)
        left &= ~((at < len(seed)) & (seed[np.minimum(at, len(seed) - 1)] <= key + w - SEED))
    s, i = s[left], i[left]
    ks = [np.zeros(0, np.int64)]
    for shift in range(-3, 4) if len(s) else ():
        p, d = i, s + shift
        for a in range(w - 1):
            pa, da = np.minimum(p + a, len(it.h) - 2), np.clip(d + a, 0, len(x.h) - 2)
            hit = it.h[pa] == x.h[da]
            hit[hit] = it.h[pa[hit] + 1] == x.h[da[hit] + 1]
            ks.append(pa[hit] * big + da[hit])
            p, d = p[~hit], d[~hit]
    key, known = distinct(np.concatenate(ks)), np.sort(m * big + q)
    if len(known):  # of equal ones the seed
        key = key[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key]
    both = np.r_[known, key]
    return both // big, both % big, np.repeat([SEED, RESUMED], [len(known), len(key)])


def stretches(it: Items, x: T.Words, d: np.ndarray, o: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, z: np.ndarray, slack: int) -> np.ndarray:
    """Number of the stretch each alignment (item words lo to hi, document words a to z) belongs to: those of one document and item that are
    near each other in the document, and of these those that follow on one another in the item but for ``slack`` words."""

    def islands(group: np.ndarray, s: np.ndarray, e: np.ndarray, slack: int) -> np.ndarray:
        top = max(len(it.h), len(x.h)) + 1
        order = np.argsort(group * np.int64(top) + s) if (int(group.max()) + 1) * top < 2**63 else np.lexsort((s, group))
        g, s, e = group[order], s[order], e[order]
        num = np.cumsum(np.r_[0, g[1:] != g[:-1]])
        # the furthest end so far within each group: groups are kept apart by an offset
        off = num * np.int64(max(len(it.h), len(x.h)) + INSERTED_FAR + 99)
        end = np.maximum.accumulate(e + off) - off
        out = np.empty(len(g), np.int64)
        out[order] = np.cumsum(np.r_[0, (num[1:] != num[:-1]) | (s[1:] > end[:-1] + slack)])
        return out

    near = islands(d * np.int64(len(it.ids)) + o, a, z, INSERTED_FAR + SEED)
    return islands(near, lo, hi, slack)


def promising(it: Items, x: T.Words, i: np.ndarray, j: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, first and last document word, first and last item word) of the stretches whose alignments could hold LEAST own words.

    Most starts go nowhere: they are first followed without interruptions, and those whose stretch has fewer than FIRST own words are left.
    """
    own = lambda lo, hi: it.own_before[np.clip(hi, 0, len(it.h))] - it.own_before[np.clip(lo, 0, len(it.h))]
    soon = Ahead(x)

    def follow(bounds: tuple[np.ndarray, ...], i0: np.ndarray, j0: np.ndarray, i1: np.ndarray, j1: np.ndarray, *way: bool | None) -> tuple[np.ndarray, ...]:
        """Where alignments end that cover i0 to i1 and j0 to j1, and whether they went over anything but equal words."""
        bent = np.zeros(len(i0), bool)
        for insert in way:
            i1, j1, b1 = reach(it, x, bounds, i1, j1, 1, insert, soon)
            i0, j0, b0 = reach(it, x, bounds, i0, j0, -1, insert, soon)
            bent |= b1 | b0
        return i0, j0, i1, j1, bent

    d, o = np.searchsorted(x.first, j, "right") - 1, np.searchsorted(it.first, i, "right") - 1
    for full in (False, True):
        if not len(i):
            return (i,) * 6
        bounds = it.first[o], it.first[o + 1], x.first[d], x.first[d + 1]
        if not full:
            lo, a, hi, z, bent = follow(bounds, i, j, i + known, j + known, None)
        else:
            # where one way ends another may go on; up to lo and hi the first one follows the diagonal
            first = lo, j - (i - lo), hi, j + (hi - i)
            i0, j0, i1, j1, turned = follow(bounds, *first, False, True)
            # both ways are the same where neither goes over anything but equal words: a word more after an interruption is all that the second one sees
            far = INSERTED + 1
            beyond = (it.h[np.minimum(hi, len(it.h) - 1)] == x.h[np.minimum(first[3] + far, len(x.h) - 1)]) | (it.h[np.maximum(lo - 1, 0)] == x.h[np.maximum(first[1] - 1 - far, 0)])
            k = np.flatnonzero(bent | turned | beyond | (i0 != lo) | (i1 != hi))
            second = follow(tuple(v[k] for v in bounds), i[k], j[k], i[k] + known[k], j[k] + known[k], True, False)
            lo, a, hi, z = i0, j0, i1, j1
            lo[k], a[k], hi[k], z[k] = np.minimum(lo[k], second[0]), np.minimum(a[k], second[1]), np.maximum(hi[k], second[2]), np.maximum(z[k], second[3])
        lo, hi = np.minimum(lo, i), np.maximum(hi, i + known)
        a, z = np.minimum(j, np.maximum(a, bounds[2])), np.maximum(j + known, np.minimum(z, bounds[3]))
        num = stretches(it, x, d, o, lo, hi, a, z, 0 if full else SEED - 1)
        order = np.argsort(num)
        at = np.flatnonzero(np.r_[True, num[order][1:] != num[order][:-1]])
        low, top = np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)
        k = own(low, top) >= (LEAST if full else FIRST)
        if full:
            return d[order][at][k], o[order][at][k], np.minimum.reduceat(a[order], at)[k], np.maximum.reduceat(z[order], at)[k], low[k], top[k]
        keep = k[num]
        i, j, known, d, o, lo, hi, bent = i[keep], j[keep], known[keep], d[keep], o[keep], lo[keep], hi[keep], bent[keep]
    raise AssertionError


def align(iw: list[str], own: np.ndarray, dw: list[str] | Spelt, eq: np.ndarray, close: np.ndarray, li: np.ndarray, ld: np.ndarray, bi: np.ndarray, bd: np.ndarray) -> tuple[int, int, int]:
    """(own words, first item word, last item word + 1) of the best alignment of consecutive item words with document words in order; zeros
    where it has fewer than LEAST own words.

    Exact, by dynamic programming over the word pairs that agree.  Agreeing are equal words, and, beside an equal pair on their diagonal,
    misspelt ones (``similar``); two words may be run together, or one split.  Between item words the document may
    have up to INSERTED words more if RESUMED words agree after them, one of them equal, or up to INSERTED_FAR if SEED equal ones follow.
    eq, close: which pairs are equal, or may be misspelt by their letters; li, ld: sizes of words; bi, bd: their letters.
    """
    n, m = eq.shape
    near = np.zeros_like(eq)
    near[1:, 1:] |= eq[:-1, :-1]
    near[:-1, :-1] |= eq[1:, 1:]
    ok = eq.copy()
    maybe = close & near & ~eq
    joined = (li[:-1, None] + li[1:, None] == ld[None, :]) & (bi[:-1, None] | bi[1:, None] == bd[None, :])
    split = (li[:, None] == ld[None, :-1] + ld[None, 1:]) & (bi[:, None] == bd[None, :-1] | bd[None, 1:])
    before = np.r_[0, np.cumsum(own)]

    def enough(some: np.ndarray) -> bool:
        """Whether item words with which something agrees hold LEAST own ones in sequence: a word with which nothing agrees ends every alignment."""
        edge = np.flatnonzero(np.diff(np.r_[0, some.astype(np.int8), 0]))
        return len(edge) > 0 and bool((before[edge[1::2]] - before[edge[::2]]).max() >= LEAST)

    some = (eq | maybe).any(1) | split.any(1)
    some[:-1] |= joined.any(1)
    some[1:] |= joined.any(1)
    if not enough(some):  # before any word is spelt out
        return (0, 0, 0)
    for a, b in zip(*(v.tolist() for v in np.nonzero(maybe))):
        ok[a, b] = similar(iw[a], dw[b])
    both: dict[int, list[tuple[int, int, int]]] = {}  # last row: (last column, rows, columns)
    for a, b in zip(*(v.tolist() for v in np.nonzero(joined))):
        if iw[a] + iw[a + 1] == dw[b]:
            both.setdefault(a + 1, []).append((b, 2, 1))
    for a, b in zip(*(v.tolist() for v in np.nonzero(split))):
        if iw[a] == dw[b] + dw[b + 1]:
            both.setdefault(a, []).append((b + 1, 1, 2))
    some = ok.any(1)
    for a, bs in both.items():
        some[a - max(b[1] for b in bs) + 1 : a + 1] = True
    if not enough(some):
        return (0, 0, 0)
    two = np.zeros_like(eq)  # RESUMED words agree from here on; at the item's end one will do
    two[:-1, :-1] = ok[:-1, :-1] & ok[1:, 1:] & (eq[:-1, :-1] | eq[1:, 1:])
    two[-1] = eq[-1]
    seed = np.zeros_like(eq)  # SEED equal words from here on
    if n >= SEED and m >= SEED:
        seed[: n - SEED + 1, : m - SEED + 1] = np.logical_and.reduce([eq[k : n - SEED + 1 + k, k : m - SEED + 1 + k] for k in range(SEED)])
    cells: dict[int, list[tuple[int, int]]] = {}  # row: (column, words that an interruption before it may have, -1 if none ends here)
    at = np.nonzero(ok)
    for a, b, far in zip(*(v.tolist() for v in (*at, np.where(two[at], np.where(seed[at], INSERTED_FAR, INSERTED), -1)))):
        cells.setdefault(a, []).append((b, far))
    before = before.tolist()
    best = (0, 0, 0)
    rows: dict[int, dict[int, int]] = {}  # row: column: the earliest item word from which on all are covered
    for a in range(n):
        row, up = {}, rows.get(a - 1, {})
        for b, far in cells.get(a, ()):
            lo = min(a, up.get(b - 1, a))
            if up and far >= 0:
                for c, v in up.items():
                    if v < lo and 2 <= b - c <= far + 1:
                        lo = v
            row[b] = lo
        for b, da, db in both.get(a, ()):
            lo = min(a - da + 1, rows.get(a - da, {}).get(b - db, a - da + 1))
            row[b] = min(lo, row.get(b, lo))
        if row:
            rows[a] = row
            lo = min(row.values())
            v = before[a + 1] - before[lo]
            if v > best[0]:
                best = (v, lo, a + 1)
    return best


class Spelt:
    """The words of a block of texts from a place on, spelt out where they are asked for."""

    def __init__(self, x: T.Words, first: int):
        self.x, self.first = x, first

    def __getitem__(self, k: int) -> str:
        return self.x.word(self.first + k)


def verified(it: Items, x: T.Words, d: np.ndarray, o: np.ndarray, j0: np.ndarray, j1: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """(document, item, alignment) of the stretches that hold LEAST own words: of each document and item the best.

    The parts of item and document that are aligned are those the stretch can reach.
    """
    size = x.z - x.a
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for dk, ok, a, z, l, h in zip(d.tolist(), o.tolist(), j0.tolist(), j1.tolist(), lo.tolist(), hi.tolist()):
        # and a little more: single words beyond an interruption
        ia, iz = max(int(it.first[ok]), l - SEED), min(int(it.first[ok + 1]), h + SEED)
        da, dz = max(int(x.first[dk]), a - SEED - INSERTED), min(int(x.first[dk + 1]), z + SEED + INSERTED)
        eq = it.h[ia:iz, None] == x.h[None, da:dz]
        close = (np.bitwise_count(it.bag[ia:iz, None] ^ x.bag[None, da:dz]) <= 4) & (np.abs(it.size[ia:iz, None] - size[None, da:dz]) <= 2)
        off = int(it.first[ok])
        v = align(it.words[ok][ia - off : iz - off], it.own[ok][ia - off : iz - off], Spelt(x, da), eq, close, it.size[ia:iz], size[da:dz], it.bag[ia:iz], x.bag[da:dz])
        v = (v[0], v[1] + ia - off, v[2] + ia - off)
        if v[0] >= LEAST and v[0] > found.get((dk, ok), (0, 0, 0))[0]:
            found[dk, ok] = v
    for (dk, ok), v in sorted(found.items()):
        yield dk, ok, v


class Items:
    """A block of items: words, own wording and LSH index; pickled once per block."""

    def __init__(self, ids: list[int], texts: list[str | None], cgk: Cgk):
        w = T.words(texts)
        self.ids, self.cgk = ids, cgk
        self.first, self.h, self.bag, self.size = w.first, w.h, w.bag, (w.z - w.a)
        self.words = [[w.word(k) for k in range(a, z)] for a, z in zip(w.first[:-1], w.first[1:])]
        self.own = [np.ones(len(x), bool) for x in self.words]
        ok = np.r_[True, np.zeros(max(0, len(w.h) - 1), bool)][: len(w.h)]
        ok[:] = False
        for a, z in zip(w.first[:-1], w.first[1:]):
            ok[a : max(a, z - cgk.window + 1)] = True
        self.start = np.flatnonzero(ok)
        self.item = np.searchsorted(self.first, self.start, "right") - 1

    def grams(self, n: int = FORMULA) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place in h) of all sequences of n words inside one item."""
        g = T.ngrams(self.h, n)
        at = np.arange(len(g))
        inside = np.searchsorted(self.first, at, "right") == np.searchsorted(self.first, at + n - 1, "right")
        return g[inside], at[inside]

    def mark(self, formulas: np.ndarray, n: int = FORMULA) -> None:
        """Words of formulas are no own wording."""
        g, at = self.grams(n)
        off = np.zeros(len(self.h), bool)
        for k in at[np.isin(g, formulas)]:
            off[k : k + n] = True
        edge = np.flatnonzero(np.diff(np.r_[0, off.astype(np.int8), 0]))
        for a, z in zip(edge[::2], edge[1::2]):
            if z - a > FORMULA_MOST:
                off[a:z] = False
        for j, (a, z) in enumerate(zip(self.first[:-1], self.first[1:])):
            self.own[j] = ~off[a:z]

    def index(self) -> None:
        """LSH tables of the windows that are own wording throughout: a leak holds some, formulas none."""
        self.own_before = np.r_[0, np.cumsum(np.concatenate(self.own))] if self.own else np.zeros(1, int)
        foreign = np.arange(len(self.own_before)) - self.own_before
        keep = foreign[self.start + self.cgk.window] == foreign[self.start]
        self.start, self.item = self.start[keep], self.item[keep]
        self.tables = [T.Lookup(k) for k in self.cgk.keys(self.h, self.start)]
        # seeds too are own wording throughout
        g, at = self.grams(SEED)
        own = foreign[at + SEED] == foreign[at]
        self.seed_at, self.seeds = at[own], T.Lookup(g[own])
        self.padded, self.gram = np.pad(self.h, PAD), T.ngrams(self.h, SEED)
        self.seeded = np.zeros(len(self.h) + 1, bool)
        self.seeded[self.seed_at] = True
        self.slots = {(step, insert): slots(pairs_of(self.h, step) if insert else self.h) for step in (1, -1) for insert in (False, True)}


class Sketch:
    """Where a text comes from: a hash of its words and, for copies with corrections, bands of minimal hashes of its shingles."""

    def __init__(self, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shingle = shingle
        self.mul = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def of(self, x: T.Words, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, bands) of each text with words; shingles that lie in item sequences (words ``inside``) don't count."""
        n = np.diff(x.first)
        has = np.flatnonzero(n > 0)
        at, n = x.first[:-1][has], n[has]
        place = (np.arange(len(x.h)) - np.repeat(at, n)).astype(np.uint64)
        key = np.add.reduceat(x.h * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
        key ^= key >> np.uint64(31)
        bands = np.repeat(key[:, None], len(self.mul), 1)  # a text of a few words is only like itself
        long = n >= self.shingle
        if long.any():
            top = np.uint64(2**64 - 1)
            g = np.r_[T.ngrams(x.h, self.shingle), np.zeros(self.shingle - 1, np.uint64)]
            count = np.r_[0, np.cumsum(inside)]
            skip = np.ones(len(g), bool)
            skip[: len(g) - self.shingle + 1] = count[self.shingle :] - count[: -self.shingle] == self.shingle
            last = np.arange(len(g)) + self.shingle > np.repeat(at + n, n)  # runs on into the next text
            for b, (ms, xs) in enumerate(zip(self.mul, self.mix)):
                band = np.full(len(at), np.uint64(b))
                for m, c in zip(ms, xs):
                    v = (g ^ c) * m
                    v[skip | last] = top
                    band = (band ^ np.minimum.reduceat(v, at)) * c
                    band ^= band >> np.uint64(29)
                bands[long, b] = band[long]
        return key, bands


def formulas(documents: DataFrame, items: list[Items], doc: str, text: str, share: float, least: int, n: int = FORMULA) -> np.ndarray:
    """Hashes of the items' word sequences that occur in at least ``share`` of all distinct documents with text.

    Copies and reissues of a document count once, with whatever they have around the item's sequences; a
    sequence counts once for each such group.  The result is bounded by the items, whatever the documents.
    """
    known = np.unique(np.concatenate([i.grams(n)[0] for i in items])) if items else np.zeros(0, np.uint64)
    look = documents.sparkSession.sparkContext.broadcast(T.Lookup(known))
    sketch = Sketch()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ts in T.blocks(b.column(0)):
                w = T.words(ts)
                has = np.flatnonzero(np.diff(w.first) > 0)
                if not len(has):
                    continue
                q, k = look.value.find(T.ngrams(w.h, n))
                d = np.searchsorted(w.first, q, "right") - 1
                same = np.searchsorted(w.first, q + n - 1, "right") - 1 == d
                q, k, d = q[same], k[same], d[same]
                edge = np.bincount(q, minlength=len(w.h) + 1) - np.bincount(q + n, minlength=len(w.h) + 1)
                key, bands = sketch.of(w, np.cumsum(edge)[: len(w.h)] > 0)
                pair = np.unique(d.astype(np.int64) * len(known) + k)
                ends = np.searchsorted(pair, (has + 1) * len(known))
                ks = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(pair % max(1, len(known)), pa.int32()))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), wide, ks], names=["d", "b", "k"])

    got = stored(documents.select(text).mapInArrow(seen, "d bigint, b array<bigint>, k array<int>"))
    band = got.select("d", F.explode("b").alias("b")).distinct()
    first = band.groupBy("b").agg(F.min("d").alias("f"))
    group = band.join(first, "b").groupBy("d").agg(F.min("f").alias("f"))
    hits = got.where(F.size("k") > 0).select("d", F.explode("k").alias("k")).distinct().join(group, "d").groupBy("k").agg(F.countDistinct("f").alias("n"))
    n_docs = group.agg(F.countDistinct("f")).first()[0]
    return known[[r["k"] for r in hits.where(F.col("n") >= max(least, share * n_docs)).collect()]]


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    share: float = FORMULA_SHARE, least: int = FORMULA_LEAST, block_words: int = BLOCK_WORDS, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """doc, item, words (own words in sequence), first_word, last_word (in the item, the last one exclusive): the longest stretch of each leak.

    Null and empty texts leak nothing; items of fewer than LEAST own words can't leak.  Repeated
    documents each give their rows; extra columns are ignored.  No documents, or no items: no rows.  Items of more than
    ``item_words`` words in all are no bounded query set: ValueError.
    """
    spark = documents.sparkSession
    cgk = Cgk()
    held: list[Items] = []
    ids, texts, size, total = [], [], 0, 0

    def flush() -> None:
        nonlocal ids, texts, size
        if ids:
            held.append(Items(ids, texts, cgk))
        ids, texts, size = [], [], 0

    # the items are a held-out test set: they are read block by block
    for r in items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 5
        total += len(r["t"]) // 5
        if total > item_words:
            raise ValueError(f"more than {item_words} words of items: give them in parts")
        if size > block_words:
            flush()
    flush()
    src = spread(documents.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).where(F.length("_t") > 0))
    kinds = (documents.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString())
    schema = f"`{doc}` {kinds[0]}, `{item}` {kinds[1]}, words bigint, first_word bigint, last_word bigint"
    out = None
    for it in held:
        it.mark(formulas(src, [it], "_d", "_t", share, least))
        it.index()
        part = src.mapInArrow(_search(spark.sparkContext.broadcast(it)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def search(it: Items, x: T.Words) -> list[tuple[int, int, tuple[int, int, int]]]:
    """(text, item, alignment) of all leaks in a block of texts."""
    w, c, n = it.cgk.window, it.cgk, np.diff(x.first)
    # windows every STRIDE words, and the last one of each text
    per = np.where(n >= w, (n - w) // STRIDE + 1, 0)
    d = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.r_[x.first[:-1][d] + k * STRIDE, (x.first[1:] - w)[n >= w]]
    rows = np.int64(max(1, len(it.start)))
    pairs = [np.zeros(0, np.int64)]
    for lo in range(0, len(start), PIECE):
        s = start[lo : lo + PIECE]
        for table, keys in zip(it.tables, c.keys(x.h, s)):
            q, m = table.find(keys)
            pairs.append(s[q] * rows + m)
    pair = distinct(np.concatenate(pairs))
    s, i = pair // rows, it.start[pair % rows] if len(it.start) else pair
    gram = T.ngrams(x.h, SEED)
    left = np.repeat(x.first[1:], n) - np.arange(len(x.h))  # words from here to the end of the text
    q, m = it.seeds.find(gram)
    inside = left[q] >= SEED
    q, m = q[inside], it.seed_at[m[inside]]
    # of seeds that go on from one another the first is enough
    on = np.flatnonzero((q > 0) & it.seeded[m - 1])  # place -1 is none
    on = on[(left[q[on] - 1] >= SEED) & (gram[q[on] - 1] == it.gram[m[on] - 1])]
    first = np.ones(len(q), bool)
    first[on] = False
    q, m = q[first], m[first]
    if not len(s) and not len(q):
        return []
    return list(verified(it, x, *promising(it, x, *starts(it, x, s, i, q, m))))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = shared.value
        for b in batches:
            docs, rows = b.column(0), []
            for at, ts in T.blocks(b.column(1)):
                rows += [(at + a, o, v) for a, o, v in search(it, T.words(ts))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array([r[0] for r in rows])), pa.array([it.ids[r[1]] for r in rows])] + [pa.array([r[2][k] for r in rows], pa.int64()) for k in range(3)],
                    names=["d", "i", "words", "first_word", "last_word"],
                )

    return run
