"""Words of many texts at once as numpy arrays: normalisation, word hashes, n-gram hashes.

Whole texts are processed; batches are cut by size only to keep temporaries small.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK = 1 << 20
#: Characters that leave no trace between two letters.
INVISIBLE = "­​‌‍‎‏⁠﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_BROKEN = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=\w)")
_POW = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x9E3779B97F4A7C15 | 1, np.uint64)])
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: What a byte adds to its word's hash: by its place in the word (less multiples of 64) and its value.
_MIX = (_POW[:, None] * _BYTE[None, :]).ravel()
_BIT = np.uint64(1) << (np.arange(256, dtype=np.uint64) & np.uint64(63))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def plain(text: str | None) -> str:
    """Compatibility forms, invisible characters gone, words broken at line ends joined; capitals stay."""
    if not text:
        return ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if any(c in text for c in INVISIBLE):
            text = _INVISIBLE.sub("", text)
    if "-\n" in text or "‐\n" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    return text


def normal(text: str | None) -> str:
    """The plain form in lower case."""
    return plain(text).lower()


@dataclass
class Words:
    """Words of a block of texts: hash, byte range in buf, and for each text its range of words."""

    h: np.ndarray
    a: np.ndarray
    z: np.ndarray
    buf: bytes
    first: np.ndarray  # of len(texts) + 1
    bag: np.ndarray  # bits of the letters that occur in the word

    def word(self, k: int) -> str:
        return self.buf[self.a[k] : self.z[k]].decode("utf-8", "replace")


def words(texts: list[str | None]) -> Words:
    """Words of texts; anything but letters and digits separates.  A null text has no words."""
    return words_of([normal(t) for t in texts])


def _edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it; whether each byte is of a word."""
    ok = _LETTER[b]
    for lead, n in ((0xE2, 3), (0xC2, 2)):  # general punctuation and Latin-1 signs separate
        k = np.flatnonzero(b == lead)
        for j in range(n):
            ok[np.minimum(k + j, len(b) - 1)] = False
    edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
    if ok[0]:
        edge = np.r_[0, edge]
    return edge[::2], edge[1::2], ok


#: Letters whose lower case has another length in UTF-8.
_UNEVEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(128, 0xD800) if len(chr(c).encode()) != len(chr(c).lower().encode())) + "]")
#: Whether a code point of the first plane is a capital, in any script.
_UPPER = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0xD800)])


def capitals(plains: list[str], x: Words) -> np.ndarray:
    """Whether each word of ``words_of(lower case of plains)`` begins with a capital there, whatever the script.

    Of the few letters whose lower case is of another length in UTF-8 nothing is known: they count as small.
    """
    parts = [(p if p.isascii() else _UNEVEN.sub(lambda m: m[0].lower(), p)).encode("utf-8", "replace") for p in plains]
    b = np.frombuffer(b"\n".join(parts) + b"\n\0\0", np.uint8)
    c = b[x.a].astype(np.int64)
    two, three = (c >= 0xC2) & (c < 0xE0), (c >= 0xE0) & (c < 0xF0)
    c[two] = ((c[two] & 31) << 6) | (b[x.a[two] + 1] & 63)
    c[three] = ((c[three] & 15) << 12) | ((b[x.a[three] + 1].astype(np.int64) & 63) << 6) | (b[x.a[three] + 2] & 63)
    return _UPPER[np.where(c < len(_UPPER), c, 0)]


def words_of(normals: list[str]) -> Words:
    """Words of texts in normal form."""
    parts = [p.encode("utf-8", "replace") for p in normals]
    buf = b"\n".join(parts) + b"\n"
    b = np.frombuffer(buf, np.uint8)
    a, z, ok = _edges(b)
    ends = np.cumsum([len(p) + 1 for p in parts])
    first = np.r_[0, np.searchsorted(a, ends)]
    if not len(a):
        return Words(np.zeros(0, np.uint64), a, a, buf, first, np.zeros(0, np.uint64))
    n, b = z - a, b[ok]
    at = np.r_[0, np.cumsum(n)[:-1]]
    within = np.arange(len(b)).astype(np.uint8) - np.repeat(at.astype(np.uint8), n)  # modulo 256
    h = np.add.reduceat(_MIX[(within & np.uint8(63)).astype(np.int64) << 8 | b], at)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bag = np.bitwise_or.reduceat(_BIT[b], at)
    return Words(h, a, z, buf, first, bag)


def blocks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in pieces of about ``size`` bytes; a longer text is a piece of its own."""
    texts = col.to_pylist()
    at, n = 0, 0
    for k, t in enumerate(texts):
        m = len(t) if t else 0
        if n and n + m > size:
            yield at, texts[at:k]
            at, n = k, 0
        n += m
    if at < len(texts):
        yield at, texts[at:]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    p = np.uint64(0xD6E8FEB86659FD93)
    for j in range(n):
        out *= p
        out += h[j : j + len(out)]
    out ^= out >> np.uint64(31)
    return out


class Lookup:
    """Sorted keys with a bitmap before them, so that most misses cost one memory access."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        order = np.argsort(keys, kind="stable")
        self.__setstate__((order, keys[order], bits))

    def __getstate__(self) -> tuple:
        return self.order, self.keys, self.bits  # the bitmap is made again where the table arrives

    def __setstate__(self, state: tuple) -> None:
        self.order, self.keys, self.bits = state
        at = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]]) if len(self.keys) else np.zeros(0, np.int64)
        self.each, self.at, self.count = self.keys[at], at, np.diff(np.r_[at, len(self.keys)])
        self.shift = np.uint64(64 - self.bits)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.keys)] = True

    def _slot(self, k: np.ndarray) -> np.ndarray:
        k = k * np.uint64(0x9E3779B97F4A7C15)
        k >>= self.shift
        return k.view(np.int64)

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, number of the key) of all equal pairs."""
        c = np.flatnonzero(self.seen[self._slot(q)])
        if not len(c):
            return c, c
        k = np.searchsorted(self.each, q[c])
        k[k == len(self.each)] = 0
        same = self.each[k] == q[c]
        c, a, n = c[same], self.at[k[same]], self.count[k[same]]
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else a
        return np.repeat(c, n), self.order[at] if len(n) else at
