"""Decoders of sample encodings (D1-D6, D9, D10): pure functions on bytes and arrays."""

from __future__ import annotations

import numpy as np


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    half = 1 << (bits - 1)
    v = v.astype(np.int64) & ((1 << bits) - 1)
    return np.where(v >= half, v - (1 << bits), v)


#: Fixed values: (control code, upper two bits or None) -> (number of differences, bits each), Steim-1 and Steim-2.
STEIM1 = {(1, None): (4, 8), (2, None): (2, 16), (3, None): (1, 32)}
STEIM2 = {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}


def steim(data: bytes, n: int, version: int, order: str = ">") -> tuple[np.ndarray, bool]:
    """(n samples, integrity) of 64-byte Steim frames; integrity: the last sample equals the one stated."""
    words = np.frombuffer(data[: len(data) // 64 * 64], order + "u4").astype(np.int64).reshape(-1, 16)
    if not n or not len(words):
        return np.zeros(0, np.int64), n == 0
    first, last = (int(_signed(words[0, k], 32)) for k in (1, 2))
    codes = (words[:, :1] >> (2 * (15 - np.arange(16)))) & 3
    codes[:, 0] = 0
    codes[0, 1:3] = 0
    w, c = words.ravel(), codes.ravel()
    table = STEIM1 if version == 1 else STEIM2
    count = np.zeros(len(w), np.int64)
    groups = []
    for (code, top), (k, bits) in table.items():
        m = c == code
        if top is not None:
            m &= (w >> 30) == top
        at = np.flatnonzero(m)
        if len(at):
            sh = bits * np.arange(k - 1, -1, -1)
            groups.append((at, _signed(w[at, None] >> sh, bits)))
            count[at] = k
    start = np.cumsum(count) - count
    d = np.zeros(int(count.sum()), np.int64)
    for at, v in groups:
        d[start[at][:, None] + np.arange(v.shape[1])] = v
    if len(d) < n:
        return np.cumsum(np.r_[first, d[1:]])[:n] if len(d) else np.zeros(0, np.int64), False
    x = np.cumsum(np.r_[first, d[1:n]])
    return x, int(x[-1]) == last


def steim_encode(x: np.ndarray, version: int = 1, before: int = 0) -> bytes:
    """Steim frames of integers, the narrowest packing that fits each next differences; inverse of ``steim``."""
    x = np.asarray(x, np.int64)
    d = np.diff(np.r_[before, x])
    table = sorted((STEIM1 if version == 1 else STEIM2).items(), key=lambda kv: -kv[1][0])
    words: list[tuple[int, int]] = []
    at = 0
    while at < len(d):
        for (code, top), (k, bits) in table:
            v = d[at : at + k]
            if len(v) == k and (np.abs(v + 0.5) < 1 << (bits - 1)).all() or (k == 1):
                if k == 1 and not -(1 << (bits - 1)) <= v[0] < 1 << (bits - 1):
                    raise ValueError("a difference doesn't fit")
                word = 0
                for q in v:
                    word = (word << bits) | (int(q) & ((1 << bits) - 1))
                words.append((code, word | ((top or 0) << 30)))
                at += k
                break
    out, k = [], 0
    while k < len(words) or not out:
        lead = [] if out else [(0, int(x[0]) & 0xFFFFFFFF), (0, int(x[-1]) & 0xFFFFFFFF)]
        part = lead + words[k : k + 15 - len(lead)]
        k += 15 - len(lead)
        part += [(0, 0)] * (15 - len(part))
        ctrl = 0
        for j, (c, _) in enumerate(part):
            ctrl |= c << (2 * (14 - j))
        out.append(np.array([ctrl] + [w for _, w in part], ">u4").tobytes())
    return b"".join(out)


def geoscope(data: bytes, n: int, exponent_bits: int, order: str = ">") -> np.ndarray:
    """16-bit gain-ranged samples: (mantissa - 2048) / 2 ** exponent (D3)."""
    v = np.frombuffer(data, order + "u2", n).astype(np.int64)
    return ((v & 0xFFF) - 2048) / 2.0 ** ((v >> 12) & ((1 << exponent_bits) - 1))


def cdsn(data: bytes, n: int, order: str = ">") -> np.ndarray:
    """16-bit gain-ranged samples of 14-bit mantissas; ranges multiply by 1, 4, 16 and 128."""
    v = np.frombuffer(data, order + "u2", n).astype(np.int64)
    return ((v & 0x3FFF) - 8191) * np.array([1, 4, 16, 128])[v >> 14]


def sro(data: bytes, n: int, order: str = ">") -> np.ndarray:
    """16-bit gain-ranged samples: 12-bit mantissa times 2 ** (10 - range)."""
    v = np.frombuffer(data, order + "u2", n).astype(np.int64)
    return _signed(v & 0xFFF, 12) * 2.0 ** (10 - (v >> 12))


def ibm_float(b: np.ndarray) -> np.ndarray:
    """Hexadecimal floating point words to doubles."""
    v = np.asarray(b, np.uint32).astype(np.int64)
    s = np.where(v >> 31, -1.0, 1.0)
    return s * (v & 0xFFFFFF) / 16777216.0 * 16.0 ** (((v >> 24) & 0x7F) - 64)


def to_ibm(x: np.ndarray) -> np.ndarray:
    """Doubles to hexadecimal floating point words."""
    x = np.asarray(x, float)
    with np.errstate(divide="ignore"):
        e = np.where(x == 0, 0, np.ceil(np.log2(np.abs(x)) / 4 + 1e-12)).astype(np.int64)
    m = np.rint(np.abs(x) / 16.0**e * 16777216.0).astype(np.int64)
    over = m >= 16777216
    m, e = np.where(over, m // 16, m), e + over
    return np.where(x == 0, 0, ((x < 0).astype(np.int64) << 31) | ((e + 64) << 24) | m).astype(np.uint32)


def packed_differences(data: bytes, n: int, width: float) -> np.ndarray:
    """n big-endian differences of 0.5, 1, 2, 3 or 4 bytes."""
    if width == 0.5:
        b = np.frombuffer(data, np.uint8, (n + 1) // 2)
        return _signed(np.stack([b >> 4, b & 15], 1).ravel()[:n], 4)
    w = int(width)
    b = np.frombuffer(data, np.uint8, n * w).reshape(n, w).astype(np.int64)
    return _signed((b << (8 * np.arange(w - 1, -1, -1))).sum(1), 8 * w)


def decode(data: bytes, n: int, encoding: int, order: str = ">") -> tuple[np.ndarray, bool]:
    """(samples, integrity) of a record's data by its encoding code."""
    plain = {1: "i2", 3: "i4", 4: "f4", 5: "f8", 32: "i2"}
    if encoding in plain:
        return np.frombuffer(data, order + plain[encoding], n).astype(float), True
    if encoding in (10, 11):
        x, ok = steim(data, n, encoding - 9, order)
        return x.astype(float), ok
    if encoding in (13, 14):
        return geoscope(data, n, 3 if encoding == 13 else 4, order), True
    if encoding == 16:
        return cdsn(data, n, order).astype(float), True
    if encoding == 30:
        return sro(data, n, order), True
    if encoding == 0:
        return np.zeros(0), True
    raise ValueError(f"encoding {encoding} isn't supported")
