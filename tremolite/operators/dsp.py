"""Whole-segment signal processing (V2 n > 1, V6-V9, V14-V15, A4, A14): numpy kernels, one row per segment.

A row of a traces table is one contiguous segment, so every operator is a map without a shuffle.
Filters are applied as second-order sections; a long segment is filtered in blocks whose states
are chained, so the number of interpreted steps is the square root of its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tremolite.model import KW

# --- analogue prototypes: zeros, poles, gain at unit cut-off


def _butter(n: int):
    k = np.arange(1, n + 1)
    return np.zeros(0, complex), np.exp(1j * np.pi * (2 * k + n - 1) / (2 * n)), 1.0


def _cheby1(n: int, rp: float):
    eps = math.sqrt(10 ** (rp / 10) - 1)
    mu = math.asinh(1 / eps) / n
    th = np.pi * (2 * np.arange(1, n + 1) - 1) / (2 * n)
    p = -np.sinh(mu) * np.sin(th) + 1j * np.cosh(mu) * np.cos(th)
    k = np.prod(-p).real
    return np.zeros(0, complex), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k


def _cheby2(n: int, rs: float):
    mu = math.asinh(math.sqrt(10 ** (rs / 10) - 1)) / n
    th = np.pi * (2 * np.arange(1, n + 1) - 1) / (2 * n)
    z = np.array([1j / math.cos(t) for t in th if abs(math.cos(t)) > 1e-12])
    p = 1 / (-np.sinh(mu) * np.sin(th) + 1j * np.cosh(mu) * np.cos(th))
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _landen(k: float) -> list[float]:
    v = []
    while k > 1e-15 and len(v) < 12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        v.append(k)
    return v


def _cde(u, k: float):
    w = np.cos(np.asarray(u, complex) * np.pi / 2)
    for q in _landen(k)[::-1]:
        w = (1 + q) * w / (1 + q * w * w)
    return w


def _sne(u, k: float):
    w = np.sin(np.asarray(u, complex) * np.pi / 2)
    for q in _landen(k)[::-1]:
        w = (1 + q) * w / (1 + q * w * w)
    return w


def _asne(w: complex, k: float) -> complex:
    w = complex(w)
    last = k
    for q in _landen(k):
        w = 2 * w / ((1 + q) * (1 + np.sqrt(1 - (last * w) ** 2 + 0j)))
        last = q
    return 2 / np.pi * np.arcsin(w + 0j)


def _ellip(n: int, rp: float, rs: float):
    ep, es = math.sqrt(10 ** (rp / 10) - 1), math.sqrt(10 ** (rs / 10) - 1)
    k1 = ep / es
    half = n // 2
    ui = (2 * np.arange(1, half + 1) - 1) / n
    k1c = math.sqrt(1 - k1 * k1)
    kc = k1c**n * float(np.prod(_sne(ui, k1c).real)) ** 4  # degree equation
    k = math.sqrt(1 - kc * kc)
    za = 1j / (k * _cde(ui, k))
    v0 = -1j * _asne(1j / ep, k1) / n
    pa = 1j * _cde(ui - 1j * v0, k)
    z, p = np.r_[za, za.conj()], np.r_[pa, pa.conj()]
    if n % 2:
        p = np.r_[p, 1j * _sne(1j * v0, k)]
    g = (np.prod(-p) / np.prod(-z)).real
    return z, p, g / math.sqrt(1 + ep * ep) if n % 2 == 0 else g


FAMILIES = ("Butterworth", "Chebyshev1", "Chebyshev2", "Elliptic")
RESPONSES = ("Bandpass", "Bandstop", "Lowpass", "Highpass")


def design(fs: float, fl: float = KW.fl, fh: float = KW.fh, n: int = KW.np, rp: float = KW.rp, rs: float = KW.rs, response: str = KW.rt, family: str = KW.dm) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital filter; low-pass uses fh, high-pass fl."""
    proto = {"Butterworth": lambda: _butter(n), "Chebyshev1": lambda: _cheby1(n, rp), "Chebyshev2": lambda: _cheby2(n, rs), "Elliptic": lambda: _ellip(n, rp, rs)}
    if family not in proto or response not in RESPONSES:
        raise ValueError(f"families are {FAMILIES}, responses {RESPONSES}")
    edges = {"Lowpass": (fh,), "Highpass": (fl,)}.get(response, (fl, fh))
    if not all(0 < f < fs / 2 for f in edges) or edges != tuple(sorted(edges)):
        raise ValueError(f"corners {edges} don't fit a rate of {fs}")
    z, p, k = proto[family]()
    w = [2 * fs * math.tan(math.pi * f / fs) for f in edges]
    d = len(p) - len(z)
    if response == "Lowpass":
        z, p, k = z * w[0], p * w[0], k * w[0] ** d
    elif response == "Highpass":
        k *= (np.prod(-z) / np.prod(-p)).real
        z, p = np.r_[w[0] / z, np.zeros(d)], w[0] / p
    else:
        bw, w0 = w[1] - w[0], math.sqrt(w[0] * w[1])
        split = lambda r: np.r_[r + np.sqrt(r * r - w0 * w0 + 0j), r - np.sqrt(r * r - w0 * w0 + 0j)]
        if response == "Bandpass":
            z, p, k = np.r_[split(z * bw / 2), np.zeros(d)], split(p * bw / 2), k * bw**d
        else:
            k *= (np.prod(-z) / np.prod(-p)).real
            z, p = np.r_[split(bw / 2 / z), np.full(d, 1j * w0), np.full(d, -1j * w0)], split(bw / 2 / p)
    d = len(p) - len(z)
    t = 2 * fs  # bilinear
    k *= (np.prod(t - z) / np.prod(t - p)).real
    z, p = np.r_[(t + z) / (t - z), -np.ones(d)], (t + p) / (t - p)
    return _sections(z, p, k)


def _pairs(r: np.ndarray) -> list[np.ndarray]:
    """Conjugate pairs, real ones two by two, the ones nearest the unit circle last."""
    up = sorted(r[r.imag > 1e-9 * np.maximum(1, abs(r))], key=lambda v: abs(v))
    re = sorted(r[np.abs(r.imag) <= 1e-9 * np.maximum(1, abs(r))].real)
    out = [np.array([v, v.conjugate()]) for v in up]
    while re:
        out.append(np.array([re.pop(0)] + ([re.pop(-1)] if re else []), complex))
    return out


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    zs, ps = _pairs(z), sorted(_pairs(p), key=lambda v: -abs(v[0]))
    sos = []
    for q in ps:
        c = min(range(len(zs)), key=lambda j: (len(zs[j]) != len(q), abs(zs[j][0] - q[0]))) if zs else None
        num = np.poly(zs.pop(c)).real if c is not None else np.ones(1)
        den = np.poly(q).real
        sos.append(np.r_[num, np.zeros(3 - len(num)), den, np.zeros(3 - len(den))])
    sos = np.array(sos[::-1])
    sos[0, :3] *= k
    return sos


def frequency_response(sos: np.ndarray, f: np.ndarray, fs: float) -> np.ndarray:
    """Complex response at frequencies f."""
    q = np.exp(-2j * np.pi * np.asarray(f) / fs)
    h = np.ones(len(q), complex)
    for s in sos:
        h *= (s[0] + s[1] * q + s[2] * q * q) / (s[3] + s[4] * q + s[5] * q * q)
    return h


def _biquad(s: np.ndarray, x: np.ndarray, z0: np.ndarray) -> np.ndarray:
    """One section over x from the state z0, in blocks whose states are chained."""
    n = len(x)
    size = max(1, int(math.sqrt(n)))
    k = -(-n // size)
    flat = np.zeros(size * k)
    flat[:n] = x
    xb = np.ascontiguousarray(flat.reshape(k, size).T)
    b0, b1, b2, _, a1, a2 = s
    y = np.empty_like(xb)
    s1, s2 = np.zeros(k), np.zeros(k)
    for t in range(size):
        v = xb[t]
        w = b0 * v + s1
        s1 = b1 * v - a1 * w + s2
        s2 = b2 * v - a2 * w
        y[t] = w
    m = np.array([[-a1, 1.0], [-a2, 0.0]])
    ml = np.linalg.matrix_power(m, size)
    states = np.empty((k, 2))
    z = np.array(z0, float)
    for j in range(k):
        states[j] = z
        z = ml @ z + (s1[j], s2[j])
    free, row = np.empty((size, 2)), np.array([1.0, 0.0])
    for t in range(size):
        free[t] = row
        row = row @ m
    y += free @ states.T
    return y.T.ravel()[:n]


def _steady(s: np.ndarray) -> np.ndarray:
    """State of a section that a constant input of 1 has led to."""
    b0, b1, b2, _, a1, a2 = s
    a = np.array([[1 + a1, -1.0], [a2, 1.0]])
    return np.linalg.solve(a, np.array([b1 - a1 * b0, b2 - a2 * b0]))


def filtfilt(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """V6: zero-phase filter of one segment; ends are reflected oddly, NaNs make the whole segment NaN.

    A segment shorter than six pads is extended with zeros.
    """
    x = np.asarray(x, float)
    n = len(x)
    if not n:
        return x
    pad = 3 * (2 * len(sos))
    if n < 6 * pad:
        x = np.r_[x, np.zeros(6 * pad - n)]
    e = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for _ in range(2):
        g = e[0]
        for s in sos:
            dc = s[:3].sum() / s[3:].sum()
            e = _biquad(s, e, _steady(s) * g)
            g *= dc
        e = e[::-1]
    return e[pad : pad + n]


def filtfilt_many(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """``filtfilt`` of the rows of a matrix in lockstep."""
    m, n = x.shape
    pad = 3 * (2 * len(sos))
    v = np.asarray(x, float).T
    if n < 6 * pad:
        v = np.r_[v, np.zeros((6 * pad - n, m))]
    e = np.r_[2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]
    for _ in range(2):
        g = e[0].copy()
        for s in sos:
            b0, b1, b2, _, a1, a2 = s
            z = _steady(s)
            s1, s2 = z[0] * g, z[1] * g
            y = np.empty_like(e)
            for t in range(len(e)):
                w = b0 * e[t] + s1
                s1 = b1 * e[t] - a1 * w + s2
                s2 = b2 * e[t] - a2 * w
                y[t] = w
            e = y
            g = g * (s[:3].sum() / s[3:].sum())
        e = e[::-1]
    return e[pad : pad + n].T


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by FFT: positive frequencies doubled, negative ones dropped."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(x: np.ndarray) -> np.ndarray:
    """V7: modulus of the analytic signal, whatever the segment's length."""
    return np.abs(analytic(np.asarray(x, float))) if len(x) else np.asarray(x, float)


def resample(x: np.ndarray, fs: float, f0: float, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """V8/V9: polyphase resampling with a Kaiser-windowed sinc; n_out = floor(n f0 / fs), at least 1."""
    x = np.asarray(x, float)
    r = Fraction(f0 / fs).limit_denominator(10_000)
    up, down = r.numerator, r.denominator
    n = max(1, math.floor(len(x) * f0 / fs)) if len(x) else 0
    if up == down or not n:
        return x[:n].copy()
    m = max(up, down)
    k = np.arange(-half * m, half * m + 1)
    taps = np.sinc(k / m) * np.kaiser(len(k), beta)
    taps *= up / taps.sum()
    # output j is at j * down on the up-sampled axis; only every up-th sample there is an input
    j = np.arange(n) * down
    lo = -(-(j - half * m) // up)
    width = (2 * half * m) // up + 1
    idx = lo[:, None] + np.arange(width)
    tap = j[:, None] - idx * up + half * m
    ok = (tap >= 0) & (tap < len(taps)) & (idx >= 0) & (idx < len(x))
    return np.where(ok, taps[np.clip(tap, 0, len(taps) - 1)] * x[np.clip(idx, 0, len(x) - 1)], 0.0).sum(1)


def transfer(a0: float, z: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Poles-and-zeros response at angular frequencies w."""
    s = 1j * w
    return a0 * np.prod([s - v for v in z] or [np.ones_like(s)], axis=0) / np.prod([s - v for v in p] or [np.ones_like(s)], axis=0)


def response_max(a0: float, z: np.ndarray, p: np.ndarray, fs: float, n: int = 1024) -> float:
    """Largest modulus of a response up to the Nyquist frequency, at n frequencies."""
    return float(np.abs(transfer(a0, z, p, np.linspace(0, np.pi * fs, n))).max())


#: The flat (all-pass) response: constant 1.
FLAT = (1.0, np.zeros(0, complex), np.zeros(0, complex))


def translate(x: np.ndarray, fs: float, old: tuple, new: tuple = FLAT, water: float = float(np.finfo(np.float32).eps)) -> np.ndarray:
    """From one response (a0, zeros, poles) to another; a water level keeps small values from blowing up."""
    x = np.asarray(x, float)
    n = len(x)
    if not n:
        return x
    m = 1 << (n - 1).bit_length()
    w = 2 * np.pi * np.fft.rfftfreq(m, 1 / fs)
    ro, rn = transfer(*old, w), transfer(*new, w)
    level = np.abs(ro).max() ** 2 * water
    g = rn * ro.conj() / np.maximum(np.abs(ro) ** 2 + level, np.finfo(float).tiny)
    return np.fft.irfft(np.fft.rfft(x, m) * g, m)[:n]


def detrend_poly(x: np.ndarray, n: int = 1, t: np.ndarray | None = None) -> np.ndarray:
    """V2: least-squares polynomial of order n taken off; NaNs are ignored and stay."""
    x = np.asarray(x, float)
    t = np.arange(len(x), dtype=float) if t is None else np.asarray(t, float)
    ok = ~np.isnan(x)
    if not ok.any():
        return x
    s = np.ptp(t[ok]) or 1.0
    u = (t - t[ok].mean()) / s
    return x - np.polyval(np.polyfit(u[ok], x[ok], min(n, int(ok.sum()) - 1)), u)


def polyfit(t: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """A4: descending coefficients of the least-squares polynomial."""
    return np.linalg.lstsq(np.vander(np.asarray(t, float), n + 1), np.asarray(x, float), rcond=None)[0]


def apply_segments(traces: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], x: str = "x") -> DataFrame:
    """fn(samples, the row's other columns by name) of every segment; null segments stay null.  The extension point for own kernels; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            others = [c for c in b.columns if c != x]
            rows = zip(*[b[c] for c in others]) if others else iter(lambda: (), None)
            b[x] = [None if v is None else fn(np.asarray(v, float), dict(zip(others, r))) for v, r in zip(b[x], rows)]
            yield b

    return traces.mapInPandas(run, traces.schema)


def filtfilt_traces(traces: DataFrame, **kw) -> DataFrame:
    """V6 on a traces table (columns fs, x); coefficients are designed once per rate and worker.

    Segments of a batch that are alike in rate and length go in lockstep where they are many.
    """
    made: dict[float, np.ndarray] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs: list = list(b["x"])
            groups: dict[tuple[float, int], list[int]] = {}
            for k, (fs, v) in enumerate(zip(b["fs"], xs)):
                if v is not None and len(v):
                    groups.setdefault((float(fs), len(v)), []).append(k)
            for (fs, n), at in groups.items():
                if fs not in made:
                    made[fs] = design(fs, **kw)
                if len(at) * len(at) > n:
                    for k, y in zip(at, filtfilt_many(np.stack([np.asarray(xs[k], float) for k in at]), made[fs])):
                        xs[k] = y
                else:
                    for k in at:
                        xs[k] = filtfilt(xs[k], made[fs])
            b["x"] = xs
            yield b

    return traces.mapInPandas(run, traces.schema)


def envelope_traces(traces: DataFrame) -> DataFrame:
    """V7 on a traces table."""
    return apply_segments(traces, lambda x, _: envelope(x))


def resample_traces(traces: DataFrame, f0: float | None = None) -> DataFrame:
    """V8 on a traces table: x and fs change, start times stay.  Without a rate it is the lowest above 0 in the table (one small job)."""
    from pyspark.sql import functions as F

    if f0 is None:
        f0 = traces.where("fs > 0").agg(F.min("fs")).first()[0]
        if f0 is None:
            return traces
    return apply_segments(traces, lambda x, r: resample(x, float(r["fs"]), f0)).withColumn("fs", F.lit(float(f0)))


def _complex(v) -> np.ndarray:
    return np.array([complex(q["re"], q["im"]) for q in v]) if v is not None and len(v) else np.zeros(0, complex)


def translate_traces(traces: DataFrame, new: tuple = FLAT) -> DataFrame:
    """V14 on a traces table with a ``resp`` struct (a0, p, z); V15 (remove_resp) is the default.

    Where the table has ``units`` and they are m/s2, poles beyond twice the rate of sampling (in rad/s over pi) are left out and two zeros added.
    """
    def one(x: np.ndarray, r: dict) -> np.ndarray:
        z, p, fs = _complex(r["resp"]["z"]), _complex(r["resp"]["p"]), float(r["fs"])
        if r.get("units") == "m/s2":
            z, p = np.r_[z, 0, 0], p[np.abs(p) / np.pi <= fs]
        return translate(x, fs, (float(r["resp"]["a0"]), z, p), new)

    return apply_segments(traces, one)
