"""Readers and writers of waveform files: bytes -> list of pieces, pieces -> bytes.

A piece is a dict with the keys of PIECE; times are microseconds since the epoch.  Readers are
pure functions that the data source runs on executors, one call per file or byte range.
"""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta, timezone

import numpy as np

from tremolite.sources import codecs

#: Columns of a piece, in order.
PIECE = "id string, name string, fs double, gain double, units string, lat double, lon double, el double, az double, inc double, t0_us bigint, n bigint, x array<double>, misc map<string,string>"
COLUMNS = [c.split()[0] for c in re.sub(r"map<string,string>", "map", PIECE).split(", ")]
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def piece(**kw) -> dict:
    """A piece with defaults for what isn't given."""
    p = dict.fromkeys(COLUMNS) | {"gain": 1.0, "misc": {}} | kw
    p["x"] = np.asarray(p["x"] if p["x"] is not None else [], float)
    p["n"] = len(p["x"]) if p["n"] is None else p["n"]
    return p


def doy_us(y: int, j: int, h: int = 0, m: int = 0, s: int = 0, us: int = 0) -> int:
    """Microseconds of a year, day of year and time of day."""
    return (datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH) // timedelta(microseconds=1) + ((j - 1) * 86400 + h * 3600 + m * 60 + s) * 1_000_000 + us


def iso_us(s: str) -> int:
    """Microseconds of an ISO time; a missing zone is UTC, more than six digits are cut."""
    s = re.sub(r"(\.\d{6})\d+", r"\1", s.strip().rstrip("Z"))
    d = datetime.fromisoformat(s)
    return ((d.replace(tzinfo=timezone.utc) if d.tzinfo is None else d) - _EPOCH) // timedelta(microseconds=1)


def _when(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=int(us))


def _s(b: bytes) -> str:
    return b.split(b"\0")[0].decode("latin-1").strip()


# --- mini-SEED


def mseed_rate(a: int, b: int) -> float:
    """Sampling rate of rate factor and multiplier."""
    a, b = int(a), int(b)
    if not a or not b:
        return 0.0
    return float((a if a > 0 else -1 / a) * (b if b > 0 else -1 / b))


def mseed_length(data: bytes, at: int) -> int:
    """Length of the mini-SEED record whose header stands at ``at``; 0 if there is none.

    A header has a sequence number, a quality letter, a possible time in either byte order and blockettes within the record.
    """
    if at + 48 > len(data) or data[at + 6] not in b"DRQM" or data[at + 7] not in b" \0" or any(c not in b"0123456789 \0" for c in data[at : at + 6]):
        return 0
    for order in ">", "<":
        y, j, h, m, s = struct.unpack_from(order + "HHBBB", data, at + 20)
        if not (1900 <= y <= 2100 and 1 <= j <= 366 and h < 24 and m < 60 and s <= 60):
            continue
        nb, (begin, blk) = data[at + 39], struct.unpack_from(order + "HH", data, at + 44)
        for _ in range(nb):
            if not blk or at + blk + 8 > len(data):
                break
            kind, nxt = struct.unpack_from(order + "HH", data, at + blk)
            if kind == 1000:
                return 1 << data[at + blk + 6] if 6 <= data[at + blk + 6] <= 28 else 0
            if nxt and nxt <= blk:
                return 0
            blk = nxt
        return 4096 if begin <= 4096 else 0
    return 0


def mseed_sync(data: bytes, at: int) -> int:
    """The first place from ``at`` on, in steps of 64 bytes, where a record begins; len(data) if there is none.

    A header counts if the records after it follow on one another as far as the data goes, at most three of them.
    """
    while at + 48 <= len(data):
        n = mseed_length(data, at)
        if n:
            nxt, ok = at + n, True
            for _ in range(3):
                if nxt + 48 > len(data):
                    break
                more = mseed_length(data, nxt)
                if not more:
                    ok = False
                    break
                nxt += more
            if ok:
                return at
        at += 64
    return len(data)


def mseed_stop(data: bytes, at: int, end: int) -> int:
    """Where the last record that begins before ``end`` ends; beyond len(data) if it isn't all there."""
    while at < end and at < len(data):
        n = mseed_length(data, at)
        at += n or 64
    return at


def mseed_records(data: bytes, headers_only: bool = False) -> list[dict]:
    """One piece per record; byte order is found from the year; blockettes 100 and 1000 are used, others named in misc."""
    out, at = [], 0
    while at + 48 <= len(data):
        if data[at + 6 : at + 7] not in (b"D", b"R", b"Q", b"M"):
            at += 64
            continue
        order = ">" if 1900 <= struct.unpack_from(">H", data, at + 20)[0] <= 2100 else "<"
        sta, loc, cha, net = (_s(data[at + a : at + z]) for a, z in ((8, 13), (13, 15), (15, 18), (18, 20)))
        y, j, h, m, s, _, frac, n, rf, rm = struct.unpack_from(order + "HHBBBBHHhh", data, at + 20)
        act, _, _, nb, corr, begin, blk = struct.unpack_from(order + "BBBBiHH", data, at + 36)
        fs, enc, dorder, length, misc = mseed_rate(rf, rm), 11, ">", 4096, {}
        for _ in range(nb):
            if not blk:
                break
            kind, nxt = struct.unpack_from(order + "HH", data, at + blk)
            if kind == 1000:
                enc, word, size = struct.unpack_from("BBB", data, at + blk + 4)
                dorder, length = ">" if word else "<", 1 << size
            elif kind == 100:
                fs = float(struct.unpack_from(order + "f", data, at + blk + 4)[0])
            else:
                misc[f"blockette_{kind}"] = str(blk)
            blk = nxt
        t0 = doy_us(y, j, h, m, s, frac * 100) + (0 if act & 2 else corr * 100)
        misc["encoding"] = str(enc)
        x = np.zeros(0)
        if enc == 0:  # text, not samples
            misc["text"] = data[at + begin : at + begin + n].decode("latin-1")
            n = 0
        if not headers_only and n:
            x, ok = codecs.decode(data[at + begin : at + length], n, enc, dorder)
            misc["integrity_ok"] = str(ok).lower()
        out.append(piece(id=f"{net}.{sta}.{loc}.{cha}", fs=fs, t0_us=t0, n=n, x=x, misc=misc))
        at += length
    return out


def mseed_write(pieces: list[dict], encoding: int = 10, size: int = 9) -> bytes:
    """Records of 2 ** size bytes; integers for Steim and integer encodings."""
    out, seq = [], 0
    room = (1 << size) - 64
    for p in pieces:
        net, sta, loc, cha = (p["id"].split(".") + [""] * 4)[:4]
        x, k, per = np.asarray(p["x"]), 0, {1: 2, 3: 4, 4: 4, 5: 8, 10: 4, 11: 4}[encoding]
        while k < len(x):
            n = min(len(x) - k, room // per - (2 * (room // 64) + 2 if encoding in (10, 11) else 0))
            if encoding in (10, 11):
                d = codecs.steim_encode(np.rint(x[k : k + n]), encoding - 9)
            else:
                d = x[k : k + n].astype({1: ">i2", 3: ">i4", 4: ">f4", 5: ">f8"}[encoding]).tobytes()
            w = _when(p["t0_us"] + round(k * 1e6 / p["fs"]))
            seq += 1
            fs = p["fs"]
            rf, rm = (round(fs), 1) if fs >= 1 and fs == round(fs) else (round(-1 / fs), 1) if fs < 1 else (round(fs * 100), -100)
            h = f"{seq:06d}D ".encode() + f"{sta:<5.5}{loc:<2.2}{cha:<3.3}{net:<2.2}".encode()
            h += struct.pack(">HHBBBBHHhh", w.year, w.timetuple().tm_yday, w.hour, w.minute, w.second, 0, w.microsecond // 100, n, rf, rm)
            h += struct.pack(">BBBBiHH", 0, 0, 0, 1, 0, 64, 48) + struct.pack(">HHBBBB", 1000, 0, encoding, 1, size, 0)
            out.append((h.ljust(64, b"\0") + d).ljust(1 << size, b"\0")[: 1 << size])
            k += n
    return b"".join(out)


# --- SAC (S2, K3)

_NULL = -12345.0


def sac_read(data: bytes) -> list[dict]:
    """A SAC file of either byte order, header versions 6 and 7."""
    order = "<" if 1 <= struct.unpack_from("<i", data, 304)[0] <= 7 else ">"
    f = np.frombuffer(data, order + "f4", 70).astype(float)
    i = np.frombuffer(data, order + "i4", 40, 280)
    ch = [_s(data[440 + 8 * k : 448 + 8 * k]) for k in range(24)]
    c = lambda k: "" if ch[k].startswith("-12345") else ch[k]
    g = lambda k: None if f[k] == _NULL else float(f[k])
    n, delta, b = int(i[9]), float(f[0]), float(f[5])
    lat, lon = g(31), g(32)
    if i[6] > 6:
        d = np.frombuffer(data, order + "f8", 22, 632 + 4 * n)
        delta, b = float(d[0]), float(d[1])
        lon, lat = (None if v == _NULL else float(v) for v in (d[18], d[19]))
    else:
        delta = round(delta, 7)
    t0 = doy_us(int(i[0]), int(i[1]), int(i[2]), int(i[3]), int(i[4]), int(i[5]) * 1000) + round(b * 1e6)
    net, sta, loc, cha = c(21), c(0), c(3), c(20)
    return [piece(id=f"{net}.{sta}.{loc}.{cha}", fs=1 / delta, gain=1.0 if g(3) is None else g(3), lat=lat, lon=lon, el=g(33), az=g(57), inc=g(58), t0_us=t0, x=np.frombuffer(data, order + "f4", n, 632))]


def sac_write(p: dict, version: int = 7, order: str = "<", event: dict | None = None) -> bytes:
    """One contiguous piece as a SAC file; an event (K4) fills origin, place, depth, magnitude, distance and azimuths."""
    f, i = np.full(70, _NULL), np.full(40, -12345)
    ch = ["-12345"] * 24
    w = _when(p["t0_us"] // 1000 * 1000)
    b = (p["t0_us"] % 1000) / 1e6
    f[0], f[3], f[5], f[6] = 1 / p["fs"], p["gain"] or 1.0, b, b + (len(p["x"]) - 1) / p["fs"]
    for k, v in ((31, "lat"), (32, "lon"), (33, "el"), (57, "az"), (58, "inc")):
        f[k] = _NULL if p.get(v) is None else p[v]
    if event:
        for k, v in ((35, "lat"), (36, "lon"), (38, "dep"), (39, "mag"), (51, "az"), (52, "baz"), (53, "dist")):
            f[k] = _NULL if event.get(v) is None else event[v]
        f[7] = _NULL if event.get("ot_us") is None else (event["ot_us"] - p["t0_us"] // 1000 * 1000) / 1e6
        name = f"{event.get('event_id') or '-12345':<16.16}"
        ch[1], ch[2] = name[:8], name[8:]
    i[:6] = w.year, w.timetuple().tm_yday, w.hour, w.minute, w.second, w.microsecond // 1000
    i[6], i[9], i[15], i[35] = version, len(p["x"]), 1, 1
    net, sta, loc, cha = (p["id"].split(".") + [""] * 4)[:4]
    ch[0], ch[3], ch[20], ch[21] = sta, loc, cha, net
    out = f.astype(order + "f4").tobytes() + i.astype(order + "i4").tobytes() + "".join(f"{c:<8.8}" for c in ch).encode("latin-1")
    out += np.asarray(p["x"]).astype(order + "f4").tobytes()
    if version > 6:
        d = np.full(22, _NULL)
        d[0], d[1], d[2] = 1 / p["fs"], b, f[6]
        d[18], d[19] = f[32] if p.get("lon") is None else p["lon"], f[31] if p.get("lat") is None else p["lat"]
        out += d.astype(order + "f8").tobytes()
    return out


def sac_name(p: dict) -> str:
    """File name of a piece: year, day of year, time, id."""
    w = _when(p["t0_us"])
    return f"{w.year}.{w.timetuple().tm_yday:03d}.{w:%H.%M.%S}.{w.microsecond // 1000:03d}.{p['id']}.R.SAC"


# --- SEG Y (S3, S24) and its single-trace field variant


def segy_read(data: bytes, first: int = 0, last: int | None = None) -> list[dict]:
    """Traces first..last-1 of a SEG Y file; formats 1 (hexadecimal float), 2, 3, 5 and 8."""
    us, ns, fmt = (struct.unpack_from(">H", data, o)[0] for o in (3216, 3220, 3224))
    ext = struct.unpack_from(">h", data, 3504)[0]
    at = 3600 + 3200 * max(0, ext)
    width = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}[fmt]
    out, k = [], 0
    while at + 240 <= len(data) and (last is None or k < last):
        h = struct.unpack_from(">7i4h8i2h4i", data, at)
        n = struct.unpack_from(">H", data, at + 114)[0] or ns
        dt = struct.unpack_from(">H", data, at + 116)[0] or us
        if k >= first:
            y, j, hh, mm, ss = struct.unpack_from(">5h", data, at + 156)
            raw = data[at + 240 : at + 240 + n * width]
            x = codecs.ibm_float(np.frombuffer(raw, ">u4")) if fmt == 1 else np.frombuffer(raw, {2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[fmt])
            sc, zc = h[20] or 1, h[19] or 1
            coord = lambda v, s: v * s if s > 0 else v / -s
            out.append(piece(id=f".{h[1] or h[0]:05d}..", fs=1e6 / dt, t0_us=doy_us(y, max(1, j), hh, mm, ss) if y else 0, x=x, lon=coord(h[23], sc) / 3600, lat=coord(h[24], sc) / 3600, el=coord(h[11], zc), misc={"trace": str(h[0]), "trace_code": str(h[7])}))
        at += 240 + n * width
        k += 1
    return out


def segy_write(pieces: list[dict], fmt: int = 5) -> bytes:
    """A rev-1 file of equal-length traces."""
    n, us = max(len(p["x"]) for p in pieces), round(1e6 / pieces[0]["fs"])
    head = bytearray(3600)
    for o, v in ((3216, us), (3220, n), (3224, fmt), (3500, 256)):
        struct.pack_into(">H", head, o, v)
    out = [bytes(head)]
    for k, p in enumerate(pieces, 1):
        h, w = bytearray(240), _when(p["t0_us"])
        struct.pack_into(">2i", h, 0, k, k)
        struct.pack_into(">h", h, 28, 1)
        struct.pack_into(">i", h, 40, round(p["el"] or 0))
        struct.pack_into(">2h", h, 68, 1, -100)
        struct.pack_into(">2i", h, 80, round((p["lon"] or 0) * 360000), round((p["lat"] or 0) * 360000))
        struct.pack_into(">2H", h, 114, len(p["x"]), us)
        struct.pack_into(">5h", h, 156, w.year, w.timetuple().tm_yday, w.hour, w.minute, w.second)
        x = np.asarray(p["x"])
        out += [bytes(h), codecs.to_ibm(x).astype(">u4").tobytes() if fmt == 1 else x.astype({2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[fmt]).tobytes()]
    return b"".join(out)


def passcal_read(data: bytes) -> list[dict]:
    """A single-trace field file: SEG Y trace header with station, channel and scale fields."""
    n16, us = struct.unpack_from(">hH", data, 114)
    y, j, h, m, s = struct.unpack_from(">5h", data, 156)
    sensor, serial, cha = _s(data[180:186]), _s(data[186:194]), _s(data[194:198])
    ms = struct.unpack_from(">h", data, 206)[0]
    fmt, = struct.unpack_from(">h", data, 204)
    scale, = struct.unpack_from(">f", data, 220)
    n, = struct.unpack_from(">i", data, 228)
    n = n or n16
    x = np.frombuffer(data, ">i4" if fmt == 1 else ">i2", n, 240)
    return [piece(id=f".{sensor}..{cha}", name=serial, fs=1e6 / us, gain=1 / scale if scale else 1.0, t0_us=doy_us(y, j, h, m, s, ms * 1000), x=x)]


# --- AH (S4, S5)


def ah2_read(data: bytes) -> list[dict]:
    """AH-2 records (XDR, big-endian, magic 1100)."""
    out, at = [], 0
    while at + 8 <= len(data):
        magic, length = struct.unpack_from(">2i", data, at)
        if magic != 1100:
            raise ValueError("no AH-2 record")
        at += 8

        def take(f: str):
            nonlocal at
            v = struct.unpack_from(">" + f, data, at)
            at += struct.calcsize(">" + f)
            return v if len(v) > 1 else v[0]

        def text() -> str:
            nonlocal at
            n = take("i")
            s = _s(data[at : at + n])
            at += n + (-n) % 4
            return s

        sta, cha, net, rec, sensor = text(), text(), text(), text(), text()
        az, dip, lat, lon, el, gain, a0 = take("f"), take("f"), take("d"), take("d"), take("f"), take("f"), take("f")
        poles = [take("2f") for _ in range(take("i"))]
        zeros = [take("2f") for _ in range(take("i"))]
        take("ddf")
        take("ihhhhf")
        comment = text()
        fmt, n, dt = take("i"), take("I"), take("f")
        y, mo, d, h, mi = take("5i")
        sec = take("f")
        units, _, _ = text(), text(), text()
        x = np.frombuffer(data, ">f4" if fmt == 1 else ">f8", n, at)
        at += x.nbytes
        t0 = iso_us(f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:00") + round(sec * 1e6)
        out.append(piece(id=f"{net}.{sta}..{cha}", name=rec, fs=round(1 / dt, 6), gain=gain, units=units, lat=lat, lon=lon, el=el, az=az, inc=90 - dip, t0_us=t0, x=x, misc={"sensor": sensor, "a0": str(a0), "poles": str(len(poles)), "zeros": str(len(zeros)), "comment": comment}))
    return out


def ah2_write(p: dict) -> bytes:
    """One AH-2 record."""
    def text(s: str) -> bytes:
        b = (s or "").encode("latin-1")
        return struct.pack(">i", len(b)) + b + b"\0" * ((-len(b)) % 4)

    net, sta, _, cha = (p["id"].split(".") + [""] * 4)[:4]
    w = _when(p["t0_us"])
    b = b"".join(map(text, (sta, cha, net, p["name"] or "", "")))
    b += struct.pack(">ffddfff", p["az"] or 0, 90 - (p["inc"] or 0), p["lat"] or 0, p["lon"] or 0, p["el"] or 0, p["gain"], 1.0) + struct.pack(">2i", 0, 0)
    b += struct.pack(">ddf", 0, 0, 0) + struct.pack(">ihhhhf", 0, 0, 0, 0, 0, 0) + text("")
    b += struct.pack(">iIf", 2, len(p["x"]), 1 / p["fs"]) + struct.pack(">5if", w.year, w.month, w.day, w.hour, w.minute, w.second + w.microsecond / 1e6)
    b += text(p["units"] or "") + text("") + text("") + np.asarray(p["x"]).astype(">f8").tobytes()
    return struct.pack(">2i", 1100, len(b)) + b


def ah1_read(data: bytes) -> list[dict]:
    """AH-1 records: fixed 1080-byte XDR headers (station 6, channel 6, type 8 characters padded to words; response; event; record)."""
    out, at = [], 0
    while at + 1080 <= len(data):
        def text(n: int) -> str:
            nonlocal at
            k = struct.unpack_from(">i", data, at)[0]
            s = _s(data[at + 4 : at + 4 + min(k, n)])
            at += 4 + n + (-n) % 4
            return s

        def take(f: str):
            nonlocal at
            v = struct.unpack_from(">" + f, data, at)
            at += struct.calcsize(">" + f)
            return v if len(v) > 1 else v[0]

        begin = at
        sta, cha, typ = text(6), text(6), text(8)
        lat, lon, el, gain, a0 = take("5f")
        cal = np.frombuffer(data, ">f4", 120, at)
        at += 480
        take("3f")
        take("5if")
        text(80)
        fmt, n, dt, _ = take("iiff")
        y, mo, d, h, mi, sec = take("5if")
        take("f")
        text(80)
        log = text(202)
        k = take("i")
        at += 4 * max(0, k)
        x = np.frombuffer(data, ">f4" if fmt == 1 else ">f8", n, at)
        at += x.nbytes
        t0 = iso_us(f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:00") + round(sec * 1e6)
        out.append(piece(id=f".{sta}..{cha}", name=typ, fs=round(1 / dt, 6), gain=gain, lat=lat, lon=lon, el=el, t0_us=t0, x=x, misc={"a0": str(a0), "poles": str(int(cal[0])), "log": log}))
        if at <= begin:
            break
    return out


# --- bottle (S6), Win32


def bottle_read(data: bytes, path: str = "") -> list[dict]:
    """A strain-meter bottle; null values become NaN; station and channel come from the file's name."""
    order = "<" if struct.unpack_from("<i", data, 24)[0] in (0, 1, 2) else ">"
    t, dt, n, kind, null = struct.unpack_from(order + "dfiii", data, 8)
    x = np.frombuffer(data, order + {0: "i2", 1: "i4", 2: "f4"}[kind], n, 40).astype(float)
    x[x == null] = np.nan
    m = re.match(r"([A-Za-z0-9]{4}).*?([A-Z]{1,3}\d?|CH\d)(?:_\w+)?$", re.sub(r"^.*/", "", path))
    return [piece(id=f"PB.{m[1] if m else ''}..{m[2] if m else ''}", fs=1 / dt, t0_us=round(t * 1e6), x=x)]


def bottle_write(p: dict, kind: int = 1, null: int = 999999) -> bytes:
    x = np.where(np.isnan(p["x"]), null, p["x"])
    return b"\0" * 8 + struct.pack("<dfiii", p["t0_us"] / 1e6, 1 / p["fs"], len(x), kind, null) + b"\0" * 8 + x.astype({0: "<i2", 1: "<i4", 2: "<f4"}[kind]).tobytes()


def _bcd(b: bytes) -> list[int]:
    return [(v >> 4) * 10 + (v & 15) for v in b]


def win32_read(data: bytes, shift_us: int = -9 * 3_600_000_000) -> list[dict]:
    """Win32: one-second blocks of per-channel differences; times are Japanese standard time, gaps stay gaps here."""
    at, got = 4, {}
    while at + 16 <= len(data):
        d = _bcd(data[at : at + 8])
        t = iso_us(f"{d[0] * 100 + d[1]:04d}-{d[2]:02d}-{d[3]:02d}T{d[4]:02d}:{d[5]:02d}:{d[6]:02d}") + d[7] * 10_000 + shift_us
        end = at + 16 + struct.unpack_from(">I", data, at + 12)[0]
        at += 16
        while at < end:
            _, _, cid, wn, first = struct.unpack_from(">BBHHi", data, at)
            n, w = wn & 0xFFF, wn >> 12
            width = 0.5 if w == 0 else w
            size = (n - 1 + 1) // 2 if width == 0.5 else (n - 1) * w
            x = np.cumsum(np.r_[first, codecs.packed_differences(data[at + 10 : at + 10 + size], n - 1, width)])
            got.setdefault(cid, []).append((t, x))
            at += 10 + size
    out = []
    for cid, blocks in sorted(got.items()):
        run: list = []
        for t, x in blocks + [(None, None)]:
            if run and (t is None or t != run[0][0] + len(run) * 1_000_000 or len(x) != len(run[0][1])):
                out.append(piece(id=f"..{cid:04X}.", fs=float(len(run[0][1])), t0_us=run[0][0], x=np.concatenate([r[1] for r in run]), misc={"hex_id": f"{cid:04X}"}))
                run = []
            if t is not None:
                run.append((t, x))
    return out


def win32_channels(text: str) -> dict[str, dict]:
    """Channel file: hex id -> station, component, units, gain, corner frequency, place."""
    out = {}
    for line in text.splitlines():
        c = line.split()
        if len(c) < 13 or line.startswith("#"):
            continue
        num = lambda k: float(c[k]) if k < len(c) else 0.0
        out[c[0].upper()] = {"station": c[3], "component": c[4], "units": c[8], "gain": num(12) and num(7) * 10 ** (num(11) / 20) / num(12), "fc": 1 / num(9) if num(9) else 0.0, "damping": num(10), "lat": num(13), "lon": num(14), "el": num(15)}
    return out


def win32_write(pieces: list[dict], shift_us: int = 9 * 3_600_000_000) -> bytes:
    """Win32 blocks of whole seconds; pieces begin at a full second."""
    secs: dict[int, list] = {}
    for p in pieces:
        fs, x = round(p["fs"]), np.rint(p["x"]).astype(np.int64)
        for k in range(0, len(x) - fs + 1, fs):
            secs.setdefault(p["t0_us"] + k // fs * 1_000_000, []).append((int(p["misc"]["hex_id"], 16), x[k : k + fs]))
    out = [b"\0" * 4]
    for t in sorted(secs):
        w, body = _when(t + shift_us), b""
        for cid, x in secs[t]:
            d = np.diff(x)
            width = next(b for b in (1, 2, 3, 4) if (np.abs(d) < 1 << (8 * b - 1)).all())
            body += struct.pack(">BBHHi", 0, 0, cid, width << 12 | len(x), int(x[0])) + b"".join((int(v) & ((1 << 8 * width) - 1)).to_bytes(width, "big") for v in d)
        stamp = bytes((v // 10) << 4 | v % 10 for v in (w.year // 100, w.year % 100, w.month, w.day, w.hour, w.minute, w.second, 0))
        out.append(stamp + b"\0" * 4 + struct.pack(">I", len(body)) + body)
    return b"".join(out)


# --- text formats


def _header(lines: list[str]) -> tuple[dict[str, str], int]:
    h, k = {}, 0
    while k < len(lines) and (lines[k].startswith("#") or not lines[k].strip()):
        a, _, b = lines[k].lstrip("# ").partition(":")
        if b:
            h[a.strip().lower()] = b.strip()
        k += 1
    return h, k


def geocsv_read(text: str) -> list[dict]:
    """GeoCSV: '#' header, then values or time,value lines; a gap of more than one and a half steps starts a new piece."""
    lines = text.splitlines()
    out, k = [], 0
    while k < len(lines):
        h, m = _header(lines[k:])
        k += m
        if not h:
            break
        k += 1 if k < len(lines) and re.match(r"^[A-Za-z]", lines[k]) else 0
        z = k
        while z < len(lines) and not lines[z].startswith("#"):
            z += 1
        rows = [r for r in lines[k:z] if r.strip()]
        k = z
        f = lambda n: float(h[n]) if h.get(n) else None  # noqa: E731,B023
        base = {"id": ".".join((h.get("sid", "") or "").split("_")[:4]), "fs": f("sample_rate_hz"), "gain": f("scale_factor") or 1.0, "units": h.get("scale_units") or h.get("field_unit"), "lat": f("latitude_deg"), "lon": f("longitude_deg"), "el": f("elevation_m"), "az": f("azimuth_deg"), "inc": None if f("dip_deg") is None else f("dip_deg") + 90}
        if rows and "," not in rows[0] and not re.search(r"\d[T ]\d\d:", rows[0]):
            out.append(piece(**base, t0_us=iso_us(h["start_time"]), x=[float(r) for r in rows]))
            continue
        pair = [re.split(r"\s*,\s*|\s+(?=\S+$)", r.strip()) for r in rows]
        t, x = np.array([iso_us(a) for a, _ in pair], np.int64), np.array([float(b) for _, b in pair])
        d = round(1e6 / base["fs"]) if base["fs"] else 0
        cut = np.r_[0, np.flatnonzero(np.abs(np.diff(t) - d) > d // 2) + 1, len(t)] if d else np.array([0, len(t)])
        out += [piece(**base, t0_us=int(t[a]), x=x[a:b]) for a, b in zip(cut[:-1], cut[1:]) if b > a]
    return out


def geocsv_write(p: dict, pairs: bool = True) -> str:
    h = {"dataset": "GeoCSV 2.0", "delimiter": ",", "SID": "_".join(p["id"].split(".")), "sample_count": str(len(p["x"])), "sample_rate_hz": repr(p["fs"]), "start_time": _when(p["t0_us"]).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "scale_factor": repr(p["gain"]), "scale_units": p["units"] or ""}
    out = [f"# {k}: {v}" for k, v in h.items()] + ["Time, Sample" if pairs else "Sample"]
    d = 1e6 / p["fs"]
    out += [f"{_when(p['t0_us'] + round(k * d)):%Y-%m-%dT%H:%M:%S.%fZ}, {v!r}" if pairs else repr(float(v)) for k, v in enumerate(map(float, p["x"]))]
    return "\n".join(out) + "\n"


def slist_read(text: str) -> list[dict]:
    """SLIST: a TIMESERIES header line, then values."""
    out, p, xs = [], None, []
    for line in text.splitlines() + ["TIMESERIES"]:
        if line.startswith("TIMESERIES"):
            if p:
                out.append(piece(**p, x=xs))
            c = [v.strip() for v in line[10:].split(",")]
            if len(c) > 4:
                p = {"id": ".".join(c[0].split("_")[:4]), "fs": float(c[2].split()[0]), "t0_us": iso_us(c[3]), "units": c[-1] if len(c) > 6 else None}
            xs = []
        else:
            xs += [float(v) for v in line.split()]
    return out


def slist_write(p: dict) -> str:
    head = f"TIMESERIES {'_'.join(p['id'].split('.'))}_R, {len(p['x'])} samples, {p['fs']!r} sps, {_when(p['t0_us']):%Y-%m-%dT%H:%M:%S.%f}, SLIST, FLOAT, {p['units'] or 'Counts'}"
    return head + "\n" + "\n".join(repr(float(v)) for v in p["x"]) + "\n"


def lennartz_read(text: str, path: str = "") -> list[dict]:
    """Lennartz ASCII: station, step in ms and start in the first line, one value per line; the channel is the file's suffix."""
    lines = text.splitlines()
    c = lines[0].split()
    day = next(v for v in c if re.match(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", v))
    clock = next(v for v in c if re.match(r"\d\d:\d\d:", v))
    iso = day if "-" in day else "-".join(day.split(".")[::-1])
    ms = next(float(a) for a, b in zip(c, c[1:] + [""]) if b.lower().startswith("ms"))
    return [piece(id=f".{c[0]}..{re.sub(r'^.*[.]', '', path)}", fs=1000 / ms, t0_us=iso_us(f"{iso}T{clock}"), x=[float(v) for line in lines[1:] for v in line.split()])]


# --- UW (S13), SUDS (S12), TDMS

_UW_EPOCH = 11_676_096_000_000_000


def uw_read(data: bytes) -> list[dict]:
    """UW-2 data file: the structure table at the end names channel headers (CH2) and time corrections (TC2)."""
    ns = struct.unpack_from(">i", data, len(data) - 4)[0]
    at = len(data) - 4 - 12 * ns
    heads, corr = [], {}
    for k in range(ns):
        tag, n, off = struct.unpack_from(">4sii", data, at + 12 * k)
        if tag[:2] == b"CH":
            heads += [off + 56 * j for j in range(n)]
        elif tag[:2] == b"TC":
            for j in range(n):
                c, v = struct.unpack_from(">ii", data, off + 8 * j)
                corr[c] = v
    out = []
    for c, o in enumerate(heads):
        n, off, lmin, lsec, fs = struct.unpack_from(">5i", data, o)
        name, fmt, comp = _s(data[o + 32 : o + 40]), data[o + 40 : o + 41], _s(data[o + 44 : o + 48])
        x = np.frombuffer(data, {b"S": ">i2", b"L": ">i4"}.get(fmt, ">f4"), n, off)
        out.append(piece(id=f"UW.{name}..{comp}", fs=fs / 1000, t0_us=60_000_000 * lmin + lsec + corr.get(c, 0) - _UW_EPOCH, x=x))
    return out


def uw_write(pieces: list[dict]) -> bytes:
    body, heads = b"", []
    for p in pieces:
        x = np.rint(p["x"]).astype(">i4").tobytes()
        t = p["t0_us"] + _UW_EPOCH
        _, sta, _, cha = (p["id"].split(".") + [""] * 4)[:4]
        heads.append(struct.pack(">5i", len(p["x"]), len(body) + 132, t // 60_000_000, t % 60_000_000, round(p["fs"] * 1000)).ljust(32, b"\0") + f"{sta:<8.8}L   {cha:<4.4}".encode().ljust(24, b"\0"))
        body += x
    table = struct.pack(">4sii", b"CH2 ", len(heads), 132 + len(body)) + struct.pack(">i", 1)
    return b"\0" * 132 + body + b"".join(heads) + table


def uw_picks(text: str) -> tuple[dict, list[dict]]:
    """UW pick file: the A card's origin (time, place, depth, magnitude) and the picks of dot cards."""
    head, picks = {}, []
    for line in text.splitlines():
        if line.startswith("A") and len(line) > 35:
            d = line[2:14]
            deg = lambda s, neg: (int(s[:2]) + int(s[3:7]) / 6000) * (-1 if s[2:3] in neg else 1)
            head = {"typ": line[1:2], "ot_us": iso_us(f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:00") + round(float(line[14:20]) * 1e6), "lat": deg(line[21:28], "Ss"), "lon": (int(line[29:32]) + int(line[33:37]) / 6000) * (-1 if line[32:33] in "Ww" else 1), "dep": float(line[37:43] or 0), "mag": float(line[44:48].strip() or -5)}
        elif line.startswith("."):
            sta, _, cha = line[1:].split()[0].partition(".")
            for m in re.finditer(r"\(P\s+(\S+)\s+(\S)\s+(\S)\s+([\d.]+)(?:\s+([\d.]+))?(?:\s+(-?[\d.]+))?\)", line):
                picks.append({"station": sta, "channel": cha, "phase": m[1], "pol": m[2], "qual": m[3], "time_s": float(m[4]), "unc": float(m[5] or 0), "res": float(m[6] or 0)})
    return head, picks


def suds_read(data: bytes) -> list[dict]:
    """SUDS: tagged structures; STATIONCOMP (5) gives channels, DESCRIPTRACE (7) their samples (codes i q s u 2 l f d)."""
    at, comp, out = 0, {}, []
    code = {b"s": "<i2", b"q": "<i2", b"i": "<i2", b"u": "<u2", b"2": "<i4", b"l": "<i4", b"f": "<f4", b"d": "<f8"}
    while at + 12 <= len(data):
        sync, _, sid, size, n = struct.unpack_from("<ccHii", data, at)
        if sync != b"S":
            break
        o = at + 12
        ident = (_s(data[o : o + 4]), _s(data[o + 4 : o + 9]), data[o + 9 : o + 10].decode("latin-1").strip("\0 "))
        if sid == 5:
            az, inc, lat, lon, el = struct.unpack_from("<hhddf", data, o + 12)
            comp[ident] = {"az": float(az), "inc": float(inc), "lat": lat, "lon": lon, "el": el}
        elif sid == 7:
            t, _, kind = struct.unpack_from("<dhc", data, o + 12)
            rate, = struct.unpack_from("<f", data, o + 28)
            f = code.get(kind, "<i2")
            x = np.frombuffer(data[at + 12 + size : at + 12 + size + n], f)
            out.append(piece(id=f"{ident[0]}.{ident[1]}..{ident[2]}", fs=float(rate), t0_us=round(t * 1e6), x=x, **comp.get(ident, {})))
        at += 12 + size + n
    return out


def suds_write(pieces: list[dict]) -> bytes:
    out = b""
    for p in pieces:
        net, sta, _, cha = (p["id"].split(".") + [""] * 4)[:4]
        ident = f"{net:<4.4}{sta:<5.5}{cha:<1.1}".encode() + b"\0\0"
        c = ident + struct.pack("<hhddf", round(p["az"] or 0), round(p["inc"] or 0), p["lat"] or 0, p["lon"] or 0, p["el"] or 0)
        out += struct.pack("<ccHii", b"S", b"6", 5, len(c), 0) + c
        x = np.asarray(p["x"]).astype("<f4").tobytes()
        d = (ident + struct.pack("<dhc", p["t0_us"] / 1e6, 0, b"f")).ljust(28, b"\0") + struct.pack("<f", p["fs"])
        out += struct.pack("<ccHii", b"S", b"6", 7, len(d), len(x)) + d + x
    return out


_TDMS = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8"}


def tdms_read(data: bytes, start_us: int | None = None, end_us: int | None = None) -> list[dict]:
    """TDMS: lead-in, properties, channels with chunk-interleaved samples; a time range skips chunks outside it."""
    if data[:4] != b"TDSm":
        raise ValueError("no TDMS file")
    flags, = struct.unpack_from("<i", data, 4)
    nxt, raw = struct.unpack_from("<QQ", data, 12)
    at = 28

    def take(f: str):
        nonlocal at
        v = struct.unpack_from("<" + f, data, at)
        at += struct.calcsize("<" + f)
        return v if len(v) > 1 else v[0]

    def text() -> str:
        nonlocal at
        n = take("I")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    def props() -> dict:
        p = {}
        for _ in range(take("I")):
            k, t = text(), take("I")
            if t == 0x20:
                p[k] = text()
            elif t == 0x21:
                p[k] = bool(take("B"))
            elif t == 0x44:
                frac, sec = take("Qq")
                p[k] = (sec - 2_082_844_800) * 1_000_000 + round(frac / 2**64 * 1e6)
            else:
                p[k] = take({1: "b", 2: "h", 3: "i", 4: "q", 5: "B", 6: "H", 7: "I", 8: "Q", 9: "f", 10: "d"}[t])
        return p

    root, chans, kind, per = {}, [], 2, 0
    for _ in range(take("I")):
        path, idx = text(), take("I")
        if idx not in (0xFFFFFFFF, 0):
            kind, _, per = take("IIQ")
        p = props()
        if path.count("'") >= 4:
            chans.append(path)
        else:
            root |= p
    fs, t0 = float(root.get("SamplingFrequency[Hz]", 1.0)), int(root.get("GPSTimeStamp", root.get("CPUTimeStamp", 0)))
    x = np.frombuffer(data[28 + raw : 28 + nxt], "<" + _TDMS[kind])
    chunk = per if flags & 0x20 == 0 else 1
    nc = max(1, len(chans))
    rows = len(x) // (nc * max(1, chunk))
    lo, hi = 0, rows
    step = 1e6 * max(1, chunk) / fs
    if start_us is not None:
        lo = max(0, int((start_us - t0) // step))
    if end_us is not None:
        hi = min(rows, int((end_us - t0) // step) + 1)
    v = x[: rows * nc * max(1, chunk)].reshape(rows, nc, max(1, chunk))[lo:hi].transpose(1, 0, 2).reshape(nc, -1)
    return [piece(id=f".{k:05d}..", fs=fs, t0_us=t0 + round(lo * step), x=v[k], misc={"path": c}) for k, c in enumerate(chans)]


def tdms_write(pieces: list[dict], chunk: int) -> bytes:
    def text(s: str) -> bytes:
        return struct.pack("<I", len(s.encode())) + s.encode()

    p0 = pieces[0]
    sec = p0["t0_us"] // 1_000_000
    stamp = struct.pack("<Qq", round((p0["t0_us"] % 1_000_000) / 1e6 * 2**64) & (2**64 - 1), sec + 2_082_844_800)
    meta = struct.pack("<I", len(pieces) + 1) + text("/") + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<I", 2) + text("SamplingFrequency[Hz]") + struct.pack("<Id", 10, p0["fs"]) + text("GPSTimeStamp") + struct.pack("<I", 0x44) + stamp
    for k in range(len(pieces)):
        meta += text(f"/'Measurement'/'{k}'") + struct.pack("<I", 20) + struct.pack("<IIQ", 2, 1, chunk) + struct.pack("<I", 0)
    x = np.stack([np.asarray(p["x"]) for p in pieces]).reshape(len(pieces), -1, chunk).transpose(1, 0, 2).astype("<i2").tobytes()
    return b"TDSm" + struct.pack("<ii", 0x0E, 4713) + struct.pack("<QQ", len(meta) + len(x), len(meta)) + meta + x


READERS = {
    "mseed": lambda b, path: mseed_records(b), "sac": lambda b, path: sac_read(b), "segy": lambda b, path: segy_read(b), "passcal": lambda b, path: passcal_read(b),
    "ah1": lambda b, path: ah1_read(b), "ah2": lambda b, path: ah2_read(b), "bottle": bottle_read, "win32": lambda b, path: win32_read(b),
    "geocsv": lambda b, path: geocsv_read(b.decode("utf-8", "replace")), "slist": lambda b, path: slist_read(b.decode("latin-1")), "lennartz": lambda b, path: lennartz_read(b.decode("latin-1"), path),
    "uw": lambda b, path: uw_read(b), "suds": lambda b, path: suds_read(b), "tdms": lambda b, path: tdms_read(b),
}


def guess(data: bytes, name: str = "") -> str:
    """The format of a file from its first bytes (and all of a short text), 'unknown' if none fits."""
    if data[:4] == b"TDSm":
        return "tdms"
    if data[:1] == b"S" and data[1:2] in b"0123456789" and len(data) > 12 and 0 < struct.unpack_from("<H", data, 2)[0] < 40:
        return "suds"
    if re.match(rb"\d{6}[DRQM][ \0]", data[:8]):
        return "mseed"
    if re.match(rb"\d{6}V[ \0]", data[:8]):
        return "dataless"
    if data[:10] == b"TIMESERIES":
        return "slist"
    head = data[:4000].lstrip()
    if head[:1] == b"#" and b"geocsv" in head.lower():
        return "geocsv"
    if head[:1] == b"<":
        return "qml" if b"quakeml" in head.lower() else "sxml" if b"FDSNStationXML" in head else "unknown"
    if b"B053F03" in head or b"B050F03" in head or b"B058F03" in head:
        return "resp"
    if head[:1] == b"*" and b"ZEROS" in data[:8000]:
        return "sacpz"
    if len(data) >= 632 and any(1 <= struct.unpack_from(o + "i", data, 304)[0] <= 7 and 0 < struct.unpack_from(o + "f", data, 0)[0] < 1e6 for o in "<>"):
        return "sac"
    if len(data) >= 8 and struct.unpack_from(">i", data)[0] == 1100:
        return "ah2"
    if len(data) >= 8 and struct.unpack_from(">i", data)[0] == 6:
        return "ah1"
    if len(data) >= 3600 and struct.unpack_from(">H", data, 3224)[0] in (1, 2, 3, 5, 8) and struct.unpack_from(">H", data, 3216)[0]:
        return "segy"
    if len(data) >= 40 and struct.unpack_from("<i", data, 24)[0] in (0, 1, 2) and 0 < struct.unpack_from("<f", data, 16)[0] < 1e6:
        return "bottle"
    if len(data) >= 20 and data[4:6] in (b"\x19\x99", b"\x20\x20", b"\x20\x10", b"\x20\x11", b"\x20\x12", b"\x20\x13", b"\x20\x14", b"\x20\x15", b"\x20\x16", b"\x20\x17", b"\x20\x18", b"\x20\x19", b"\x20\x21", b"\x20\x22", b"\x20\x23", b"\x20\x24", b"\x20\x25", b"\x20\x26"):
        return "win32"
    if re.search(r"[Ww]$", name) and len(data) > 132:
        return "uw"
    return "unknown"
