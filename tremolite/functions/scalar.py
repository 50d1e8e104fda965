"""Scalar functions (F1-F24) as column expressions: times, codes, names, geometry, responses, polynomials."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- times


def d2u(ts: Column | str) -> Column:
    """Timestamp to unix seconds with milliseconds (F1)."""
    return F.unix_millis(_c(ts)) / 1000.0


def u2d(s: Column | str) -> Column:
    """Unix seconds to timestamp, milliseconds kept (F1)."""
    return F.timestamp_millis(F.rint(_c(s) * 1000).cast("long"))


def tstr(us: Column | str) -> Column:
    """YYYY-MM-DDTHH:MM:SS of microseconds since the epoch, whatever the session's zone (F2)."""
    return F.substring(int2tstr(us), 1, 19)


def int2tstr(us: Column | str) -> Column:
    """Microseconds to YYYY-MM-DDTHH:MM:SS.ffffff."""
    us = _c(us)
    day = ((us - F.pmod(us, F.lit(86_400_000_000))) / 86_400_000_000).cast("long")
    r = F.pmod(us, F.lit(86_400_000_000))
    d = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    h = (r / 3_600_000_000).cast("int")
    m = (F.pmod(r, F.lit(3_600_000_000)) / 60_000_000).cast("int")
    s = (F.pmod(r, F.lit(60_000_000)) / 1_000_000).cast("int")
    return F.format_string("%sT%02d:%02d:%02d.%06d", d, h, m, s, F.pmod(r, F.lit(1_000_000)).cast("long"))


def tstr2int(s: Column | str) -> Column:
    """ISO string to microseconds; date only or a shorter fraction will do, null where it is no time."""
    s = F.regexp_replace(F.trim(_c(s)), "Z$", "")
    ok = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$")
    part = lambda k: F.coalesce(F.regexp_extract(s, r"[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?", k).try_cast("long"), F.lit(0))
    frac = F.coalesce(F.rpad(F.regexp_extract(s, r"\.([0-9]+)$", 1), 6, "0").try_cast("long"), F.lit(0))
    day = F.datediff(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(ok, day * 86_400_000_000 + part(1) * 3_600_000_000 + part(2) * 60_000_000 + part(3) * 1_000_000 + frac)


def j2md(y: Column | str, j: Column | str) -> Column:
    """struct(m, d) of a year and day of year."""
    d = F.date_add(F.make_date(_c(y), F.lit(1), F.lit(1)), _c(j) - 1)
    return F.struct(F.month(d).alias("m"), F.dayofmonth(d).alias("d"))


def md2j(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """Day of year."""
    return F.dayofyear(F.make_date(_c(y), _c(m), _c(d)))


def mktime(y, j, h, m, s, ms) -> Column:
    """Microseconds of year, day of year, hour, minute, second, microsecond."""
    day = F.datediff(F.date_add(F.make_date(_c(y), F.lit(1), F.lit(1)), _c(j) - 1), F.lit("1970-01-01").cast("date")).cast("long")
    n = lambda v: _c(v).cast("long")
    return day * 86_400_000_000 + n(h) * 3_600_000_000 + n(m) * 60_000_000 + n(s) * 1_000_000 + n(ms)


def y2us(y: Column | str) -> Column:
    """Microseconds of the start of a year."""
    return F.datediff(F.make_date(_c(y), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000


def t_arr(us: Column | str) -> Column:
    """array(year, day of year, hour, minute, second, millisecond)."""
    us = _c(us)
    r = F.pmod(us, F.lit(86_400_000_000))
    d = F.date_add(F.lit("1970-01-01").cast("date"), ((us - r) / 86_400_000_000).cast("int"))
    part = lambda whole, unit: (F.pmod(r, F.lit(whole)) / unit).cast("int")
    return F.array(F.year(d), F.dayofyear(d), part(86_400_000_000, 3_600_000_000), part(3_600_000_000, 60_000_000), part(60_000_000, 1_000_000), part(1_000_000, 1000))


def bcd_time(b: Column | str) -> Column:
    """Microseconds of eight BCD bytes yy mm dd hh mm ss cc given as hex text YYYYMMDDhhmmsscc (F8)."""
    h = F.hex(_c(b))
    f = lambda a, n: F.substring(h, a, n).cast("long")
    day = F.datediff(F.make_date(f(1, 4).cast("int"), f(5, 2).cast("int"), f(7, 2).cast("int")), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86_400_000_000 + f(9, 2) * 3_600_000_000 + f(11, 2) * 60_000_000 + f(13, 2) * 1_000_000 + f(15, 2) * 10_000


def parse_window(s, t, now: datetime | None = None) -> tuple[int, int]:
    """A time window as sorted microseconds from numbers, datetimes or ISO strings.

    Two numbers count seconds from the start of the current minute; one number counts from the other end.
    """
    now = (now or datetime.now(timezone.utc)).replace(second=0, microsecond=0)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    num = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)

    def abs_us(v) -> int:
        d = v if isinstance(v, datetime) else datetime.fromisoformat(str(v))
        d = d if d.tzinfo else d.replace(tzinfo=timezone.utc)
        return (d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    if num(s) and num(t):
        a, b = abs_us(now) + round(s * 1e6), abs_us(now) + round(t * 1e6)
    elif num(s):
        b = abs_us(t)
        a = b + round(s * 1e6)
    elif num(t):
        a = abs_us(s)
        b = a + round(t * 1e6)
    else:
        a, b = abs_us(s), abs_us(t)
    return min(a, b), max(a, b)


# --- codes and names

#: Sampling rates (Hz) from which on a code holds, for corners of 0.1 Hz and more and for lower ones.
BANDS_FROM = [(1000.0, "G", "F"), (250.0, "C", "D"), (80.0, "E", "H"), (10.0, "S", "B")]
#: Sampling rates (Hz) above which a code holds, whatever the corner.
BANDS_ABOVE = [(1.0, "M"), (0.1, "L"), (1e-2, "V"), (1e-3, "U"), (1e-4, "R"), (1e-5, "P"), (1e-6, "T")]


def bandcode(fs: Column | str, fc: Column | float = 1.0) -> Column:
    """Band letter of a sampling rate and a corner frequency; null for a null rate."""
    fs, fc = _c(fs), fc if isinstance(fc, Column) else F.lit(float(fc))
    out = F.when(fs.isNull(), None)
    for lo, high, low in BANDS_FROM:
        out = out.when(fs >= lo, F.when(fc >= 0.1, high).otherwise(low))
    for lo, code in BANDS_ABOVE:
        out = out.when(fs > lo, code)
    return out.otherwise("Q")


#: Characters that a convention forbids.
FORBIDDEN = {
    "File": '"$*/:<>?@\\^|~\x7f',
    "HTML": "\"&';<>©\x7f",
    "Julia": "$\\\x7f",
    "Markdown": "!#()*+-.[\\]_`{}",
    "SEED": ".\x7f",
    "Strict": " !\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~\x7f",
}


def namestrip(s: Column | str, convention: str = "File") -> Column:
    """A name without control characters and those a convention forbids; an unknown convention is 'File' (F12)."""
    bad = FORBIDDEN.get(convention, FORBIDDEN["File"])
    return F.regexp_replace(_c(s), "[\\x00-\\x1f" + "".join("\\" + ch if not ch.isalnum() and ord(ch) < 127 else ch for ch in bad) + "]", "")


#: Whole-string fixes of unit names.
UNIT_FIXES = {
    "bits/sec": "bit/s",
    "pascals": "Pa",
    "degrees": "deg",
    "reboots": "{reboots}",
    "percent": "%",
    "gaps": "{gaps}",
    "bytes": "By",
    "cycles": "{cycles}",
    "counts": "{counts}",
    "COUNTS": "{counts}",
    "M**3/M**3": "m3/m3",
    "M/S": "m/s",
    "PA": "Pa",
    "M/M": "m/m",
    "M/S**2": "m/s2",
    "M/S/S": "m/s2",
    "M": "m",
}


def units2ucum(s: Column | str) -> Column:
    """Unit text to UCUM order: powers as digits, products with '.', negative powers after '/' (F13)."""
    x = F.regexp_replace(F.regexp_replace(F.trim(_c(s)), r"\*\*|\^", "^"), r"\^\+", "^")
    x = F.regexp_replace(x, r"\s*[·⋅×*]\s*", ".")
    x = F.regexp_replace(x, r"\s+", ".")
    x = F.regexp_replace(x, r"/", ".//")
    # tokens: (//)?name(^?[-]?digits)?
    toks = F.filter(F.split(x, r"\."), lambda t: F.length(t) > 0)

    def show(t: Column) -> Column:
        over = t.startswith("//")
        name = F.regexp_extract(t, r"^(?://)?([^0-9^\-]+)", 1)
        p = F.coalesce(F.regexp_extract(t, r"\^?(-?[0-9]+)$", 1).try_cast("int"), F.lit(1))
        p = F.when(over, -p).otherwise(p)
        mag = F.when(F.abs(p) == 1, "").otherwise(F.abs(p).cast("string"))
        return F.concat(F.when(p < 0, "/").otherwise("."), name, mag)

    y = F.regexp_replace(F.array_join(F.transform(toks, show), ""), r"^\.", "")
    # one division sign: what follows it is joined with '.', positive powers as well
    cut = F.instr(y, "/")
    y = F.when(cut > 0, F.concat(F.substring(y, F.lit(1), cut), F.translate(F.substring(y, cut + 1, F.length(y)), "/", "."))).otherwise(y)
    fixes = F.create_map(*[F.lit(v) for kv in UNIT_FIXES.items() for v in kv])
    return F.coalesce(F.try_element_at(fixes, F.trim(_c(s))), y)


#: Storage codes of scalar types.
TYPE_CODES = {"Char": 0x00, "String": 0x01, "UInt8": 0x10, "UInt16": 0x11, "UInt32": 0x12, "UInt64": 0x13, "UInt128": 0x14, "Int8": 0x20, "Int16": 0x21, "Int32": 0x22, "Int64": 0x23, "Int128": 0x24, "Float16": 0x30, "Float32": 0x31, "Float64": 0x32}


def typ2code(name: str) -> int:
    """Storage code of a type; complex types add 0x40, arrays 0x80."""
    if name.startswith("Array{"):
        return 0x80 | typ2code(name[6:-1])
    if name.startswith("Complex{"):
        return 0x40 | typ2code(name[8:-1])
    return TYPE_CODES[name]


def code2typ(code: int) -> str:
    """Type of a storage code."""
    if code & 0x80:
        return f"Array{{{code2typ(code & 0x7F)}}}"
    if code & 0x40:
        return f"Complex{{{code2typ(code & 0x3F)}}}"
    return {v: k for k, v in TYPE_CODES.items()}[code]


# --- geometry

#: Fixed value: squared ratio of the Earth's radii, rounded.
FLAT = 0.9933056


def gcdist(lat1, lon1, lat2, lon2) -> Column:
    """struct(dist, az, baz) in degrees on geocentric latitudes; azimuths in [0, 360)."""
    geo = lambda p: F.atan(F.tan(F.radians(_c(p))) * FLAT)
    p1, p2 = geo(lat1), geo(lat2)
    l1, l2 = F.radians(_c(lon1)), F.radians(_c(lon2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    dist = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    az = F.atan2(F.sin(l2 - l1) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(l2 - l1))
    baz = F.atan2(F.sin(l1 - l2) * F.cos(p1), F.cos(p2) * F.sin(p1) - F.sin(p2) * F.cos(p1) * F.cos(l1 - l2))
    deg = lambda r: F.degrees(F.when(r < 0, r + 2 * math.pi).otherwise(r))
    return F.struct(F.degrees(dist).alias("dist"), deg(az).alias("az"), deg(baz).alias("baz"))


# --- responses and polynomials


def fctoresp(fc: Column | str, c: float = 1 / math.sqrt(2)) -> Column:
    """Response of a damped oscillator: array of two poles struct(re, im), one zero at 0."""
    w = _c(fc) * (2 * math.pi)
    im = math.sqrt(1 - c * c) if c <= 1 else 0.0
    re = math.sqrt(c * c - 1) if c > 1 else 0.0
    pole = lambda s: F.struct((w * (s * re - c)).alias("re"), (w * (s * im)).alias("im"))
    return F.array(pole(1.0), pole(-1.0))


def resptofc(p: Column | str) -> Column:
    """Corner frequency of the pole whose parts are most alike in size; null without poles (F16)."""
    p = _c(p)
    s = F.array_sort(F.transform(p, lambda q: F.struct(F.abs(F.abs(q["re"]) - F.abs(q["im"])).alias("d"), F.sqrt(q["re"] * q["re"] + q["im"] * q["im"]).alias("r"))))
    return F.when(F.size(p) > 0, F.element_at(s, 1)["r"] / (2 * math.pi))


def resp_a0(p: Column | str, z: Column | str, f0: Column | str, units: Column | str | None = None) -> Column:
    """Normalisation at f0: |P(2 pi i f0)| / |Z(2 pi i f0)|, negative for units m/s."""
    w = _c(f0) * (2 * math.pi)
    size = lambda a: F.aggregate(F.coalesce(_c(a), F.array().cast("array<struct<re: double, im: double>>")), F.lit(1.0), lambda acc, q: acc * F.sqrt(q["re"] * q["re"] + F.pow(w - q["im"], 2)))
    a0 = size(p) / size(z)
    return a0 if units is None else F.when(_c(units) == "m/s", -a0).otherwise(a0)


def polyval(coef: Column | str, x: Column | str) -> Column:
    """Polynomial with descending coefficients by Horner's rule."""
    return F.aggregate(_c(coef), F.lit(0.0), lambda acc, k: acc * _c(x) + k)


def poly(roots: Column | str) -> Column:
    """Descending coefficients of the monic polynomial with given real roots."""
    step = lambda acc, r: F.zip_with(F.concat(acc, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), acc), lambda a, b: a - r * b)
    return F.aggregate(_c(roots), F.array(F.lit(1.0)), step)


def mk_lc(n: Column | str) -> Column:
    """Two-character location code of a number in base 36."""
    return F.upper(F.lpad(F.conv(_c(n).cast("string"), 10, 36), 2, "0"))


def trid(code: Column | str, fs: Column | str) -> Column:
    """Channel code of a trace code: band, instrument, component; '' outside 11..17."""
    ends = F.element_at(F.array(*[F.lit(s) for s in ("DH", "HZ", "H1", "H2", "NZ", "N1", "N2")]), _c(code) - 10)
    return F.when(_c(code).between(11, 17), F.concat(bandcode(fs), ends)).otherwise("")


def scaled_coord(v: Column | str, scalar: Column | str) -> Column:
    """A header coordinate with its scalar: positive multiplies, negative divides, 0 counts as 1."""
    s = _c(scalar)
    return F.when(s > 0, _c(v) * s).when(s < 0, _c(v) / -s).otherwise(_c(v).cast("double"))
