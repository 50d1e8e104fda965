"""Problem 6: quantities recorded in different units.

Units are the nodes of a graph, conversions its edges, each an affine function
(si = scale * value + offset).  Shortest compositions to the canonical unit of each
quantity are found once, on a graph of about a hundred nodes, and every cycle is checked for
consistency; data is then converted with one equi-join on the source unit.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

G0 = 9.80665  # m/s2, standard gravity
#: Decimal prefixes, and spelled-out prefixes.
PREFIX = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2, "h": 1e2, "k": 1e3}
#: Canonical units and the prefixes in use with each.
CANONICAL = {"m": "numck", "m/s": "numck", "m/s2": "numc", "pa": "mhk", "k": "m", "v": "num", "rad": "num", "%": "", "hz": "mk"}
#: Edges that are no decimal prefix: (from, to, scale, offset).
EDGES = [
    ("in/s", "m/s", 0.0254, 0.0),
    ("kine", "cm/s", 1.0, 0.0),
    ("in", "m", 0.0254, 0.0),
    ("gal", "cm/s2", 1.0, 0.0),
    ("mgal", "gal", 1e-3, 0.0),
    ("gravity", "m/s2", G0, 0.0),
    ("milligravity", "gravity", 1e-3, 0.0),
    ("mbar", "hpa", 1.0, 0.0),
    ("bar", "mbar", 1000.0, 0.0),
    ("psi", "pa", 6894.757293168, 0.0),
    ("degc", "k", 1.0, 273.15),
    ("degf", "degc", 5 / 9, -160 / 9),
    ("deg", "rad", math.pi / 180, 0.0),
    ("arcmin", "deg", 1 / 60, 0.0),
    ("arcsec", "arcmin", 1 / 60, 0.0),
    ("fraction", "%", 100.0, 0.0),
    ("rad/s", "hz", 1 / (2 * math.pi), 0.0),
]
#: How canonical units are written in results.
SHOWN = {"m": "m", "m/s": "m/s", "m/s2": "m/s2", "pa": "Pa", "k": "K", "v": "V", "rad": "rad", "%": "%", "hz": "Hz"}


def edges() -> list[tuple[str, str, float, float]]:
    """All edges: decimal prefixes by rule, the rest from the list."""
    return [(p + u, u, PREFIX[p], 0.0) for u, ps in CANONICAL.items() for p in ps] + EDGES


def compositions(graph: list[tuple[str, str, float, float]] | None = None, targets: dict[str, str] | None = None, tol: float = 1e-9) -> dict[str, tuple[str, float, float, int]]:
    """unit -> (canonical unit, scale, offset, steps) by breadth-first search.

    Raises ValueError where two ways between units disagree by more than tol (a bad cycle),
    or where a unit reaches two canonical units.
    """
    graph, targets = graph or edges(), targets or SHOWN
    near: dict[str, list[tuple[str, float, float]]] = {}
    for a, b, s, o in graph:
        near.setdefault(b, []).append((a, s, o))  # a -> b, so from b back to a
        near.setdefault(a, []).append((b, 1 / s, -o / s))
    best: dict[str, tuple[str, float, float, int]] = {}
    for root in targets:
        if root in best:
            raise ValueError(f"{root} reaches {best[root][0]}: two canonical units in one quantity")
        best[root] = (targets[root], 1.0, 0.0, 0)
        queue = deque([root])
        while queue:
            u = queue.popleft()
            _, s, o, n = best[u]
            for v, sv, ov in near.get(u, []):
                new = (targets[root], s * sv, s * ov + o, n + 1)
                if v not in best:
                    best[v] = new
                    queue.append(v)
                elif best[v][0] != targets[root] or abs(best[v][1] - new[1]) > tol * abs(new[1]) or abs(best[v][2] - new[2]) > tol * max(1.0, abs(new[2])):
                    raise ValueError(f"conversions of {v} disagree: {best[v]} and {new}")
    return best


#: Spellings after lower-casing that are no product of the rules in unit_key.
SPELLED = {
    "pascal": "pa", "pascals": "pa", "hectopascal": "hpa", "hectopascals": "hpa", "kilopascal": "kpa", "millibar": "mbar", "millibars": "mbar",
    "kelvin": "k", "kelvins": "k", "millikelvin": "mk", "c": "degc", "cel": "degc", "celsius": "degc", "degree celsius": "degc", "degrees celsius": "degc", "deg c": "degc", "°c": "degc",
    "f": "degf", "fahrenheit": "degf", "degree fahrenheit": "degf", "degrees fahrenheit": "degf", "deg f": "degf", "°f": "degf", "[degf]": "degf",
    "volt": "v", "volts": "v", "millivolt": "mv", "millivolts": "mv", "microvolt": "uv", "microvolts": "uv", "nanovolt": "nv",
    "radian": "rad", "radians": "rad", "milliradian": "mrad", "microradian": "urad", "nanoradian": "nrad",
    "degree": "deg", "degrees": "deg", "degree of arc": "deg", "degrees of arc": "deg", "°": "deg", "second of arc": "arcsec", "arc second": "arcsec", "arcseconds": "arcsec", "minute of arc": "arcmin",
    "percent": "%", "per cent": "%", "pct": "%", "%rh": "%", "unit fraction": "fraction", "fractions": "fraction",
    "standard gravity": "gravity", "g": "gravity", "[g]": "gravity", "gn": "gravity", "milli-g": "milligravity", "mg": "milligravity", "m[g]": "milligravity", "milligal": "mgal", "gals": "gal",
    "m/s/s": "m/s2", "inch/s": "in/s", "inches/s": "in/s", "psia": "psi", "hertz": "hz", "millihertz": "mhz", "kilohertz": "khz",
}


#: Rewriting rules of spellings, in order.
REWRITES = (
    (r"[µμ]", "u"),
    (r"\s+", " "),
    (r"^1 ", ""),
    (r"nano-?met(?:re|er)s?", "nm"), (r"micro-?met(?:re|er)s?|microns?", "um"), (r"milli-?met(?:re|er)s?", "mm"), (r"centi-?met(?:re|er)s?", "cm"), (r"kilo-?met(?:re|er)s?", "km"), (r"\bmet(?:re|er)s?\b", "m"), (r"\binch(?:es)?\b", "in"), (r"\bradians?\b", "rad"),
    (r" ?per second squared| ?per second per second| ?per square second", "/s2"),
    (r" ?(?:per|/) ?sec(?:ond)?s?\b", "/s"),
    (r"\^|\*\*", ""),
    (r" ?[ *.·⋅×] ?s(?:ec)?-1$", "/s"), (r" ?[ *.·⋅×] ?s(?:ec)?-2$", "/s2"),
    (r" ?/ ?s(?:ec)?1?$", "/s"), (r" ?/ ?s(?:ec)? ?2$", "/s2"),
)


def unit_key(text: Column) -> Column:
    """Free spelling of a unit as the key of a graph node; unknown spellings stay as they are."""
    s = F.lower(F.trim(text))
    for a, b in REWRITES:
        s = F.regexp_replace(s, a, b)
    table = F.create_map(*[F.lit(v) for kv in SPELLED.items() for v in kv])
    return F.coalesce(F.try_element_at(table, s), s)


def unit_table(spark) -> DataFrame:
    """The compositions as a table: unit, si_units, scale, offset, steps (about a hundred rows, a fixed size)."""
    return spark.createDataFrame([(u, *v) for u, v in sorted(compositions().items())], "unit string, si_units string, scale double, offset double, steps int")


def convert(df: DataFrame, value: str, unit: str, to: str | None = None, out: str = "si_value") -> DataFrame:
    """df with ``out``, the values of a quantity in the canonical unit of its kind, or in the unit that column ``to`` names, and si_units.

    Both scale and offset are applied: 0 degC is 273.15 K.  (A gain, counts per unit, has no offset: see ``to_si``.)  Units may be spelt
    freely.  A null value, an unknown unit, or two units of different kinds give null; no row is lost.
    """
    table = unit_table(df.sparkSession).select("unit", "si_units", "scale", "offset")  # about a hundred rows whatever the data
    a = table.select(F.col("unit").alias("_ua"), "si_units", F.col("scale").alias("_sa"), F.col("offset").alias("_oa"))
    d = df.withColumn("_k", unit_key(F.col(unit))).join(F.broadcast(a), F.col("_k") == F.col("_ua"), "left")
    y = F.col(value) * F.col("_sa") + F.col("_oa")
    gone = ["_k", "_ua", "_sa", "_oa"]
    if to is not None:
        b = table.select(F.col("unit").alias("_ub"), F.col("si_units").alias("_kind"), F.col("scale").alias("_sb"), F.col("offset").alias("_ob"))
        d = d.withColumn("_l", unit_key(F.col(to))).join(F.broadcast(b), F.col("_l") == F.col("_ub"), "left")
        y = F.when(F.col("si_units") == F.col("_kind"), (y - F.col("_ob")) / F.col("_sb"))
        gone += ["_l", "_ub", "_kind", "_sb", "_ob"]
    return d.withColumn(out, y).drop(*gone)


def stated_unit(text: Column) -> Column:
    """The unit that a phrase such as 'counts/(nm/s)' or 'gain refers to one kelvin' gives the gain in."""
    pats = (
        r"(?i)(?:counts?|cts|digital counts)\s*(?:/|per)\s*\(?\s*([^()]+?)\s*\)?\s*\.?$",
        r"(?i)calibrated per\s+(.+?)(?:,.*|\.?)$",
        r"(?i)amplitudes? of this channel (?:is|are) in\s+(.+?)(?: after unscaling)?\.?$",
        r"(?i)gain refers to (?:one|1|an?)\s+(.+?)\.?$",
        r"(?i)\bone\s+(.+?)\s+gives the stated number of counts",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in pats])


def gain_units(units: Column, resp_in: Column, misc: Column, notes: Column) -> Column:
    """Candidate unit keys of a record in order of precedence: units, misc, notes, response input."""
    # a key of misc that speaks of units or sensitivity; its value is a unit, bare or as counts per unit
    keys = F.filter(F.map_keys(misc), lambda k: k.rlike("(?i)unit|sensit"))
    from_misc = F.transform(F.array_sort(keys), lambda k: unit_key(F.coalesce(stated_unit(misc[k]), misc[k])))
    from_notes = F.transform(notes, lambda n: unit_key(stated_unit(n)))
    empty = F.array().cast("array<string>")
    return F.concat(F.array(unit_key(F.coalesce(stated_unit(units), units))), F.coalesce(from_misc, empty), F.coalesce(from_notes, empty), F.array(unit_key(resp_in)))


def corner_unit(fu: Column, descr: Column) -> Column:
    """How resp.f0 is expressed: 'hz', 'mhz', 'khz', 'rad/s' or 's' (a period); nothing said: hz."""
    said = F.lower(F.coalesce(F.nullif(F.trim(fu), F.lit("")), F.nullif(F.trim(descr), F.lit("")), F.lit("hz")))
    return (
        F.when(said.rlike(r"rad|angular"), "rad/s")
        .when(said.rlike(r"mhz|millihertz"), "mhz")
        .when(said.rlike(r"khz|kilohertz"), "khz")
        .when(said.rlike(r"hz|hertz|cycles"), "hz")
        .when(said.rlike(r"^s$|^secs?$|second|period"), "s")
        .otherwise("hz")
    )


def to_si(channels: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, what ('gain' or 'f0'), si_units, si_value (bigint).

    'gain': counts per SI unit where the gain is usable (positive, finite, not the default 1) and the
    first candidate unit known to the graph; a record that states no known unit gives no row.
    'f0': corner frequency in mHz where the response has poles and f0 is positive and finite.
    The gain is a rate per unit, so only the scale of a unit matters, not its offset.
    A value beyond a bigint gives no row.  Nulls in any column, or an empty table, give no rows.
    """
    spark = channels.sparkSession
    table = F.broadcast(unit_table(spark).select("unit", "si_units", "scale"))  # about a hundred rows whatever the data
    g, f0 = F.col("gain"), F.col("resp.f0")
    usable = g.isNotNull() & ~F.isnan(g) & (g > 0) & (g != 1) & (g < 1e300)
    cand = channels.where(usable).select(key, "gain", F.posexplode(F.filter(gain_units(F.col("units"), F.col("resp.i"), F.col("misc"), F.col("notes")), lambda u: u.isNotNull())).alias("_n", "unit"))
    hit = cand.join(table, "unit").groupBy(key, "gain").agg(F.min_by(F.struct("si_units", "scale"), "_n").alias("u"))
    gains = hit.select(key, F.lit("gain").alias("what"), F.col("u.si_units").alias("si_units"), (F.col("gain") / F.col("u.scale")).alias("v"))
    hz = {u: s for u, (c, s, _, _) in compositions().items() if c == "Hz"}
    cu = corner_unit(F.col("resp.fu"), F.col("resp.descr"))
    v = F.when(cu == "s", 1 / f0)
    for u in ("hz", "mhz", "khz", "rad/s"):
        v = v.when(cu == u, f0 * hz[u])
    ok = (F.size("resp.p") > 0) & f0.isNotNull() & ~F.isnan(f0) & (f0 > 0) & (f0 < 1e300)
    corners = channels.where(ok).select(key, F.lit("f0").alias("what"), F.lit("Hz").alias("si_units"), (v * 1000).alias("v"))
    both = gains.unionByName(corners)
    return both.where(F.col("v") < 9.2e18).select(key, "what", "si_units", F.round("v").cast("long").alias("si_value"))
