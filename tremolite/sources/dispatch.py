"""Dispatchers and inspection of files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.sources import formats, metadata
from tremolite.sources.datasource import listing, read_bytes, read_data

META = "path string, id string, name string, start_us bigint, end_us bigint, lat double, lon double, el double, dep double, az double, inc double, fs double, gain double, units string, a0 double, f0 double, p array<struct<re: double, im: double>>, z array<struct<re: double, im: double>>, stages string"
EVENTS = "path string, event_id string, typ string, name string, ot_us bigint, lat double, lon double, dep double, nst bigint, gap double, rms double, mag double, mag_scale string, m0 double, mt array<double>, picks string"


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    names = listing(pattern)
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)))


def _parsed(files: DataFrame, schema: str, parse) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ") if not c.startswith(("im:",))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                for r in parse(read_bytes(path), path):
                    rows.append({"path": path} | {n: r.get(n) for n in names if n != "path"})
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def read_meta(spark: SparkSession, pattern: str, fmt: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Channel epochs of sxml, sacpz, resp or dataless files that overlap a window; stages as JSON."""
    import json

    readers = {"sxml": lambda b: metadata.sxml_read(b.decode("utf-8"), start_us, end_us), "sacpz": lambda b: metadata.sacpz_read(b.decode("utf-8")), "resp": lambda b: metadata.resp_read(b.decode("latin-1")), "dataless": metadata.dataless_read}
    if fmt not in readers:
        raise ValueError(f"metadata formats are {sorted(readers)}")

    def parse(data: bytes, _: str):
        for r in readers[fmt](data):
            if (end_us is None or (r.get("start_us") or 0) <= end_us) and (start_us is None or r.get("end_us") is None or r["end_us"] >= start_us):
                yield r | {"stages": json.dumps(r.get("stages", []))}

    return _parsed(_files(spark, pattern), META, parse)


def read_quake(spark: SparkSession, pattern: str, fmt: str = "qml") -> DataFrame:
    """Events of qml or uw (pick) files; picks as JSON."""
    import json

    def parse(data: bytes, path: str):
        if fmt == "qml":
            for e in metadata.qml_read(data.decode("utf-8")):
                yield e | {"picks": json.dumps(e["picks"])}
        elif fmt == "uw":
            head, picks = formats.uw_picks(data.decode("latin-1"))
            yield head | {"event_id": path.rsplit("/", 1)[-1], "picks": json.dumps(picks)}
        else:
            raise ValueError("event formats are qml and uw")

    return _parsed(_files(spark, pattern), EVENTS, parse)


def read_nodal(spark: SparkSession, pattern: str, fmt: str, chans: list[int] | None = None, network: str = "N0", start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """Nodal arrays (segy, tdms); chans selects channels, start_s and end_s count seconds from the file's start."""
    if fmt not in ("segy", "tdms"):
        raise ValueError("nodal formats are segy and tdms")
    d = read_data(spark, pattern, fmt)
    d = d.withColumn("id", F.concat(F.lit(network), F.regexp_extract("id", r"(\..*)$", 1)))
    if chans is not None:
        d = d.where(F.regexp_extract("id", r"^[^.]*\.(\d+)\.", 1).cast("int").isin(*chans))
    if start_s is not None or end_s is not None:
        a = F.greatest(F.lit(0), F.ceil(F.lit(start_s or 0.0) * F.col("fs"))).cast("int")
        z = F.least(F.size("x"), F.floor(F.lit(end_s) * F.col("fs")).cast("int") + 1) if end_s is not None else F.size("x")
        d = d.withColumn("x", F.slice("x", a + 1, F.greatest(F.lit(0), z - a))).withColumn("t0_us", F.col("t0_us") + F.rint(a * 1e6 / F.col("fs")).cast("long")).withColumn("n", F.size("x").cast("long"))
    return d


def sac_header(data: bytes) -> dict[str, str]:
    """I4: set words of a SAC header, by kind and place."""
    order = "<" if 1 <= struct.unpack_from("<i", data, 304)[0] <= 7 else ">"
    out = {f"f{k + 1:03d}": repr(float(v)) for k, v in enumerate(np.frombuffer(data, order + "f4", 70)) if v != -12345.0}
    out |= {f"i{k + 1:03d}": str(v) for k, v in enumerate(np.frombuffer(data, order + "i4", 40, 280)) if v != -12345}
    out |= {f"k{k + 1:03d}": s for k in range(24) if not (s := data[440 + 8 * k : 448 + 8 * k].decode("latin-1").strip("\0 ")).startswith("-12345") and s}
    return out


def segy_header(data: bytes, trace: int = 0) -> dict[str, str]:
    """I4: words of the file header and of one trace header, by place."""
    out = {f"file_{3200 + 2 * k}": str(v) for k, v in enumerate(struct.unpack_from(">200h", data, 3200)) if v}
    us, ns, fmt = (struct.unpack_from(">H", data, o)[0] for o in (3216, 3220, 3224))
    at = 3600 + trace * (240 + ns * {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}[fmt])
    return out | {f"trace_{2 * k}": str(v) for k, v in enumerate(struct.unpack_from(">120h", data, at)) if v}


#: What is read and written.
SUPPORT = [
    ("mseed", "read write", "Steim-1/2, integers, floats, GEOSCOPE, CDSN, SRO, DWWSSN; blockettes 100, 1000"), ("sac", "read write", "header versions 6 and 7, both byte orders"), ("segy", "read write", "formats 1, 2, 3, 5, 8; extended text headers"), ("passcal", "read", "single-trace field files"),
    ("ah1", "read", "XDR, version 1"), ("ah2", "read write", "XDR, version 2"), ("bottle", "read write", "16, 32-bit integers and floats"), ("geocsv", "read write", "time-sample pairs and sample lists"), ("slist", "read write", "sample lists"), ("lennartz", "read", "sample lists"),
    ("win32", "read write", "0.5 to 4-byte differences; channel files"), ("suds", "read write", "structures 5 and 7"), ("uw", "read write", "version 2 data; pick files read"), ("tdms", "read write", "one segment, typed properties"),
    ("sxml", "read write", "poles and zeros, stages"), ("qml", "read write", "events, origins, magnitudes, tensors, picks"), ("sacpz", "read write", ""), ("resp", "read", "blockettes 50, 52-54, 57, 58"), ("dataless", "read write", "blockettes 34, 50, 52, 53, 58"), ("store", "read write", "Parquet by station and day; new, add, overwrite"),
]


def support(spark: SparkSession) -> DataFrame:
    """The support table."""
    return spark.createDataFrame(SUPPORT, "format string, access string, detail string")
