"""Requests to web services (W1-W12): parsing, splitting and compacting of requests, and the processing that follows.

Nothing here opens a connection by itself: ``fetch`` is a function from a request to bytes that the caller
supplies, run on executors, one partition per sub-request.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.model import DAY, KW
from tremolite.operators import process
from tremolite.sources import formats

#: Short names of data centres that speak the FDSN protocol.
SERVERS = {
    "BGR": "http://eida.bgr.de", "EMSC": "http://www.seismicportal.eu", "ETH": "http://eida.ethz.ch", "GEONET": "http://service.geonet.org.nz", "GFZ": "http://geofon.gfz-potsdam.de", "ICGC": "http://ws.icgc.cat", "INGV": "http://webservices.ingv.it",
    "IPGP": "http://eida.ipgp.fr", "IRIS": "http://service.iris.edu", "ISC": "http://isc-mirror.iris.washington.edu", "KOERI": "http://eida.koeri.boun.edu.tr", "LMU": "http://erde.geophysik.uni-muenchen.de", "NCEDC": "http://service.ncedc.org", "NIEP": "http://eida-sc3.infp.ro",
    "NOA": "http://eida.gein.noa.gr", "ODC": "http://www.orfeus-eu.org", "ORFEUS": "http://www.orfeus-eu.org", "RESIF": "http://ws.resif.fr", "SCEDC": "http://service.scedc.caltech.edu", "TEXNET": "http://rtserve.beg.utexas.edu", "USGS": "http://earthquake.usgs.gov", "USP": "http://sismo.iag.usp.br",
}

#: Data centres of assembled data of dense arrays, with a path of their own.
PH5 = {"IRISPH5": "http://service.iris.edu"}


def server(src: str) -> str:
    """Base address of a data centre's services; what is no known short name is taken for an address."""
    if "PH5" in src:
        return f"{PH5[src]}/ph5ws" if src in PH5 else src.rstrip("/")
    return f"{SERVERS[src]}/fdsnws" if src in SERVERS else src.rstrip("/")


def parse_channels(text: str) -> list[tuple[str, str, str, str]]:
    """W10: 'NET.STA.LOC.CHA, ...' to four codes each; missing or blank codes are wildcards."""
    out = []
    for part in filter(None, (p.strip() for p in text.replace("\n", ",").split(","))):
        c = (part.split(".") + [""] * 4)[:4]
        out.append(tuple(v.strip() or "*" for v in c))
    return out


def compact(requests: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str]]:
    """Requests that differ in one code only become one with a comma list, code by code from the last."""
    rows = sorted(set(requests))
    for k in (3, 2, 1, 0):
        by: dict[tuple, set[str]] = {}
        for r in rows:
            by.setdefault(r[:k] + r[k + 1 :], set()).update(r[k].split(","))
        rows = sorted(g[:k] + (",".join(sorted(v)),) + g[k:] for g, v in by.items())
    return rows


def windows(start_us: int, end_us: int, days: float = KW.nd) -> list[tuple[int, int]]:
    """Sub-windows of at most ``days``; all but the first start a microsecond later, so none overlap."""
    step, out, at = round(days * DAY), [], start_us
    while at < end_us:
        z = min(end_us, at + step)
        out.append((at if at == start_us else at + 1, z))
        at = z
    return out


@dataclass(frozen=True)
class Request:
    net: str
    sta: str
    loc: str
    cha: str
    start_us: int
    end_us: int
    src: str = KW.src

    def url(self, service: str = "dataselect") -> str:
        iso = lambda us: formats._when(us).strftime("%Y-%m-%dT%H:%M:%S.%f")
        loc = "--" if self.loc == "" else self.loc
        return f"{server(self.src)}/{service}/1/query?net={self.net}&sta={self.sta}&loc={loc}&cha={self.cha}&start={iso(self.start_us)}&end={iso(self.end_us)}"


def plan(channels: str, start_us: int, end_us: int, src: str = KW.src, days: float = KW.nd) -> list[Request]:
    """All sub-requests of a request."""
    return [Request(*c, a, z, src) for c in compact(parse_channels(channels)) for a, z in windows(start_us, end_us, days)]


def fetch_all(spark: SparkSession, requests: list[Request], fetch: Callable[[Request], bytes], fmt: str = "mseed") -> DataFrame:
    """Pieces of all requests, one partition each; a failed request gives a row with id XX.FAIL..nnn and the reason in misc, an
    unreadable answer one with id XX.FMT..nnn that holds the bytes as they came (W12)."""
    idx = spark.createDataFrame([(k,) for k in range(len(requests))], "k int").repartition(max(1, len(requests)), "k")
    cols = formats.COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["k"]:
                try:
                    raw = fetch(requests[k])
                    try:
                        got = formats.READERS[fmt](raw, "")
                    except Exception as e:  # noqa: BLE001
                        got = [formats.piece(id=f"XX.FMT..{k + 1:03d}", fs=0.0, t0_us=0, x=[], misc={"error": str(e), "bytes": str(len(raw)), "raw_base64": base64.b64encode(raw).decode()})]
                except Exception as e:  # noqa: BLE001
                    got = [formats.piece(id=f"XX.FAIL..{k + 1:03d}", fs=0.0, t0_us=0, x=[], misc={"error": str(e), "url": requests[k].url()})]
                rows += [{c: p[c] for c in cols} for p in got]
            yield pd.DataFrame(rows, columns=cols)

    return idx.mapInPandas(run, formats.PIECE)


def finish(
    samples: DataFrame, keys: list[str], step: int, fs: float, prune: bool = False, sync: bool = False, unscale: bool = False, demean: bool = False, detrend: bool = False,
    taper: bool = False, ungap: bool = False, rr: DataFrame | None = None, seismic_only: bool = False,
) -> DataFrame:
    """What follows a download, in its fixed order; every flag is honoured by itself.

    prune drops channels without a value; sync is for all channels; the rest is done for channels with a seismic instrument
    code only if ``seismic_only`` (others stay as they are).  rr: responses of channels (keys and resp) to be removed at last, from
    contiguous segments; channels without one stay as they are.
    """
    from tremolite.functions.ids import inst_code
    from tremolite.operators import dsp
    from tremolite.timeaxis import segments_of_samples

    d = samples
    if prune:
        d = d.join(d.groupBy(*keys).agg(F.count(process.valid()).alias("_n")).where("_n > 0").select(*keys), keys, "left_semi")
    if sync:
        d = process.sync(d, keys, step)
    rest = None
    if seismic_only and "id" in keys:
        code = F.coalesce(inst_code("id").isin(*KW.seismic), F.lit(False))
        d, rest = d.where(code), d.where(~code)
    if unscale and "gain" in d.columns:
        d = process.unscale(d)
    if demean:
        d = process.demean(d, keys)
    if detrend:
        d = process.detrend(d, keys)
    if taper:
        d = process.taper(segments_of_samples(d, keys, "t_us", step), keys, fs).drop("seg")
    if ungap:
        d = process.ungap(d, keys, step)
    if rr is not None:
        s = segments_of_samples(d, keys, "t_us", step).groupBy(*keys, "seg").agg(F.min("t_us").alias("t0_us"), F.array_sort(F.collect_list(F.struct("t_us", "x"))).alias("_v"))
        s = s.join(rr.select(*keys, "resp"), keys, "left").withColumn("x", F.col("_v.x")).withColumn("fs", F.lit(float(fs)))
        with_, without = s.where("resp is not null").drop("_v"), s.where("resp is null").drop("_v")
        done = dsp.translate_traces(with_).select(*keys, "t0_us", "x").unionByName(without.select(*keys, "t0_us", "x"))
        d = done.select(*keys, "t0_us", F.posexplode("x").alias("_k", "x")).select(*keys, (F.col("t0_us") + F.col("_k") * step).alias("t_us"), "x")
    return d if rest is None else d.unionByName(rest.select(*[c for c in d.columns if c in rest.columns]), allowMissingColumns=True)


def live_stations(streams: DataFrame, now_us: int, stations: list[str], gap_s: int = KW.sl_gap_s) -> DataFrame:
    """Which stations have a packet younger than gap_s seconds: station, live."""
    s = streams.select(F.regexp_extract("id", r"^([^.]*\.[^.]*)", 1).alias("station"), "end_us").groupBy("station").agg(F.max("end_us").alias("_e"))
    w = streams.sparkSession.createDataFrame([(x,) for x in stations], "station string")
    return w.join(s, "station", "left").select("station", F.coalesce(F.lit(now_us) - F.col("_e") < gap_s * 1_000_000, F.lit(False)).alias("live"))
