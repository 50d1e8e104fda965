"""Waveform files as a Spark data source, and sinks.

    spark.dataSource.register(WaveformSource)
    spark.read.format("waveform").option("fmt", "mseed").load("/data/*.mseed")

One partition per file, or per ``split`` bytes of a mini-SEED file, cut where a record begins; a time window
given as start_us and end_us options is applied to record headers before samples are kept, and ``headers``
gives headers without samples.  Paths with a scheme (s3://, hdfs://, gs://, file://) are read through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tremolite.sources import formats

SCHEMA = "path string, " + formats.PIECE
#: Default bytes of a split of mini-SEED files; bytes read beyond a split for its last record.
SPLIT, BEYOND = 64 << 20, 1 << 16


class FileRange(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        self.path, self.begin, self.end = path, begin, end


# --- files, here or on a remote file system


def _remote(path: str):
    """(Arrow file system, path in it) of a URI; None for a plain path."""
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _hidden(name: str) -> bool:
    return os.path.basename(name).startswith(("_", "."))


def _base(pattern: str) -> str:
    """The folder of a pattern: what stands before its first wildcard."""
    parts = pattern.split("/")
    wild = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    return "/".join(parts if wild is None else parts[:wild]) or "."


def listing(pattern: str) -> list[str]:
    """Files of a glob pattern, a folder or a comma list, in order of name; names that begin with _ or . are left out."""
    out: list[str] = []
    for p in filter(None, pattern.split(",")):
        far = _remote(_base(p))
        if far is None:
            out += sorted(q for q in (glob.glob(os.path.join(p, "**"), recursive=True) if os.path.isdir(p) else glob.glob(p, recursive=True)) if os.path.isfile(q) and not _hidden(q))
            continue
        from pyarrow import fs

        system, base = far
        head = _base(p)[: len(_base(p)) - len(base)]
        top = system.get_file_info(base)
        if top.type == fs.FileType.File:
            out.append(p)
        elif top.type == fs.FileType.Directory:
            found = [i.path for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and not _hidden(i.path)]
            out += sorted(head + q for q in found if _base(p) == p or fnmatch.fnmatch(head + q, p))
    return out


def stat(path: str) -> tuple[int, int]:
    """(bytes, time of change in nanoseconds) of a file."""
    far = _remote(path)
    if far is None:
        s = os.stat(path)
        return s.st_size, s.st_mtime_ns
    i = far[0].get_file_info(far[1])
    return i.size, i.mtime_ns or 0


def read_bytes(path: str, begin: int = 0, end: int | None = None) -> bytes:
    """A byte range of a file."""
    far = _remote(path)
    with open(path, "rb") if far is None else far[0].open_input_file(far[1]) as f:
        f.seek(begin)
        return f.read() if end is None else f.read(end - begin)


def read_range(fmt: str, path: str, begin: int = 0, end: int | None = None, start_us: int | None = None, end_us: int | None = None, headers: bool = False) -> Iterator[tuple]:
    """Rows (path, piece columns) of a file, or of the mini-SEED records that begin in a byte range of it.

    Records may have any mixture of lengths: a range begins at the first record header in it, and its last record
    is read to its end.
    """
    data = read_bytes(path, begin, None if end is None else end + BEYOND)
    if fmt == "auto":
        fmt = "mseed" if end is not None else formats.guess(data, path)
    if fmt not in formats.READERS:
        raise ValueError(f"{path}: format {fmt!r} isn't supported; there are {sorted(formats.READERS)}")
    if end is not None:
        at = formats.mseed_sync(data, 0) if begin else 0
        stop = formats.mseed_stop(data, at, end - begin)
        if stop > len(data):
            data += read_bytes(path, begin + len(data), begin + stop)
        data = data[at:stop]
    pieces = formats.mseed_records(data, headers_only=True) if headers and fmt == "mseed" else formats.READERS[fmt](data, path)
    for p in pieces:
        last = p["t0_us"] + (round((p["n"] - 1) * 1e6 / p["fs"]) if p["fs"] and p["n"] else 0)
        if (start_us is None or last >= start_us) and (end_us is None or p["t0_us"] <= end_us):
            if headers:
                p = p | {"x": []}
            yield (path, *(v.tolist() if isinstance(v := p[c], np.ndarray) else v for c in formats.COLUMNS))


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fmt = options.get("fmt", "auto")
        self.pattern = options.get("path", "")
        self.split = max(64, int(options.get("split", SPLIT)) // 64 * 64)  # records begin at multiples of 64 bytes
        us = lambda k: int(options[k]) if options.get(k) else None
        self.window = us("start_us"), us("end_us"), str(options.get("headers", "")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in listing(self.pattern):
            n = stat(p)[0]
            if n > self.split and (self.fmt == "mseed" or (self.fmt == "auto" and formats.guess(read_bytes(p, 0, 16384), p) == "mseed")):
                out += [FileRange(p, k, min(n, k + self.split)) for k in range(0, n, self.split)]
            else:
                out.append(FileRange(p))
        return out or [FileRange("")]

    def read(self, part: FileRange) -> Iterator[tuple]:
        if part.path:
            yield from read_range(self.fmt, part.path, part.begin, part.end, *self.window)


class PacketStream(DataSourceStreamReader):
    """Packet files of a folder as a stream: each is read once, whenever it comes and whatever its name (option ``mode``: all of
    them, those that come after the query's first start, or the packets of a time window).

    Files are numbered as they are discovered: a log beside them (option ``log``, by default the folder ``_seen``) has one
    entry per discovery with the names and times of change of its files, and offsets count entries.  An offset so stands for
    the same files after a restart.  Files should appear whole (written under a name with _ or . and renamed); one that
    changes afterwards is read again.  ``maxFilesPerTrigger`` bounds an entry; an availableNow query then ends after it.
    """

    def __init__(self, options: dict):
        self.fmt, self.pattern = options.get("fmt", "mseed"), options.get("path", "")
        self.most = int(options.get("maxFilesPerTrigger", 0)) or None
        # T2: 'fetch' reads everything from the start, 'data' only what comes after the query's start, 'time' what lies in a time window
        self.mode = options.get("mode", "fetch")
        if self.mode not in ("data", "fetch", "time"):
            raise ValueError("modes are data, fetch and time")
        us = lambda k: int(options[k]) if options.get(k) else None
        self.window = (us("start_us"), us("end_us")) if self.mode == "time" else (None, None)
        self.log = options.get("log") or f"{_base(self.pattern.split(',')[0]).rstrip('/')}/_seen"
        self.entries: list[list[list]] = []
        self.seen: set[tuple[str, int]] = set()

    def initialOffset(self) -> dict:
        if self.mode == "data":
            while (n := self.latestOffset()["n"]) and self._more():
                pass
            return {"n": n}
        return {"n": 0}

    def _more(self) -> bool:
        before = len(self.entries)
        return self.latestOffset()["n"] > before

    def _entry(self, k: int) -> str:
        return f"{self.log}/{k:09d}.json"

    def _catch_up(self) -> None:
        """Entries that this or another query has written are taken over."""
        while True:
            try:
                files = json.loads(read_bytes(self._entry(len(self.entries))))
            except (FileNotFoundError, OSError):
                return
            self.entries.append(files)
            self.seen.update((p, t) for p, t in files)

    def _append(self, files: list[list]) -> None:
        """A new entry; where another query was faster, its entry holds instead."""
        path, body = self._entry(len(self.entries)), json.dumps(files).encode()
        far = _remote(path)
        if far is not None:
            far[0].create_dir(os.path.dirname(far[1]), recursive=True)
            with far[0].open_output_stream(far[1]) as f:
                f.write(body)
            return
        os.makedirs(self.log, exist_ok=True)
        tmp = f"{self.log}/.{os.getpid()}-{os.urandom(4).hex()}"
        with open(tmp, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, path)  # whole, and only if there is none
        except FileExistsError:
            pass
        finally:
            os.unlink(tmp)

    def latestOffset(self) -> dict:
        self._catch_up()
        new = []
        for p in listing(self.pattern):
            try:
                t = stat(p)[1]
            except FileNotFoundError:
                continue  # gone since it was listed
            if (p, t) not in self.seen:
                new.append([p, t])
        if new:
            self._append(sorted(new, key=lambda f: (f[1], f[0]))[: self.most])
            self._catch_up()
        return {"n": len(self.entries)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._catch_up()
        return [FileRange(p) for files in self.entries[start["n"] : end["n"]] for p, _ in files]

    def read(self, part: FileRange) -> Iterator[tuple]:
        yield from read_range(self.fmt, part.path, start_us=self.window[0], end_us=self.window[1])

    def commit(self, end: dict) -> None:
        pass


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WaveformReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PacketStream(self.options)


def read_data(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    """Waveform files as pieces, one row per contiguous piece."""
    spark.dataSource.register(WaveformSource)
    r = spark.read.format("waveform").option("fmt", fmt)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def scan(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    """Path, id, npts, ngaps, nfs of each file's channels from headers alone: no sample is decoded.

    A gap is a record that begins more than half a step off the end of the one before it in the file's time order.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tremolite.timeaxis import delta_us

    h = read_data(spark, path, fmt, headers="true", **options).select("path", "id", "fs", "t0_us", "n", delta_us("fs").alias("_d"))
    w = Window.partitionBy("path", "id", F.expr("t0_us div 3600000000")).orderBy("t0_us")
    end = F.col("t0_us") + F.col("n") * F.col("_d")
    # a record is held against the one before it in its hour, an hour's first against the latest end of the hours before
    h = h.withColumn("_h", F.expr("t0_us div 3600000000")).withColumn("_p", F.lag(end).over(w))
    hours = h.groupBy("path", "id", "_h").agg(F.max(end).alias("_e"))
    before = Window.partitionBy("path", "id").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("path", "id", "_h", F.max("_e").over(before).alias("_c"))
    off = F.col("t0_us") - F.coalesce("_p", "_c")
    gap = F.coalesce((F.abs(off) * 2 > F.col("_d")).cast("long"), F.lit(0))
    return h.join(hours, ["path", "id", "_h"]).withColumn("_gap", gap).groupBy("path", "id").agg(F.sum("n").alias("npts"), F.sum("_gap").alias("ngaps"), F.countDistinct("fs").alias("nfs"))


def write_sac(pieces: DataFrame, folder: str) -> DataFrame:
    """K3: one SAC file per regular piece in a folder that all executors share; gives (path, samples).

    Files are written under a temporary name and renamed, so a repeated task leaves whole files.
    """
    def run(batches):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if not r.get("fs") or r["fs"] <= 0:
                    continue
                p = formats.piece(**{k: r.get(k) for k in formats.COLUMNS if k not in ("n", "misc")}, n=None)
                path = os.path.join(folder, formats.sac_name(p))
                tmp = f"{path}.{os.getpid()}"
                with open(tmp, "wb") as f:
                    f.write(formats.sac_write(p))
                os.replace(tmp, path)
                out.append((path, len(p["x"])))
            yield pd.DataFrame(out, columns=["path", "samples"])

    return pieces.drop("misc").mapInPandas(run, "path string, samples bigint")


def guess_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and format of files, from their first 16 kB."""
    import pandas as pd

    names = listing(pattern)

    def run(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                out.append((p, formats.guess(read_bytes(p, 0, 16384), p)))
            yield pd.DataFrame(out, columns=["path", "format"])

    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), 1000))).mapInPandas(run, "path string, format string")
