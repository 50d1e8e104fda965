"""Notes (section 2.15): what was done to a channel, as rows of a notes table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates the parts of a note's text.
SEP = " ¦ "


def note(channels: DataFrame, text: str, at: Column | None = None, category: str = "note", call: str = "") -> DataFrame:
    """Rows for the channels whose id or name the text mentions, for all if it mentions none."""
    hit = F.lit(text).contains(F.col("id")) & (F.length("id") > 0) | F.coalesce(F.lit(text).contains(F.col("name")) & (F.length("name") > 0), F.lit(False))
    any_ = F.broadcast(channels.agg(F.coalesce(F.max(hit), F.lit(False)).alias("_any")))
    c = channels.join(any_, F.lit(True)).where(hit | ~F.col("_any"))
    return c.select("ch", (at if at is not None else F.current_timestamp()).alias("ts"), F.lit(category).alias("category"), F.lit(call).alias("call"), F.lit(text).alias("descr"))


def processed(channels: DataFrame, call: str, descr: str, at: Column | None = None) -> DataFrame:
    """Rows saying that an operator worked on channels."""
    return channels.select("ch", (at if at is not None else F.current_timestamp()).alias("ts"), F.lit("processing").alias("category"), F.lit(call).alias("call"), F.lit(descr).alias("descr"))


def text(notes: DataFrame) -> DataFrame:
    """ch, note: rows as delimited text, sorted."""
    return notes.select("ch", F.concat_ws(SEP, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "category", "call", "descr").alias("note")).orderBy("ch", "note")


def parse(lines: DataFrame) -> DataFrame:
    """Rows of delimited text notes (ch, note); text without delimiters is the description."""
    p = F.split("note", SEP)
    n = F.size(p)
    return lines.select("ch", F.try_to_timestamp(F.when(n > 1, p[0])).alias("ts"), F.when(n >= 4, p[1]).otherwise("note").alias("category"), F.when(n >= 4, p[2]).otherwise("").alias("call"), F.element_at(p, -1).alias("descr"))


def show(notes: DataFrame, category: str) -> DataFrame:
    """Notes of a category: 'processing', '+source' or 'write'."""
    return notes.where(F.col("category") == category).orderBy("ch", "ts")


def clear(notes: DataFrame, channels: DataFrame, at: Column | None = None) -> DataFrame:
    """Notes without those of channels, and one row for each saying so."""
    return notes.join(channels.select("ch"), "ch", "left_anti").unionByName(processed(channels, "clear_notes", "notes cleared", at))


def header_hash(channels: DataFrame, cols: tuple[str, ...] = ("id", "name", "fs", "gain", "units")) -> DataFrame:
    """ch, hash of header fields: what track_hdr compares."""
    return channels.select("ch", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]).alias("hash"))


def changed_sources(before: DataFrame, after: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows saying that the source of a channel changed, with the old and the new one (track_src); null counts as ''."""
    was = before.select("ch", F.coalesce("src", F.lit("")).alias("_was"))
    now = after.select("ch", F.coalesce("src", F.lit("")).alias("_now")).join(was, "ch", "left").where(~F.col("_now").eqNullSafe(F.col("_was")))
    return now.select("ch", (at if at is not None else F.current_timestamp()).alias("ts"), F.lit("+source").alias("category"), F.lit("track_src").alias("call"), F.concat(F.coalesce("_was", F.lit("")), F.lit(" -> "), F.col("_now")).alias("descr"))


def changed_headers(before: DataFrame, after: DataFrame, cols: tuple[str, ...] = ("id", "name", "fs", "gain", "units")) -> DataFrame:
    """Channels whose header fields differ from before, or that are new."""
    a = header_hash(before, cols).withColumnRenamed("hash", "_was")
    return header_hash(after, cols).join(a, "ch", "left").where(~F.col("hash").eqNullSafe(F.col("_was"))).select("ch")
