"""Problem 2: schemas that drift between files.

Every file gets a versioned schema fingerprint; the steps from one file of a producer to the
next (added, removed, renamed, retyped) are explicit rows; records are then routed through the
chained rename, default and cast rules of all later steps into one consistent table.

Records are exploded into (file, channel, field, type, value), parsed once by an Arrow kernel (JSON types have to be told
apart, for which built-in functions parse a record several times over); everything after that is equi-joins and
pre-aggregated counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolite.session import spread, stored

#: A gone and a new field are one renamed field if at least this share of the channels that hold both agree.
RENAME_SHARE = 0.6
#: ... and at least this many channels agree.
RENAME_LEAST = 2
GROUPS = ("loc", "resp", "misc")


def _kind(v) -> str | None:
    """The JSON type of a value, null's being None."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(v)]


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def fields_of(records: DataFrame) -> DataFrame:
    """line_id, file_id, id, field ('group.key'), kind (JSON type), value (text; null for JSON null).

    Nested and flat layouts give the same rows.  Broken lines, and lines that are no object,
    give none; keys outside the groups are ignored; of a key given twice the last value counts.
    """
    flat = tuple(f"{g}." for g in GROUPS)
    dump = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids, fields, kinds, values = [], [], [], [], []
            for n, raw in enumerate(b.column(2).to_pylist()):
                try:
                    m = json.loads(raw, parse_constant=_constant) if raw else None
                except (ValueError, RecursionError):
                    continue
                if type(m) is not dict:
                    continue
                who = m.get("id")
                who = who if who is None or isinstance(who, str) else dump(who)
                for k, v in m.items():
                    if k in GROUPS:
                        inner = [(f"{k}.{q}", w) for q, w in v.items()] if type(v) is dict else ()
                    else:
                        inner = ((k, v),) if k.startswith(flat) else ()
                    for f, w in inner:
                        row.append(n)
                        ids.append(who)
                        fields.append(f)
                        kinds.append(_kind(w))
                        values.append(w if w is None or isinstance(w, str) else dump(w))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(ids, pa.string()), pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["line_id", "file_id", "id", "field", "kind", "value"])

    kept = records.select("line_id", "file_id", "raw")
    one, two = (kept.schema[c].dataType.simpleString() for c in ("line_id", "file_id"))
    return spread(kept).mapInArrow(run, f"line_id {one}, file_id {two}, id string, field string, kind string, value string")


def plain_value(value, kind):
    """A value without its wrapping, for comparison: ['x'], {"value": 'x'} and 'x' are the same, as are 1, 1.0 and '1'."""
    s = F.regexp_replace(value, r'[\[\]{}"\s]|"?(?:value|items)"?:', "")
    n = s.try_cast("double") if hasattr(s, "try_cast") else F.expr("null")
    return F.when(F.lower(s).isin("", "n/a", "null", "none"), None).otherwise(F.coalesce(n.cast("string"), F.lower(s)))


def hashed(fields: DataFrame) -> DataFrame:
    """file_id, channel, field, kind, v: fields with 64-bit hashes of their channel and plain value."""
    plain = plain_value(F.col("value"), F.col("kind"))
    return fields.select("file_id", F.when(F.col("id").isNotNull(), F.xxhash64("id")).alias("channel"), "field", "kind", F.when(plain.isNotNull(), F.xxhash64(plain)).alias("v"))


def values_of(records: DataFrame) -> DataFrame:
    """``hashed`` of every non-null field of all records.

    Records are parsed once: the narrow table is stored, and everything else is made from it.
    """
    return stored(hashed(fields_of(records).where(F.col("kind").isNotNull())))


def file_fields(values: DataFrame) -> DataFrame:
    """file_id, field, kind (the JSON type of most values), n (records that hold it non-null).

    Ties between types go to the one first in the alphabet.
    """
    n = values.groupBy("file_id", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("file_id", "field").agg(F.max_by("kind", F.struct("n", _inverse("kind"))).alias("kind"), F.sum("n").alias("n"))


def _inverse(kind: str):
    """An order in which the alphabet's first type is the largest."""
    return -F.ascii(F.col(kind)) * 1000 - F.ascii(F.substring(kind, 2, 1))


def file_chain(files: DataFrame) -> DataFrame:
    """file_id, producer, seq (1, 2, ... by written, then file_id), prev_file, next_file."""
    w = Window.partitionBy("producer").orderBy("written", "file_id")
    return files.select(
        "file_id", "producer", F.row_number().over(w).alias("seq"), F.lag("file_id").over(w).alias("prev_file"), F.lead("file_id").over(w).alias("next_file")
    )


def fingerprints(records: DataFrame, files: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """file_id, producer, seq, fingerprint (of the sorted fields and types), version (counts changes), n_fields."""
    ff = file_fields(values_of(records) if values is None else values).groupBy("file_id").agg(
        F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "field", "kind")))), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_fields")
    )
    w = Window.partitionBy("producer").orderBy("seq")
    j = file_chain(files).join(ff, "file_id", "left").withColumn("_c", (~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))).cast("int"))
    return j.select("file_id", "producer", "seq", "fingerprint", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def changes(records: DataFrame, files: DataFrame, share: float = RENAME_SHARE, least: int = RENAME_LEAST, values: DataFrame | None = None) -> DataFrame:
    """file_id, change_kind, field, new_field, old_type, new_type: what changed since the producer's previous file.

    change_kind is 'added', 'removed', 'renamed' (field old, new_field new) or 'retyped'.  A renamed
    field whose type changes as well is one 'renamed' row.  A producer's first file has no changes.
    A file without readable records has removed everything.
    """
    values = values_of(records) if values is None else values
    # both narrow and used several times
    chain, ff = stored(file_chain(files)), stored(file_fields(values))
    now = ff.join(chain.where(F.col("prev_file").isNotNull()).select("file_id"), "file_id").select("file_id", "field", F.col("kind").alias("new_type"))
    was = ff.join(chain.where(F.col("next_file").isNotNull()).select("file_id", "next_file"), "file_id").select(F.col("next_file").alias("file_id"), "field", F.col("kind").alias("old_type"))
    d = was.join(now, ["file_id", "field"], "full").where(~F.col("old_type").eqNullSafe(F.col("new_type")))
    gone = d.where(F.col("new_type").isNull()).select("file_id", F.col("field").alias("old"))
    new = d.where(F.col("old_type").isNull()).select("file_id", F.col("field").alias("new"))
    # values of gone and new fields, channel by channel
    vals = values.where(F.col("channel").isNotNull() & F.col("v").isNotNull()).select("file_id", "channel", "field", "v")
    nxt = chain.select("file_id", "next_file").where(F.col("next_file").isNotNull())
    # only the values of gone and new fields go on, one per channel
    was_gone = gone.join(nxt.withColumnRenamed("file_id", "_was").withColumnRenamed("next_file", "file_id"), "file_id").select("file_id", "old", F.col("_was"))
    old_v = vals.withColumnRenamed("file_id", "_was").withColumnRenamed("field", "old").join(was_gone, ["_was", "old"]).groupBy("file_id", "channel", "old").agg(F.min("v").alias("old_v"))
    new_v = vals.withColumnRenamed("field", "new").join(new, ["file_id", "new"]).groupBy("file_id", "channel", "new").agg(F.min("v").alias("new_v"))
    pairs = old_v.join(new_v, ["file_id", "channel"]).groupBy("file_id", "old", "new").agg(
        F.count(F.lit(1)).alias("both"), F.sum((F.col("old_v") == F.col("new_v")).cast("long")).alias("same")
    )
    pairs = pairs.where((F.col("same") >= least) & (F.col("same") >= share * F.col("both")))
    order = [F.desc(F.col("same") / F.col("both")), F.desc("same"), "old", "new"]
    best = pairs.withColumn("ro", F.row_number().over(Window.partitionBy("file_id", "old").orderBy(*order))).withColumn(
        "rn", F.row_number().over(Window.partitionBy("file_id", "new").orderBy(*order))
    )
    ren = best.where((F.col("ro") == 1) & (F.col("rn") == 1)).select("file_id", "old", "new")
    d = d.join(ren.select("file_id", F.col("old").alias("field"), F.col("new").alias("to")), ["file_id", "field"], "left")
    d = d.join(ren.select("file_id", F.col("new").alias("field"), F.col("old").alias("from")), ["file_id", "field"], "left")
    to_type = now.select("file_id", F.col("field").alias("to"), F.col("new_type").alias("to_type"))
    d = d.where(F.col("from").isNull()).join(to_type, ["file_id", "to"], "left")
    kind = F.when(F.col("to").isNotNull(), "renamed").when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("retyped")
    return d.select("file_id", kind.alias("change_kind"), "field", F.coalesce("to", F.lit("")).alias("new_field"), "old_type", F.coalesce("to_type", "new_type").alias("new_type"))


def chained(renames: pd.DataFrame) -> pd.DataFrame:
    """field, lo, hi, canonical, steps: what a producer's renames (seq, field, new_field) make of a field's name in its files lo to hi - 1.

    From the last file backwards: before a rename its old name stands for whatever the new name stands for after it.
    """
    stands: dict[str, tuple[str, int]] = {}
    rows: list[list] = []
    since: dict[str, list] = {}
    for seq, g in sorted(renames.groupby("seq"), reverse=True):
        new = {a: (stands.get(b, (b, 0))[0], stands.get(b, (b, 0))[1] + 1) for a, b in zip(g["field"], g["new_field"])}
        for a, (c, n) in new.items():
            if a in since:
                since[a][1] = int(seq)
            since[a] = [a, 0, int(seq), c, n]
            rows.append(since[a])
        stands |= new
    return pd.DataFrame(rows, columns=["field", "lo", "hi", "canonical", "steps"])


def migration_rules(changed: DataFrame, fields: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, field, canonical (name in the producer's last file that has it), target (its type there), steps.

    Only a producer's renames are chained in one place; files and fields are joined to what comes of them.
    """
    chain = stored(file_chain(files)).select("file_id", "producer", "seq")
    ren = changed.where(F.col("change_kind") == "renamed").join(chain, "file_id").select("producer", "seq", "field", "new_field")
    kind = files.schema["producer"].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out = chained(g)
        out.insert(0, "producer", g["producer"].iloc[0])
        return out

    # a null producer is a producer like any other
    rules = ren.groupBy("producer").applyInPandas(one, f"producer {kind}, field string, lo bigint, hi bigint, canonical string, steps int").select(F.struct("producer").alias("_p"), F.col("field").alias("_f"), "lo", "hi", "canonical", "steps")
    have = fields.join(chain, "file_id").select("file_id", "field", "kind", "seq", F.struct("producer").alias("_q"))
    on = (F.col("_p") == F.col("_q")) & (F.col("_f") == F.col("field")) & (F.col("seq") >= F.col("lo")) & (F.col("seq") < F.col("hi"))
    named = have.join(rules, on, "left").select("file_id", "field", "kind", "seq", "_q", F.coalesce("canonical", "field").alias("canonical"), F.coalesce("steps", F.lit(0)).alias("steps"))
    last = named.where(F.col("field") == F.col("canonical")).groupBy(F.col("_q").alias("_r"), F.col("canonical").alias("_c")).agg(F.max_by("kind", "seq").alias("target"))
    j = named.join(last, (F.col("_q") == F.col("_r")) & (F.col("canonical") == F.col("_c")), "left")
    return j.select("file_id", "field", "canonical", F.coalesce("target", F.lit("string")).alias("target"), "steps")


def routed(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """fields with canonical, target and v, the value cast by the rules: numbers as numbers' text, a single value where an array or
    object of one was delivered, null where a cast is impossible."""
    f = fields.join(rules, ["file_id", "field"])
    # a list of one or a wrapped value becomes the bare value where the target is a scalar, and is kept otherwise
    bare = F.regexp_replace("value", r'^[\[{](?:"(?:value|items)":)?"?([^,"\[\]{}]*)"?[\]}]$', "$1")
    v = F.when(F.col("target") == "number", bare.try_cast("double").cast("string")).when(F.col("target").isin("string", "boolean"), bare).otherwise(F.col("value"))
    return f.withColumn("v", v)


def _parsed(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields of records, hashed values, rules), all from one parse, whose rows are stored."""
    f = stored(fields_of(records).where(F.col("kind").isNotNull()))
    values = hashed(f)
    return f, values, migration_rules(changes(records, files, values=values), file_fields(values), files)


def consistent_table(records: DataFrame, files: DataFrame) -> DataFrame:
    """line_id, file_id, producer, version, id, loc, resp, misc: all readable records in one schema.

    The maps hold canonical field names and values as ``routed``.  Where two fields of a line have one canonical name, a value that could be
    cast goes before none, then the field that has that name itself, then the first in the alphabet; ``losses`` reports what gives way.
    """
    fields, values, rules = _parsed(records, files)
    f = routed(fields, rules)
    f = f.select("line_id", "file_id", "id", "field", "canonical", F.split_part("canonical", F.lit("."), F.lit(1)).alias("g"), F.regexp_replace("canonical", r"^[^.]*\.", "").alias("k"), "v")
    ent = lambda g: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("g") == g, F.struct("k", "v")))))
    f = f.groupBy("line_id", "file_id", "id", "g", "k").agg(F.min(_order()).alias("_m")).withColumn("v", F.col("_m.v"))
    wide = f.groupBy("line_id", "file_id", "id").agg(*[ent(g).alias(g) for g in GROUPS])
    return wide.join(fingerprints(records, files, values).select("file_id", "producer", "version"), "file_id").select("line_id", "file_id", "producer", "version", "id", *GROUPS)


def _order():
    """Values of one canonical field of a line in order of precedence."""
    return F.struct(F.col("v").isNull().alias("a"), (F.col("field") != F.col("canonical")).alias("b"), "field", "v")


def losses(records: DataFrame, files: DataFrame) -> DataFrame:
    """line_id, file_id, field, canonical, loss, value: every value that ``consistent_table`` couldn't keep as it came.

    loss is 'cast' (the text can't be cast to the canonical type; the table holds null unless another field has a value) or
    'collision' (another field of the line has the same canonical name, with another value, and goes before this one).
    """
    fields, _, rules = _parsed(records, files)
    f = routed(fields, rules).withColumn("_o", _order())
    best = f.groupBy(F.col("line_id").alias("_l"), F.col("canonical").alias("_c")).agg(F.min("_o").alias("_best"))
    j = f.join(best, (F.col("line_id") == F.col("_l")) & (F.col("canonical") == F.col("_c")))
    loss = F.when(F.col("v").isNull(), "cast").when(~F.col("v").eqNullSafe(F.col("_best.v")), "collision")
    return j.withColumn("loss", loss).where(F.col("loss").isNotNull()).select("line_id", "file_id", "field", "canonical", "loss", "value")
