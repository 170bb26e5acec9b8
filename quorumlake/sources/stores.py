"""Append-only stores: scans, guarded appends, views.

A store is a folder of JSON lines (landing) or Parquet. Appends are one Spark write job each, so a failed task leaves no
half-written record; a store has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from quorumlake.operators.ordering import numbered
from quorumlake.runtime import materialize
from quorumlake.sources.schemas import EVALUATION, GENERATION, struct

EVALUATION_KEY = ["generation_cache_key", "evaluator_id", "evaluator_version"]


class DuplicateKeys(ValueError):
    """An append would add a second record under a key."""


class BrokenRecords(ValueError):
    """A log holds lines that are no records, more of them than allowed."""


PLACE = ["_file", "_block", "_row"]  # of a line: file, start of the part of the file that a task reads, number in it


def lines(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str] | None = None) -> DataFrame:
    """Every line of a JSON log that isn't blank, with its place, and what is wrong with it in ``_problem`` (null: nothing).

    A line is 'unreadable' if it is no JSON object or a field has a value of another type, and has 'no key' if a required field
    (the schema's first, if none are named) is absent or null. ``_text`` holds the line where there is a problem. A missing
    path is an empty log. ``PLACE`` orders lines as they stand in their files.
    """
    schema = struct(schema)
    required = schema.names[:1] if required is None else required
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(n, k) for n, k in (("_file", T.StringType()), ("_block", T.LongType()), ("_row", T.LongType()), ("_problem", T.StringType()), ("_text", T.StringType()))]]))
    placed = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")).filter(F.col("value").rlike(r"\S"))
    parsed = placed.withColumn("_r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.exists(F.array(*[F.col("_r")[k].isNull() for k in required]), lambda x: x) if required else F.lit(False)
    problem = F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "unreadable").when(missing, "no key")
    return parsed.withColumn("_problem", problem).select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields], *PLACE, "_problem", F.when(F.col("_problem").isNotNull(), F.col("value")).alias("_text"))


def quarantine(found: DataFrame) -> DataFrame:
    """Problems of ``lines``: file, block, row, problem and text of each."""
    return found.filter("_problem IS NOT NULL").select(*PLACE, "_problem", "_text")


def sound(found: DataFrame, most: int = 0) -> DataFrame:
    """The records of ``lines``, after a look at all of them: more than ``most`` problems are an error that tells where the first are."""
    bad = quarantine(found)
    if (n := bad.count()) > most:
        where = "; ".join(f"{r['_file']} from byte {r['_block']}: {r['_problem']}: {r['_text'][:80]!r}" for r in bad.orderBy(*PLACE).limit(3).collect())
        raise BrokenRecords(f"{n} broken lines, {most} allowed: {where}")
    return found.filter("_problem IS NULL").drop(*PLACE, "_problem", "_text")


def scan(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json", strict: bool = True) -> DataFrame:
    """All records; a missing path is an empty store. Absent optional fields are null; blank lines are skipped.

    A JSON line that is cut off, that has a value of another type in a field that is read, or whose first field is absent stops
    the job that reads it; if not ``strict`` such lines are left out: see ``lines`` and ``sound`` for what they are and how many.
    A line that begins with an empty JSON array holds no record for the reader, which passes over it; ``lines`` tells of it too.
    """
    schema = struct(schema)
    if kind == "json" and not strict:
        return lines(spark, path, schema).filter("_problem IS NULL").select(schema.names)
    try:
        reader = spark.read.schema(schema)
        found = (reader.option("mode", "FAILFAST") if kind == "json" else reader).format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if kind != "json":
        return found
    key = schema.names[0]
    return found.filter(F.when(F.col(key).isNotNull(), True).otherwise(F.raise_error(F.lit(f"broken line in {path}: no {key}")).cast("boolean")))


def generations(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return scan(spark, path, GENERATION, kind)


def evaluations(spark: SparkSession, path: str, evaluator_ids: list[str] | None = None, kind: str = "json") -> DataFrame:
    found = scan(spark, path, EVALUATION, kind)
    return found.filter(F.col("evaluator_id").isin(evaluator_ids)) if evaluator_ids is not None else found


def present(keys: DataFrame, store: DataFrame, on: list[str]) -> DataFrame:
    """The keys that the store has."""
    return keys.join(store.select(on).distinct(), on, "left_semi")


def unseen(rows: DataFrame, store: DataFrame, on: list[str]) -> DataFrame:
    """The rows, one a key, whose key the store doesn't have."""
    return rows.dropDuplicates(on).join(store.select(on), on, "left_anti")


def append_exclusive(rows: DataFrame, path: str, schema: str | T.StructType, on: list[str], force: bool = False, kind: str = "json") -> None:
    """Append, or raise if a key is there already or twice among the rows, unless forced."""
    if not force:
        store = scan(rows.sparkSession, path, schema, kind)
        twice = rows.groupBy(on).count().filter("count > 1").select(on).unionByName(present(rows.select(on), store, on))
        if found := twice.limit(3).collect():
            raise DuplicateKeys(f"keys are in the store or repeated: {found}")
    rows.write.mode("append").format(kind).save(path)


def append_idempotent(rows: DataFrame, path: str, schema: str | T.StructType = EVALUATION, on: list[str] | None = None, kind: str = "json") -> int:
    """Append the rows with new keys and tell how many there were. A repeat within the batch counts once."""
    on = on or EVALUATION_KEY
    new = unseen(rows, scan(rows.sparkSession, path, schema, kind), on).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").format(kind).save(path)
        return n
    finally:
        new.unpersist()


def last_wins(rows: DataFrame, on: list[str], *order: str) -> DataFrame:
    """One row a key: the one that comes last by ``order``, of ties the one read last. Spark reads the largest file first, so
    where the order of appends decides, it has to be a column: see ``last_lines`` and ``sources.logs``. Only ``order`` is
    compared, so any column type goes; partial aggregates do most of the work."""
    rest = [c for c in rows.columns if c not in on]
    seq = F.monotonically_increasing_id()
    top = F.max_by(F.struct(*rest), F.struct(*order, "_seq")).alias("_top")
    return rows.withColumn("_seq", seq).groupBy(on).agg(top).select(*on, *[F.col("_top")[c].alias(c) for c in rest]).select(rows.columns)


def last_lines(*logs: DataFrame, on: list[str]) -> DataFrame:
    """One record a key of several logs read by ``lines``: of the last log that has it, the last line. A log of several files goes by their names."""
    out = None
    for k, log in enumerate(logs):
        rows = log.filter("_problem IS NULL").withColumn("_log", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return last_wins(out.drop("_problem", "_text"), on, "_log", *PLACE).drop("_log", *PLACE)


def union(*stores: DataFrame) -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def summary(store: DataFrame) -> DataFrame:
    return store.groupBy("evaluator_id").agg(F.count("*").alias("n"))


def answer_view(store: DataFrame, answer: DataFrame) -> DataFrame:
    """The store with raw_text replaced by the derived answer_text of the same key."""
    return store.join(answer.select("cache_key", "answer_text"), "cache_key", "left").withColumn("raw_text", F.coalesce("answer_text", "raw_text")).select(store.columns)


def labels_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A sheet of strings: quoted cells over several lines, empty cells as '', NA and null as text, a mark before the header dropped."""
    schema = struct(schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)
    return raw.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema.fields])


def require_header(spark: SparkSession, path: str, schema: str | T.StructType) -> None:
    head = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    head = [head[0].removeprefix("\ufeff"), *head[1:]]
    if head != struct(schema).names:
        raise ValueError(f"columns are {head}, not {struct(schema).names}")


def prompt_lists(spark: SparkSession, path: str) -> DataFrame:
    """(key, position, prompt) of a JSON object of lists."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return text.select(F.explode(parsed).alias("key", "prompts")).select("key", F.posexplode("prompts").alias("position", "prompt"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest over the files' names and digests in the order of names."""
    rows = file_digests(spark, path)
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda r: F.concat_ws(":", r["name"], r["sha256"])), "\n"), 256)).first()[0]


def sheet_digest(rows: DataFrame, columns: tuple[str, ...] = ("sample_id", "statement", "response"), *order: str) -> str:
    """SHA-256 over the sheet's rows in order, each as a JSON list of its texts. Rows come one by one; for sheets that people fill in."""
    digest = hashlib.sha256()
    for r in (rows.orderBy(*order) if order else rows).select(*columns).toLocalIterator():
        digest.update(json.dumps(list(r)).encode())
    return digest.hexdigest()


def tree_digest(rows: DataFrame, keys: list[str], row: str, branches: int = 1024, levels: int | None = None) -> str:
    """One digest of a table of any size from its rows' digests in column ``row``, in the order of keys and digests.

    Digests are numbered, and ``branches`` successive ones are hashed into one, until one is left. An empty table has the digest
    of no text. It doesn't depend on files or partitions; equal rows count each. ``levels`` is for formats of a fixed depth: the
    greatest digest of that level stands for all, so a table of more than ``branches ** levels`` rows may change without it.
    """
    level = numbered(rows.select(*keys, row), *keys, row, name="i", start=0).select("i", F.col(row).alias("h"))
    for depth in count(1):
        at = F.floor(F.col("i") / branches)
        merged = level.groupBy(at.alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("parts"))
        level = materialize(merged.select("i", F.sha2(F.array_join(F.transform("parts", lambda p: p["h"]), "\n"), 256).alias("h")), "digests")
        left = level.limit(2).collect()
        if len(left) < 2:
            return left[0]["h"] if left else hashlib.sha256(b"").hexdigest()
        if depth == levels:
            return level.agg(F.max("h")).first()[0]


def item_bank(spark: SparkSession, path: str, label: str = "topic_label_human", first: int | None = None) -> DataFrame:
    """Rows of the item bank whose label isn't the text 'na', in file order; the first n of them if asked."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "ordinal": F.monotonically_increasing_id()})  # a file of several lines a row is read whole
    kept = rows.filter(F.coalesce(F.col(label), F.lit("")) != "na")
    return kept.orderBy("file", "ordinal").limit(first).drop("file") if first is not None else kept.drop("file")


def row_numbers(rows: DataFrame, *order: str) -> DataFrame:
    return numbered(rows, *order)
