"""Small files around a study: model entries, evaluation curves, imports that are never replaced, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MODEL = "name string, family string, provider string, checkpoint string, revision string, architecture string, training_stage string, parent_checkpoint string, locked_anchor boolean, scientific_role string"
IMPORT = "artifact string, source_filename string, stored_as string, sha256 string, imported_utc string"


class FrozenFile(ValueError):
    """A file was imported already with other content."""


def model_registry(spark: SparkSession, folder: str, schema: str = MODEL) -> DataFrame:
    """One row per YAML file, named by the file's stem. Entries are parsed where they are read; absent fields are null.

    The last three fields keep their text; nested sections are left out.
    """
    import yaml

    names = [part.split()[0] for part in schema.split(", ")]
    rows = []
    for path, content in sorted(spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.yaml").select("path", "content").collect()):  # configuration: a few files
        entry = yaml.safe_load(bytes(content)) or {}
        entry["name"] = path.rsplit("/", 1)[-1].removesuffix(".yaml")
        rows.append(tuple(entry.get(n) for n in names))
    return spark.createDataFrame(rows, schema)


def registry_sections(spark: SparkSession, folder: str) -> DataFrame:
    """(name, entry) of the YAML files: whole entries, nested sections and all, as VARIANT; see ``nested``."""
    import json

    import yaml

    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.yaml").select("path", "content").collect()  # configuration: a few files
    rows = [(path.rsplit("/", 1)[-1].removesuffix(".yaml"), json.dumps(yaml.safe_load(bytes(content)) or {}, default=str)) for path, content in sorted(files)]
    return spark.createDataFrame(rows, "name string, entry string").select("name", F.parse_json("entry").alias("entry"))


def nested(value: Column, path: str, kind: str = "string") -> Column:
    """The field at a path such as ``$.license.tier`` or ``$.items[0].sku`` of a VARIANT; null if it is absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def metric(results: Column, field: str, key: str | None = None, prefix: str | None = None) -> Column:
    """A field of the result whose name starts with ``key``, or its mean over all names that start with ``prefix``."""
    values = F.map_values(F.map_filter(results, lambda k, _: k.startswith(key if prefix is None else prefix)))
    found = F.filter(F.transform(values, lambda v: v[field]), lambda x: x.isNotNull())
    if prefix is None:
        return F.get(found, F.lit(0))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found))


def eval_curves(spark: SparkSession, folder: str, tasks: dict[str, dict[str, str]]) -> DataFrame:
    """One row per checkpoint from ``folder/<checkpoint>/eval_<task>.json``: a column per task, and ``<task>_error``.

    A missing file gives a null and the error 'missing', a broken one 'unreadable'; neither stops the scan.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "eval_*.json").text(folder).select("value", F.input_file_name().alias("path"))
    parts = raw.select(F.regexp_extract("path", r"([^/]+)/eval_([^/]+)\.json$", 1).alias("checkpoint"), F.regexp_extract("path", r"/eval_([^/]+)\.json$", 1).alias("task"), F.from_json("value", "results map<string,map<string,double>>").alias("payload"))
    results = F.col("payload.results")
    per = parts.select("checkpoint", "task", results.isNull().alias("broken"), *[F.when(F.col("task") == t, metric(results, **how)).alias(t) for t, how in tasks.items()])
    out = per.groupBy("checkpoint").agg(*[F.max(t).alias(t) for t in tasks], *[F.max(F.when(F.col("task") == t, F.col("broken"))).alias(f"_{t}") for t in tasks])
    errors = [F.when(F.col(f"_{t}").isNull(), "missing").when(F.col(f"_{t}"), "unreadable").alias(f"{t}_error") for t in tasks]
    return out.select("checkpoint", F.regexp_extract("checkpoint", r"(\d+)$", 1).try_cast("int").alias("index"), *tasks, *errors)


def digest(spark: SparkSession, path: str) -> str | None:
    """The file's SHA-256, or null if there is none."""
    fs, at = at_path(spark, path)
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] if fs.exists(at) else None


def import_once(spark: SparkSession, artifact: str, source: str, target: str, log: str) -> bool:
    """Copy a sheet byte by byte and log its digest; the same content again is no work, other content is an error."""
    new, old = digest(spark, source), digest(spark, target)
    if new is None:
        raise FileNotFoundError(source)
    if old is not None:
        if old != new:
            raise FrozenFile(f"{target} has other content; imported files are never replaced")
        return False
    (fs_a, a), (fs_b, b) = at_path(spark, source), at_path(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, False, spark._jsc.hadoopConfiguration())
    stem = lambda p: p.rsplit("/", 1)[-1]
    row = spark.range(1).select(F.lit(artifact).alias("artifact"), F.lit(stem(source)).alias("source_filename"), F.lit(stem(target)).alias("stored_as"), F.lit(new).alias("sha256"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("imported_utc"))
    append_run(row, log)
    return True


def append_run(rows: DataFrame, log: str) -> None:
    """One JSON line per run."""
    rows.coalesce(1).write.mode("append").json(log)


def at_path(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of the session, for any store that Spark can open."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
