"""Session helpers shared by every operator: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is empty (unit tests, a laptop) a local temporary folder stands in.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = "spark.quorumlake.scratch"
    if not spark.conf.get(key, None):
        path = tempfile.mkdtemp(prefix="quorumlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(key, path)
    return spark.conf.get(key)


def materialize(df: DataFrame, label: str = "t", drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, sizes become known.

    The shuffle files of the write stay until the driver happens to collect its garbage, or go at its end (``drop_shuffles``).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing will read again; other tables are left alone."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("_scratch_path")
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, width: int, max_mb: int = 48) -> DataFrame:
    """Broadcast hint only if rows (counted) times ``width`` bytes stay below ``max_mb``; else left to a shuffle join."""
    limit = max_mb * 1_000_000 // width
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 26) -> None:
    """Keep Arrow batches of whole texts small, by rows and by bytes; a batch is held several times over by the JVM and by
    Python. The session's settings are lowered for good, as plans are lazy and read them when they run."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
