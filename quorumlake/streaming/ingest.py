"""Incremental ingest of response logs: only unseen keys reach the store, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from quorumlake.sources.logs import Log
from quorumlake.sources.stores import scan, unseen


def ingest(spark: SparkSession, landing: str, store: str, schema: str | T.StructType, on: list[str], checkpoint: str) -> StreamingQuery:
    """Read new files of the landing folder and append the rows whose key the store lacks.

    The store is the state: a batch that runs again after a failure finds its keys there and adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        unseen(batch, scan(batch.sparkSession, store, schema, "parquet"), on).write.mode("append").parquet(store)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_log(spark: SparkSession, landing: str, log: str, schema: str | T.StructType, on: list[str], checkpoint: str, files: int | None = None, bucket_rows: int = 4096) -> StreamingQuery:
    """The same into a log with a manifest; ``files`` bounds the files of a batch.

    Each batch is one append under the name of the checkpoint and the batch's number. A batch that comes again after a failure is
    known by that name if it was committed, and is otherwise done as a whole: what it had written before has no commit and
    is never read. Keys are looked up in the log's index, so a batch opens the folders of its own keys, whatever the log holds;
    the stream itself keeps no state.
    """

    def add(batch: DataFrame, number: int) -> None:
        Log(batch.sparkSession, log, schema, on, bucket_rows).append_unseen(batch, f"{checkpoint}#{number}")

    source = spark.readStream.schema(schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return source.json(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
