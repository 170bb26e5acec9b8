"""Jump consistent hashing of stable keys to shards (Lamping and Veach, 2014), without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quorumlake.runtime import materialize


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``n`` shards. Keys that have settled leave the loop."""
    out, todo, state = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), keys.astype(np.uint64)
    place = np.zeros(len(keys), dtype=np.int64)
    while len(todo):
        out[todo] = place
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        place = np.floor((place + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = place < n
        todo, state, place = todo[go], state[go], place[go]
    return out


def jump_shard(key: Column, n: int) -> Column:
    """Shard number of a long column of hashed keys."""

    @F.pandas_udf("int")
    def shards(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(jump(x.to_numpy(dtype=np.int64).view(np.uint64), n), dtype="int32")

    return shards(key)


def assign(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard, slot, grown_shard (with one shard more).

    The shard depends on the key's text form and the number of shards alone. A null key is a key of its
    own; a null text has no bytes (size 1, checksum 0); rows with one key share a shard and get slots of
    their own. An empty table gives an empty result; other columns are left out.

    Slots are gapless from 0 in each shard. They are numbered within (input split, shard), so no task ever
    sees a whole shard and a hot key is spread over the splits that hold it; the offsets of the splits come
    from a table of one row per split and shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(F.col(key).cast("string"))
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), hashed.alias("_key"), F.monotonically_increasing_id().alias("_at"))
    rows = materialize(rows.withColumns({"shard": jump_shard(F.col("_key"), n_shards), "grown_shard": jump_shard(F.col("_key"), n_shards + 1)}).withColumn("_split", F.shiftright("_at", 33)), "shards")
    held = rows.groupBy("shard", "_split").agg(F.count("*").alias("_rows"))
    offsets = held.withColumn("_offset", F.sum("_rows").over(W.partitionBy("shard").orderBy("_split").rowsBetween(W.unboundedPreceding, -1))).drop("_rows")
    own = F.row_number().over(W.partitionBy("shard", "_split").orderBy("_at")) - 1
    placed = rows.withColumn("_own", own).join(offsets, ["shard", "_split"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_own") + F.coalesce("_offset", F.lit(0))).cast("long").alias("slot"), "grown_shard")


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.withColumn("law", F.lit("key"))
