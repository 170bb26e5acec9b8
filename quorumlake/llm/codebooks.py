"""Vector codes: a codebook for each part of a vector, in integers, with partial-distance search for the nearest entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.runtime import broadcast_if_small, free_name, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 13  # of a component's size
ROWS = 1 << 13  # vectors that a search handles at once


def whole(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null for null vectors and those with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def bounds(d: int, parts: int) -> list[int]:
    """Where each part starts, and the end; parts are equal if ``parts`` divides ``d``, else they differ by one."""
    return [k * d // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index on ties.

    Entries are tried in turn. Each adds its dimensions in descending variance of the codebook, and a row leaves as soon
    as what it has so far exceeds its best complete distance.
    """
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    columns = [np.ascontiguousarray(x[:, k]) for k in order]
    index = np.zeros(len(x), dtype=np.int64)
    best = sum(((c - book[0, k]) ** 2 for c, k in zip(columns, order, strict=True)), np.zeros(len(x), dtype=np.int64))
    for entry in range(1, len(book)):
        rows, so_far = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for c, k in zip(columns, order, strict=True):
            so_far = so_far + (c[rows] - book[entry, k]) ** 2
            near = so_far <= best[rows]
            rows, so_far = rows[near], so_far[near]
            if not len(rows):
                break
        closer = so_far < best[rows]
        index[rows[closer]], best[rows[closer]] = entry, so_far[closer]
    return index, best


def _vectors(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row matrices of a batch of vectors of one length."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    for lo in range(0, len(flat), ROWS):
        yield lo, flat[lo : lo + ROWS]


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], at: list[int]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: (part, entry, place, total, n) of what each entry has drawn."""
    total = [np.zeros_like(b) for b in books]
    count = [np.zeros(len(b), dtype=np.int64) for b in books]
    for batch in batches:
        for _, x in _vectors(batch, at[-1]):
            for k, book in enumerate(books):
                part = x[:, at[k] : at[k + 1]]
                index, _ = nearest(part, book)
                np.add.at(total[k], index, part)
                count[k] += np.bincount(index, minlength=len(book))
    rows = [(k, e, j, int(total[k][e, j]), int(count[k][e])) for k, b in enumerate(books) for e in range(len(b)) if count[k][e] for j in range(b.shape[1])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "entry", "place", "total", "n"])


def train(vectors: DataFrame, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of each part after ``rounds`` assignments, from the parts of ``first``; unused entries stay.

    Sums and counts are exact integers: each task sums what it holds, the shuffle adds up parts x entries x places
    numbers a task, and the driver gets as many, whatever the number of vectors.
    """
    at = bounds(len(first[0]), parts)
    books = [np.array([v[at[k] : at[k + 1]] for v in first], dtype=np.int64).reshape(len(first), at[k + 1] - at[k]) for k in range(parts)]
    for _ in range(rounds):
        now = [b.copy() for b in books]
        found = vectors.select("v").mapInArrow(lambda b, now=now: _sums(b, now, at), "part int, entry int, place int, total long, n long")
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row for each row of ``df`` with a usable vector.

    Rows go whose vector is null, holds a null or a component that isn't finite, or is not as long as that of the smallest
    kept vec_id. Null ids come last; of equal ids the smaller vector is first. With fewer than ``entries`` rows the
    codebooks have as many entries as there are rows. Repeated rows count each. An empty table gives no rows. Components
    of LARGEST or more in size raise an error, as 64-bit sums would not hold their squares; below it, vectors of 2^8
    places and tables of 2^37 rows are exact. Other columns are left out.
    Labels' sums are joined back, so a label with a third of all rows costs one row a task; null labels are one label.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector)).alias("v")).filter("v IS NOT NULL")
    rows = materialize(rows, "vectors")
    if rows.filter(F.exists("v", lambda x: F.abs(x) >= LARGEST * SCALE)).limit(1).count():
        raise ValueError(f"components of {LARGEST} or more can't be coded exactly")
    order = (F.col("vec_id").asc_nulls_last(), F.col("v").asc())
    first = [list(r[0]) for r in rows.orderBy(*order).select("v").limit(1).collect()]
    d = len(first[0]) if first else 0
    rows = rows.filter(F.size("v") == d)
    first = [list(r[0]) for r in rows.orderBy(*order).select("v").limit(entries).collect()]
    books = train(rows, first, parts, rounds) if first else []
    at = bounds(d, parts)
    kind = rows.select("vec_id", "label").dtypes

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, errors = [], [np.zeros(0, dtype=np.int64)]
            for _, x in _vectors(batch, d):
                found = [nearest(x[:, at[k] : at[k + 1]], book) for k, book in enumerate(books)]
                text += [f.hex() for f in map(bytes, np.stack([i for i, _ in found], axis=1).astype(np.uint8))]
                errors.append(sum(e for _, e in found))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(np.concatenate(errors))], names=["vec_id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(codes, f"vec_id {kind[0][1]}, label {kind[1][1]}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias(free_name("group", coded))).agg(F.sum("error").alias("label_error"))
    group = sums.columns[0]
    out = coded.join(broadcast_if_small(sums, 32), coded["label"].eqNullSafe(sums[group]))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op13_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _round(k: int) -> str:
    """SQL of one round: the nearest entry of each part, then the entries' means."""
    return f"""
d{k} AS (SELECT vec_id, part, entry, v, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM parts JOIN b{k} USING (part)),
n{k} AS (SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist, any_value(v) AS v FROM d{k} GROUP BY vec_id, part)"""


def _means(k: int) -> str:
    return f"""
u{k} AS (SELECT part, entry, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
        FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM n{k}) GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM u{k} GROUP BY part, entry),
b{k + 1} AS (SELECT b{k}.part, b{k}.entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, k AS part, v[k * (len(v) // {PARTS}) + 1 : (k + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(k)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{",".join(_round(k).replace(f"d{k} AS (", f"d{k} AS MATERIALIZED (", 1) + "," + _means(k) for k in range(ROUNDS))},
{_round(ROUNDS)},
codes AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY vec_id),
e AS (SELECT vec_id, label, code, error FROM codes JOIN kept USING (vec_id)),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""
