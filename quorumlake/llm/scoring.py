"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Texts are dealt to chunks; a chunk's distinct n-grams with their counts go, packed by range of hash, to the partitions of
the count table, which sum them and answer each chunk with what other chunks add; the chunk joins the answers to its
exploded n-grams and sums per document. Counts leave the scored document out, so that no text vouches for itself. An
n-gram of three words or more can stand in another document only if both n-grams of one word less do: only these are sent,
once the shorter ones are answered. Texts are shuffled once before and once after the answers are written: all later uses of
them share one exchange, and the files of the former go when the answers are written. (Rows of single n-grams,
about 40 bytes each for 6 to 7 bytes of text, would move several times the input an order; packed ranges move a sixth.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import U64, Prefix, binary, blocks, flat, framed, mix, pack_sorted, runs, space_table, unframed, unpack_sorted, words
from quorumlake.runtime import materialize, parallelism, small_batches

ALPHA, ORDER = 0.4, 3
CHUNK_BYTES, TABLE_ENTRIES = 12_000_000, 2_000_000
SENT = "bucket long, chunk long, n int, data binary"


def pack_small(values: np.ndarray) -> bytes:
    """A byte for each value; 255 stands for those in the list of large ones at the end."""
    large = values[values >= 255].astype(np.uint32)
    return framed(np.minimum(values, 255).astype(np.uint8).tobytes(), large.tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    small, large = unframed(data)
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.uint32)
    return out


class Chunk:
    """Words and n-grams of a chunk's texts, in the order of the texts' row hashes (equal ones are equal rows)."""

    def __init__(self, texts: pa.Table):
        texts = texts.combine_chunks()
        texts = texts.take(pa.array(np.argsort(texts["rid"].to_numpy(), kind="stable")))
        self.ids = texts["doc_id"]
        column = texts["text"].combine_chunks() if isinstance(texts["text"], pa.ChunkedArray) else texts["text"]
        data, offsets, _ = flat(column)
        prefix = Prefix(lower=True)
        start, end, self.row = words(data, offsets, space_table())
        self.words = prefix.of(prefix.sums(data), start, end) if len(start) else np.zeros(0, U64)
        self.rows = len(offsets) - 1
        self.length = np.bincount(self.row, minlength=self.rows)
        self.place = np.arange(len(self.row)) - (np.cumsum(self.length) - self.length)[self.row]

    def grams(self, n: int, shorter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last words of n-grams, and the n-grams' hashes. ``shorter``: counts in other texts by one word
        less; only n-grams of which both shorter ones stand there are looked at."""
        at = np.flatnonzero(self.place >= n - 1)
        if shorter is not None:
            at = at[(shorter[at] > 0) & (shorter[at - 1] > 0)]
        out = np.zeros(len(at), dtype=U64)
        for k in range(n - 1, -1, -1):
            out = out * U64(0xD1342543DE82EF95) + self.words[at - k]
        return at, mix(out + U64(n))

    def distinct(self, n: int, shorter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams to send, sorted, with their counts in the chunk."""
        return np.unique(self.grams(n, shorter)[1], return_counts=True)

    def others(self, n: int, extra: np.ndarray, shorter: np.ndarray | None = None) -> np.ndarray:
        """How often the n-gram that ends at each place stands in other texts; ``extra``: what other chunks add to each
        distinct one. 0 where a place has no such n-gram."""
        at, keys = self.grams(n, shorter)
        out = np.zeros(len(self.words), dtype=np.int64)
        if not len(at):
            return out
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        found = extra[which] + counts[which] - 1
        several = np.flatnonzero(counts[which] > 1)  # maybe in its own text again
        order = several[np.lexsort((which[several], self.row[at[several]]))]
        if len(order):
            k, r = which[order], self.row[at[order]]
            start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
            many = np.diff(np.append(start, len(order)))
            found[order] -= np.repeat(many, many) - 1
        out[at] = found
        return out


def received(answers: pa.Table, n: int) -> np.ndarray:
    """What other chunks add to each distinct n-gram of the chunk, in the n-grams' order."""
    picked = [(b, d) for b, k, d in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["data"].to_pylist(), strict=True) if k == n]
    return np.concatenate([np.zeros(0, np.int64), *[unpack_small(d) for _, d in sorted(picked)]])


def stupid_backoff(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log10_score (sum over words), log10_per_word (null without words).

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A word's score is the relative frequency
    of the longest n-gram that ends in it and stands in another row, times ``alpha`` for each shorter step from the
    longest that its place allows; a word seen nowhere else counts as one in all words of the other rows plus one, after
    all steps and one more. Null and empty texts have no words and score 0. Repeated rows count as other rows. An empty
    table gives an empty one; other columns are left out. Rows are known by a hash of id and text, so a task that runs
    again after a lost executor deals and orders them as before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separator, n, size = space_table(), 0, 0
        for batch in batches:
            for _, _, data, offsets, _ in blocks(batch.column(0)):
                n += len(words(data, offsets, separator)[0])
                size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["words", "bytes"])

    facts = base.select("text").mapInArrow(counted, "words long, bytes long").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).first()
    n_words, total = facts["words"] or 0, facts["bytes"] or 0
    n_chunks = max(parallelism(spark), math.ceil(total / CHUNK_BYTES))
    n_tables = max(parallelism(spark), math.ceil(order * total / 6 / TABLE_ENTRIES))
    by_chunk = base.withColumn("chunk", F.pmod("rid", F.lit(n_chunks))).groupBy("chunk")
    edges = np.array([(i << 64) // n_tables for i in range(1, n_tables)], dtype=U64)

    def sent(chunk: Chunk, me: int, orders: range, shorter: np.ndarray | None) -> pa.Table:
        where, sizes, data = [], [], []
        for n in orders:
            keys, counts = chunk.distinct(n, shorter)
            cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for i in np.flatnonzero(np.diff(cut)).tolist():
                where.append(i)
                sizes.append(n)
                data.append(framed(pack_sorted(keys[cut[i] : cut[i + 1]]), pack_small(counts[cut[i] : cut[i + 1]])))
        return pa.table({"bucket": pa.array(where, pa.int64()), "chunk": pa.array([me] * len(where), pa.int64()), "n": pa.array(sizes, pa.int32()), "data": binary(data)})

    def send(texts: pa.Table) -> pa.Table:
        return sent(Chunk(texts), texts["chunk"][0].as_py(), range(1, min(order, 2) + 1), None)

    def send_longer(n: int):  # noqa: ANN202
        def send(answers: pa.Table, texts: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return sent(Chunk(texts), 0, range(0), None)
            chunk = Chunk(texts)
            return sent(chunk, texts["chunk"][0].as_py(), range(n, n + 1), counts_below(chunk, answers, n))

        return send

    def counts_below(chunk: Chunk, answers: pa.Table, n: int) -> np.ndarray:
        count = None
        for k in range(2, n):
            count = chunk.others(k, received(answers, k), count if k > 2 else None)
        return count

    def answer(table: pa.Table) -> pa.Table:
        parts = [unframed(x) for x in table["data"].to_pylist()]
        keys, counts = [unpack_sorted(k) for k, _ in parts], [unpack_small(c) for _, c in parts]
        joint, own = np.concatenate(keys), np.concatenate(counts)
        by_key = np.argsort(joint, kind="stable")
        start, end = runs(joint[by_key])
        extra = np.empty(len(joint), dtype=np.int64)
        extra[by_key] = np.repeat(np.add.reduceat(own[by_key], start), end - start) - own[by_key]
        cut = np.cumsum([0, *map(len, keys)])
        return table.set_column(table.schema.get_field_index("data"), "data", binary([pack_small(extra[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]))

    def scored(answers: pa.Table, texts: pa.Table) -> pa.Table:
        chunk = Chunk(texts)
        rest = (n_words - chunk.length)[chunk.row].astype(np.float64)
        longest = np.minimum(chunk.place + 1, order)
        score = np.log10(alpha) * longest - np.log10(rest + 1)
        below, count = rest, None
        for n in range(1, order + 1):
            count = chunk.others(n, received(answers, n), count if n > 2 else None)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(count > 0, np.log10(count / below) + np.log10(alpha) * (longest - n), score)
            below = np.concatenate([[0.0], count[:-1]]) if len(count) else rest
        total = np.bincount(chunk.row, weights=score, minlength=chunk.rows)
        per = np.divide(total, chunk.length, out=np.zeros_like(total), where=chunk.length > 0)
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array(chunk.length.astype(np.int64)), "log10_score": pa.array(total), "log10_per_word": pa.array(per, mask=chunk.length == 0)})

    kind = base.schema["doc_id"].dataType.simpleString()
    answered = lambda sent: sent.groupBy("bucket", "n").applyInArrow(answer, SENT)
    answers = answered(by_chunk.applyInArrow(send, SENT))
    for n in range(3, order + 1):
        answers = materialize(answers, "answers", drop_shuffles=True)  # texts are shuffled again after it: two copies of them are too many
        answers = answers.unionByName(answered(answers.groupBy("chunk").cogroup(by_chunk).applyInArrow(send_longer(n), SENT)))
    return answers.groupBy("chunk").cogroup(by_chunk).applyInArrow(scored, f"doc_id {kind}, n_words long, log10_score double, log10_per_word double")


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("log10_per_word", 6).alias("log10_per_word"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i - 1] AS b, ws[i - 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM t),
l AS (SELECT doc_id, count(*) AS n_words FROM t GROUP BY 1),
o1 AS (SELECT doc_id, a, count(*) AS k FROM t GROUP BY ALL), c1 AS (SELECT a, sum(k) AS k FROM o1 GROUP BY ALL),
o2 AS (SELECT doc_id, b, a, count(*) AS k FROM t WHERE i > 1 GROUP BY ALL), c2 AS (SELECT b, a, sum(k) AS k FROM o2 GROUP BY ALL),
o3 AS (SELECT doc_id, c, b, a, count(*) AS k FROM t WHERE i > 2 GROUP BY ALL), c3 AS (SELECT c, b, a, sum(k) AS k FROM o3 GROUP BY ALL),
x1 AS (SELECT o1.doc_id, o1.a, c1.k - o1.k AS k FROM o1 JOIN c1 USING (a)),
x2 AS (SELECT o2.doc_id, o2.b, o2.a, c2.k - o2.k AS k FROM o2 JOIN c2 USING (b, a)),
x3 AS (SELECT o3.doc_id, o3.c, o3.b, o3.a, c3.k - o3.k AS k FROM o3 JOIN c3 USING (c, b, a)),
s AS (SELECT t.doc_id, least(t.i, 3) AS longest, x3.k AS k3, h2.k AS h2, x2.k AS k2, h1.k AS h1, x1.k AS k1, n.n - l.n_words AS rest
  FROM t CROSS JOIN n JOIN l ON l.doc_id = t.doc_id
  LEFT JOIN x3 ON t.i > 2 AND x3.doc_id = t.doc_id AND x3.c = t.c AND x3.b = t.b AND x3.a = t.a
  LEFT JOIN x2 h2 ON t.i > 2 AND h2.doc_id = t.doc_id AND h2.b = t.c AND h2.a = t.b
  LEFT JOIN x2 ON t.i > 1 AND x2.doc_id = t.doc_id AND x2.b = t.b AND x2.a = t.a
  LEFT JOIN x1 h1 ON t.i > 1 AND h1.doc_id = t.doc_id AND h1.a = t.b
  JOIN x1 ON x1.doc_id = t.doc_id AND x1.a = t.a),
g AS (SELECT doc_id, CASE WHEN k3 > 0 THEN log10(k3 / h2) + log10(0.4) * (longest - 3) WHEN k2 > 0 THEN log10(k2 / h1) + log10(0.4) * (longest - 2)
  WHEN k1 > 0 THEN log10(k1 / rest) + log10(0.4) * (longest - 1) ELSE log10(0.4) * longest - log10(rest + 1) END AS s FROM s),
r AS (SELECT doc_id, sum(s) AS s, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_words, round(coalesce(r.s, 0.0), 4) AS log10_score, round(r.s / r.n, 6) AS log10_per_word FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
