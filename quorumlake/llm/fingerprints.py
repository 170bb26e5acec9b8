"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A fingerprint is a vector of sums over the paragraphs (lines) of a text: ``EXACT`` lanes of 32 bits from SHA-512 of the
paragraph, summed modulo 2**32 (a MSet-Add hash: equal multisets have equal lanes, and sums can be added or subtracted
to insert or delete paragraphs), and ``LANES`` lanes modulo 2**16 that count a paragraph's adjacent word pairs with a
sign, each pair in one lane (a count sketch, whose cosine estimates likeness).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quorumlake.runtime import broadcast_if_small, materialize, parallelism

EXACT, LANES = 16, 64


def bind(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def exact_lanes(lines: Column) -> Column:
    """16 sums of 32-bit words of SHA-512, modulo 2**32."""
    zero = F.array(*[F.lit(0).cast("long")] * EXACT)
    digest = F.transform(lines, lambda p: F.sha2(p, 512))
    word = lambda d, i: F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long")
    return F.aggregate(digest, zero, lambda acc, d: F.array(*[(acc[i] + word(d, i)) % (1 << 32) for i in range(EXACT)]))


def sketch_lanes(lines: Column) -> Column:
    """64 signed counts of adjacent word pairs.

    Each pair becomes one of 128 marks. The marks, and each possible one once more, are sorted; the lengths of the runs
    then are the counts. That is work on short arrays inside the JVM and needs no row per word and no shuffle.
    """
    every = F.sequence(F.lit(0).cast("long"), F.lit(2 * LANES - 1).cast("long"))

    def marks(p: Column) -> Column:
        return bind(F.split(p, " "), lambda ws: F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(2 * LANES))))

    ordered = F.sort_array(F.concat(F.flatten(F.transform(lines, marks)), every))
    found = F.regexp_extract_all(F.array_join(F.transform(ordered, lambda m: F.chr(m)), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    count = lambda runs: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: (F.length(F.get(runs, 2 * i)) - F.length(F.get(runs, 2 * i + 1))).cast("long"))
    return bind(found, count)


def lanes(text: Column) -> Column:
    """Struct of exact and sketch lanes."""
    lines = paragraphs(text)
    return F.struct(exact_lanes(lines).alias("exact"), sketch_lanes(lines).alias("sketch"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes after inserting (or, with sign -1, deleting) the paragraphs that ``b`` is of."""
    exact = F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    return F.struct(exact.alias("exact"), F.zip_with(a["sketch"], b["sketch"], lambda x, y: x + sign * y).alias("sketch"))


def digest(v: Column) -> Column:
    """Hex of all lanes: 8 digits for each exact lane, 4 (modulo 2**16) for each sketch lane."""
    exact = F.transform(v["exact"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    sketch = F.transform(v["sketch"], lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 16)))), 4, "0"))
    return F.concat(F.array_join(exact, ""), F.array_join(sketch, ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal lanes, else the sketches' cosine, 0 at least and under 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a["sketch"], a["sketch"]) * dot(b["sketch"], b["sketch"]))
    cosine = F.when(norm > 0, dot(a["sketch"], b["sketch"]) / norm).otherwise(0.0)
    return F.when((a["exact"] == b["exact"]) & (a["sketch"] == b["sketch"]), 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(0.999999)))


def edited_text(text: Column, after: Column) -> Column:
    """``text`` with its last third replaced by as many leading characters of ``after`` (or all it has)."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(after, F.lit(1), cut))


def _in_order(docs: DataFrame, n_buckets: int) -> DataFrame:
    """_id, _hash and _text dealt to buckets of neighbours in descending order; each bucket also gets, marked _ghost, the
    first row of the bucket after it, so that every row meets the one that follows it in its own bucket.

    The buckets are those that a range partitioning of the keys alone samples: one row of bounds a bucket, put together
    in a table of one row (``n_buckets`` keys of 16 bytes), so none is empty and nothing of them enters the plan.
    """
    key = F.struct("_id", "_hash")
    ranged = docs.select(key.alias("_key")).repartitionByRange(n_buckets, F.col("_key").desc())
    bounds = materialize(ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("_key").alias("_first")), "bounds")
    width = max(1, math.isqrt(bounds.count()))
    firsts = bounds.agg(F.sort_array(F.collect_set("_first"), asc=False).alias("f"))
    # two short searches instead of one long one
    parts = F.transform(F.sequence(F.lit(0), F.size("f") - 1, F.lit(width)), lambda i: F.slice("f", i + 1, F.lit(width)))
    firsts = firsts.filter(F.size("f") > 0).select(parts.alias("_parts"), F.transform(parts, lambda x: x[0]).alias("_heads"), F.size("f").alias("_buckets"))
    docs = docs.join(broadcast_if_small(materialize(firsts, "firsts"), 32 * max(1, width * width + 2 * width)))
    outer = F.size(F.filter("_heads", lambda x: key <= x)) - 1
    place = bind(outer, lambda o: o * width + F.size(F.filter(F.get(F.col("_parts"), o), lambda x: key <= x)) - 1)
    first = lambda b: F.get(F.get(F.col("_parts"), F.floor(b / width).cast("int")), (b % width).cast("int"))
    docs = docs.withColumn("_bucket", place).withColumn("_head", key == first(F.col("_bucket")))
    before = F.pmod(F.col("_bucket") - 1, F.col("_buckets"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g"))
    to = F.when(F.col("_head"), F.array(own, F.struct(before.alias("b"), F.lit(True).alias("g")))).otherwise(F.array(own))
    return docs.select("_id", "_hash", "_text", F.explode(to).alias("_to")).select("_id", "_hash", "_text", F.col("_to.b").alias("_bucket"), F.col("_to.g").alias("_ghost"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. The next document is the one with the next smaller id, after the last the first; repeated
    ids follow each other by a hash of the text; null ids come last. A single document is its own next. Other columns are left out.

    Texts are shuffled once, by buckets of neighbouring ids. The edited text's lanes come from the document's own by
    deleting the paragraphs that the edit touches and inserting the new ones.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.withColumn("_hash", F.xxhash64("_text"))
    n_buckets = max(2 * parallelism(spark), math.ceil(base.count() / 20_000))
    placed = _in_order(base, n_buckets).repartition("_bucket").withColumn("_lanes", lanes(F.col("_text")))
    follow = W.partitionBy("_bucket").orderBy(F.col("_ghost"), F.struct("_id", "_hash").desc())
    both = placed.withColumn("_next", F.lead(F.struct("_text", "_lanes")).over(follow)).filter("NOT _ghost")
    both = both.withColumn("_edited", edited_text(F.col("_text"), F.col("_next._text")))
    size, cut = F.length("_text"), F.floor(F.length("_text") / 3).cast("int")
    kept = F.substring("_text", F.lit(1), size - cut)
    same = size - cut - F.length(F.substring_index(kept, "\n", -1))  # characters of the paragraphs that stay whole
    tail = lambda x: F.substring(x, same + 1, F.length(x))
    both = both.withColumn("_edited_lanes", F.when(cut == 0, F.col("_lanes")).otherwise(add(add(F.col("_lanes"), lanes(tail(F.col("_text"))), -1), lanes(tail(F.col("_edited"))))))
    return both.select(
        F.col("_id").alias("doc_id"),
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        digest(F.col("_lanes")).alias("fingerprint"),
        digest(F.col("_edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("_lanes"), F.col("_edited_lanes")).alias("near_edited"),
        likeness(F.col("_lanes"), F.col("_next._lanes")).alias("near_next"),
    )


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
