"""Removal of repeated byte strings by a sparse suffix array in range-partitioned buckets.

A full suffix array of n bytes moves n suffixes. Here only anchored suffixes are sorted: the anchor of a string of
``length`` bytes is its leftmost ``GRAM``-byte substring of least hash, which depends on the string alone, so equal
strings have equal anchors at equal offsets. Each anchor owns a run of neighbouring strings, and every string has one
owner. Anchored suffixes are range-partitioned by their leading bytes with sampled splitters and sorted in their buckets
by multikey quicksort on successive words of their bytes; the context (a hash of all strings that the anchor owns) is
the last key. Neighbours whose common prefix spans the gram form a group, within a bucket or across the boundary of two. A
suffix whose context recurs settles its strings at once; one that shares its gram with other contexts only is opened, and
its strings are compared one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import U64, Prefix, binary, blocks, mix, runs
from quorumlake.runtime import materialize, parallelism, small_batches

LENGTH, GRAM = 200, 32
FLUSH = 500_000
PLACE_BITS, CHUNK = 23, 1 << 22
ENTRY = "bucket long, kind int, data binary"
OPEN, SETTLED, SORTED, EDGE = 0, 1, 2, 3
WORDS = GRAM // 8  # sort keys of 8 bytes
SAMPLE = 20_000  # suffixes at least that the splitters are taken from


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes of that row before): a long text goes in chunks that share length - 1 bytes."""
    if len(data) <= 2 * CHUNK:
        yield data, offsets, 0, 0
        return
    for row in range(len(offsets) - 1):
        text = data[offsets[row] : offsets[row + 1]]
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[at : at + CHUNK + length - 1]
            yield part, np.array([0, len(part)]), row, at


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: Prefix, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor its row, the first string it owns, the number of further ones, its leading bytes as big-endian
    words, and its context."""
    gram = min(GRAM, length)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, *[none.astype(U64)] * (WORDS + 1)
    sums = prefix.sums(data)
    at = len(data) - gram + 1
    hashed = mix((sums[gram:] - sums[:-gram]) * prefix.inverse[:at])
    low = (hashed >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(at, dtype=U64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    string = np.arange(len(low))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    string = string[string + length <= offsets[1:][row]]
    owner = (low[string] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    change = np.ones(len(string), dtype=bool)
    change[1:] = (owner[1:] != owner[:-1]) | (row[string[1:]] != row[string[:-1]])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(string)) - 1
    a, lo, hi = owner[first], string[first], string[last]
    lead = []
    for w in range(WORDS):
        word = np.zeros(len(a), dtype=U64)
        for k in range(8 * w, 8 * w + 8):
            word = (word << U64(8)) | (data[a + k].astype(U64) if k < gram else U64(0))
        lead.append(word)
    context = mix(prefix.of(sums, lo, hi + length) + ((a - lo) * 1000 + hi - lo).astype(U64))
    return row[lo], lo, hi - lo, *lead, context


def packed(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], dtype=np.int64).tobytes() + b"".join(x.tobytes() for x in columns)


def unpacked(parts: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """Columns of the packed parts, put together."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for part in parts:
        n, at = int(np.frombuffer(part, np.int64, 1)[0]), 8
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(part, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True)]


SPAN = (np.int64, np.uint32, np.uint32)  # row id, first byte, end
SUFFIX = (*[np.uint64] * (WORDS + 1), np.int64, np.uint32, np.uint16)  # keys, row id, first string, further strings and if counted twice
STRING = (np.uint64, np.int64, np.uint32)  # hash, row id, first byte; the lowest bit of the hash tells if counted twice


def _buckets(values: np.ndarray, n: int) -> np.ndarray:
    return (((values >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def spread(to: np.ndarray, kind: int, n: int, columns: tuple[np.ndarray, ...]) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket that gets entries."""
    order = np.argsort(to.astype(np.uint16), kind="stable") if n < 1 << 16 else np.argsort(to, kind="stable")
    to, columns = to[order], [x[order] for x in columns]
    return [(int(to[lo]), kind, packed(*(x[lo:hi] for x in columns))) for lo, hi in zip(*runs(to), strict=True)]


def record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(kind, pa.int32()), binary(list(data))], names=["bucket", "kind", "data"])


def joined(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans, those of a row that touch put together."""
    if not len(rid):
        return rid, lo, hi
    order = np.lexsort((hi, lo, rid))
    rid, lo, hi = rid[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    reach = np.empty(len(rid), dtype=np.int64)
    start, end = runs(rid)
    base = np.repeat(np.arange(len(start)) << 33, end - start)
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(rid), dtype=bool)
    new[1:] = lo[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return rid[first], lo[first].astype(np.uint32), (reach[last] - base[last]).astype(np.uint32)


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Multikey quicksort, all partitions of a level at once: by the first key, then each run of equal keys by the next one."""
    order = np.argsort(keys[0])
    tied = keys[0][order]
    group = np.cumsum(np.concatenate([[False], tied[1:] != tied[:-1]])) if len(order) else order
    for key in keys[1:]:
        start, end = runs(group)
        in_run = np.repeat(end - start > 1, end - start)
        at = np.flatnonzero(in_run)
        if not len(at):
            break
        inner = np.lexsort((key[order[at]], group[at]))
        order[at] = order[at][inner]
        change = np.concatenate([[False], (group[1:] != group[:-1]) | (key[order][1:] != key[order][:-1])])
        group = np.cumsum(change)
    return order


def common_prefix(words: list[np.ndarray]) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, ``GRAM`` at most; -1 for the first one."""
    out = np.zeros(len(words[0]), dtype=np.int64)
    equal = np.ones(max(0, len(out) - 1), dtype=bool)
    for word in words:
        apart = word[1:] ^ word[:-1]
        same = np.zeros(len(apart), dtype=np.int64)
        for k in range(1, 9):
            same += (apart >> U64(64 - 8 * k)) == 0
        out[1:] += np.where(equal, same, 0)
        equal &= apart == 0
    out[:1] = -1
    return out


def part_of(splitters: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many splitters (columns of sorted tuples) are not greater than each tuple of keys."""
    to = np.searchsorted(splitters[0], keys[0], side="left")
    tied = np.flatnonzero(np.searchsorted(splitters[0], keys[0], side="right") > to)
    if len(tied):  # equal in the first word: by all keys
        n = len(splitters[0])
        last = np.concatenate([np.zeros(n, np.int8), np.ones(len(tied), np.int8)])
        order = np.lexsort((last, *(np.concatenate([s, k[tied]]) for s, k in zip(splitters[::-1], keys[::-1], strict=True))))
        passed = np.cumsum(order < n)
        own = order >= n
        to[tied[order[own] - n]] = passed[own]
    return to


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Every byte covered by a ``length``-byte string that also starts anywhere else goes; overlaps count, and all strings
    are judged on the input. Null text counts as empty; texts shorter than ``length`` keep everything; repeated rows and
    equal texts repeat each other. Strings are compared by 63 and 64-bit hashes of whole strings; an empty table gives
    an empty one and other columns are left out. ``buckets``: of suffixes, by the size of the input if not given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), body).alias("rid"))
    facts = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    total = int(facts["bytes"] or 0)
    n_sorted = buckets or max(parallelism(spark), math.ceil(total / 40_000_000))
    n_texts = max(parallelism(spark), math.ceil(total / 16_000_000))

    names = [f"w{k}" for k in range(WORDS)] + ["context"]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = Prefix()
        for batch in batches:
            for _, _, data, offsets, _ in blocks(batch.column(0)):
                for part, cut, _, _ in pieces(data, offsets, length):
                    keys = anchors(part, cut, prefix, length)[3:]
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)) for k in keys], names=names)

    wanted = max(SAMPLE, 8 * n_sorted)
    sampled = base.select("text").sample(min(1.0, wanted / 10 / max(1, facts["n"])), seed=7).mapInArrow(leads, ", ".join(f"{x} long" for x in names))
    sampled = sampled.orderBy(F.rand(7)).limit(wanted).toArrow()  # bounded, whatever the length of the sampled texts
    sampled = [sampled[x].to_numpy().view(U64) for x in names]
    order = multikey_order(*sampled)
    order = order[np.arange(1, n_sorted) * len(order) // n_sorted] if len(order) else order
    splitters = [x[order] for x in sampled]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, held, many = Prefix(), [], 0

        def flush() -> pa.RecordBatch:
            rid, lo, more, *words, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(context, kind="stable")
            rid, lo, more, context = (x[order] for x in (rid, lo, more, context))
            start, end = runs(context)  # contexts differ if grams do
            twice = end - start > 1
            in_twice = np.repeat(twice, end - start)
            rows = []
            if in_twice.any():
                r, a, b = joined(rid[in_twice], lo[in_twice], (lo + more + length)[in_twice])
                rows += spread(_buckets(r.view(U64), n_texts), SETTLED, n_texts, (r, a.astype(np.uint32), b.astype(np.uint32)))
            keys = [*(w[order][start] for w in words), context[start]]
            columns = (*keys, rid[start], lo[start].astype(np.uint32), (more[start] | (twice << 15)).astype(np.uint16))
            to = part_of(splitters, keys) if len(splitters[0]) else np.zeros(len(start), dtype=np.int64)
            return record(rows + spread(to, SORTED, n_sorted, columns))

        for batch in batches:
            rids = batch.column(1).to_numpy()
            for first, _, data, offsets, _ in blocks(batch.column(0)):
                for part, cut, skip, before in pieces(data, offsets, length):
                    row, lo, more, *keys = anchors(part, cut, prefix, length)
                    held.append((rids[first + skip + row], lo - cut[row] + before, more, *keys))
                    many += len(row)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    def compare(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        if kinds[0] == SETTLED:  # the buckets of kinds are apart
            return pa.table({"bucket": table["bucket"], "kind": table["kind"], "data": table["data"]})
        *words, context, rid, lo, more = unpacked(data, SUFFIX)
        order = multikey_order(*words, context)
        words = [x[order] for x in words]
        context, rid, lo, more = (x[order] for x in (context, rid, lo, more))
        weight, more = 1 + (more >> 15).astype(np.int64), (more & 0x7FFF).astype(np.int64)
        start, end = runs(context)
        total = np.add.reduceat(weight, start) if len(start) else weight
        settled = np.repeat(total > 1, end - start)
        rows = []
        hi = lo.astype(np.int64) + more + length
        if settled.any():
            r, a, b = joined(rid[settled], lo[settled], hi[settled])
            rows += spread(_buckets(r.view(U64), n_texts), SETTLED, n_texts, (r, a, b))
        prefix_ = common_prefix([x[start] for x in words])  # of each context's first suffix with the context before
        group = np.cumsum(prefix_ < GRAM)
        g_start, g_end = runs(group)
        mates = np.repeat(g_end - g_start, g_end - g_start) > 1  # contexts whose gram has others too
        pick = start[mates]
        if len(pick):
            r = rid[pick]
            rows += spread(_buckets(r.view(U64), n_texts), OPEN, n_texts, (r, lo[pick], hi[pick].astype(np.uint32)))
        for g in {0, len(g_start) - 1}:  # the groups at both boundaries; a lone context waits for the bucket beside
            at = start[g_start[g]]
            gram = b"".join(int(x[at]).to_bytes(8, "big") for x in words)
            lone = packed(rid[at : at + 1], lo[at : at + 1], hi[at : at + 1].astype(np.uint32)) if g_end[g] - g_start[g] == 1 else b""
            rows.append((int(_buckets(rid[at : at + 1].view(U64), n_texts)[0]), EDGE, gram + lone))
        return pa.Table.from_batches([record(rows)])

    first = base.select("text", "rid").mapInArrow(suffixes, ENTRY).withColumn("key", F.when(F.col("kind") == SORTED, F.col("bucket")).otherwise(-1 - F.col("bucket")))
    found = materialize(first.groupBy("key").applyInArrow(compare, ENTRY), "repeats")
    texts = base.withColumn("bucket", F.floor(F.shiftrightunsigned("rid", 32) * n_texts / F.lit(float(1 << 32))).cast("long"))
    keep_schema = "bucket long, kind int, data binary"

    def opened(spans: pa.Table, texts: pa.Table) -> pa.Table:
        prefix, rows = Prefix(), []
        rid, lo, hi = unpacked(spans["data"].to_pylist(), SPAN)
        if not len(rid) or not texts.num_rows:
            return pa.Table.from_batches([record([])])
        order = np.argsort(rid, kind="stable")
        rid, lo, hi = rid[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        texts = texts.combine_chunks()
        own, at = np.unique(texts["rid"].to_numpy(), return_index=True)  # repeated rows once
        wanted = at[np.isin(own, rid)]
        texts = texts.take(pa.array(wanted))
        own = texts["rid"].to_numpy()
        held: list = []

        def flush() -> None:
            digest, of, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(digest, kind="stable")
            digest, of, place = digest[order], of[order], place[order]
            start, end = runs(digest)
            twice = end - start > 1
            again = np.repeat(twice, end - start)
            if again.any():
                r, a, b = joined(of[again], place[again], place[again].astype(np.int64) + length)
                rows.extend(spread(_buckets(r.view(U64), n_texts), SETTLED, n_texts, (r, a, b)))
            columns = ((digest[start] & ~U64(1)) | twice.astype(U64), of[start], place[start])
            rows.extend(spread(_buckets(columns[0], n_sorted), SORTED, n_sorted, columns))
            held.clear()

        for a, b, data, offsets, _ in blocks(texts["text"].combine_chunks() if isinstance(texts["text"], pa.ChunkedArray) else texts["text"]):
            sums = prefix.sums(data)
            at, end = np.searchsorted(rid, own[a:b], side="left"), np.searchsorted(rid, own[a:b], side="right")
            row = np.repeat(np.arange(b - a), end - at)
            span = np.concatenate([np.arange(x, y) for x, y in zip(at, end, strict=True)]) if b > a else at
            many = hi[span] - length + 1 - lo[span]
            string = np.repeat(lo[span] + offsets[row] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            row = np.repeat(row, many)
            held.append((prefix.of(sums, string, string + length) & ~U64(1), own[a + row], (string - offsets[row]).astype(np.uint32)))
            if sum(len(x[0]) for x in held) >= 6 * FLUSH:
                flush()
        if held:
            flush()
        return pa.Table.from_batches([record(rows)])

    def strings(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == SETTLED:
            return pa.table({"bucket": table["bucket"], "kind": table["kind"], "data": table["data"]})
        digest, rid, lo = unpacked(table["data"].to_pylist(), STRING)
        order = np.argsort(digest, kind="stable")
        digest, rid, lo = digest[order], rid[order], lo[order].astype(np.int64)
        start, end = runs(digest >> U64(1))
        weight = 1 + (digest & U64(1)).astype(np.int64)
        again = np.repeat(np.add.reduceat(weight, start) > 1, end - start) if len(start) else np.zeros(0, bool)
        r, a, b = joined(rid[again], lo[again], lo[again] + length)
        return pa.Table.from_batches([record(spread(_buckets(r.view(U64), n_texts), SETTLED, n_texts, (r, a, b)))])

    by_text = texts.groupBy("bucket")
    edges = found.filter(F.col("kind") == EDGE).withColumn("gram", F.substring("data", 1, GRAM))  # two rows a bucket
    crossing = edges.groupBy("gram").agg(F.count("*").alias("many")).filter("many > 1").select("gram")
    crossing = edges.filter(F.length("data") > GRAM).join(crossing, "gram").select("bucket", F.lit(OPEN).alias("kind"), F.expr(f"substring(data, {GRAM + 1})").alias("data"))
    to_open = found.filter(F.col("kind") == OPEN).unionByName(crossing)
    compared = to_open.groupBy("bucket").cogroup(by_text).applyInArrow(opened, keep_schema)
    compared = compared.withColumn("key", F.when(F.col("kind") == SORTED, F.col("bucket")).otherwise(-1 - F.col("bucket"))).groupBy("key").applyInArrow(strings, keep_schema)
    spans = found.filter(F.col("kind") == SETTLED).unionByName(compared)

    def cut(spans: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        rid, lo, hi = joined(*unpacked(spans["data"].to_pylist(), SPAN))
        out = []
        column = texts["text"].combine_chunks() if isinstance(texts["text"], pa.ChunkedArray) else texts["text"]
        own = texts["rid"].to_numpy()
        for a, b, data, offsets, _ in blocks(column):
            at, end = np.searchsorted(rid, own[a:b], side="left"), np.searchsorted(rid, own[a:b], side="right")
            row = np.repeat(np.arange(b - a), end - at)
            span = np.concatenate([np.arange(x, y) for x, y in zip(at, end, strict=True)]) if b > a else at
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, offsets[row] + lo[span], 1)
            np.add.at(edge, offsets[row] + hi[span], -1)
            gone = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            n_removed = before[offsets[1:]] - before[offsets[:-1]]
            left = data[~gone].tobytes()
            kept_at = offsets - before[offsets]
            parts = [left[kept_at[i] : kept_at[i + 1]] for i in range(b - a)]
            n_spans = np.bincount(row, minlength=b - a)
            out.append(pa.table({"doc_id": texts["doc_id"].slice(a, b - a), "n_bytes": np.diff(offsets), "n_removed": n_removed, "n_spans": n_spans.astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in parts], "kept": binary(parts)}))
        schema = pa.schema([("doc_id", texts.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()

    kind = base.schema["doc_id"].dataType.simpleString()
    return spans.groupBy("bucket").cogroup(by_text).applyInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
