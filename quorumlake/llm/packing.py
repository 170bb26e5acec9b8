"""Best-fit decreasing packing of tokenised documents, certified by dual-feasible-function bounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import flat
from quorumlake.runtime import discard, materialize, small_batches

SEQUENCE, END_ID = 1024, 2


def encoder(path: str, ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text to ids. The rank form of the vocabulary gives the ids of the JSON form several times faster; a text that
    holds one of the JSON form's special strings goes to the JSON form itself, which treats them in its own way, as does
    one that the rank form's pattern can't take (a run of very many spaces or newlines exhausts its stack)."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if "<|" not in text:
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # of the pattern's stack
                pass
        if not whole:
            whole.append(Tokenizer.from_file(path))
        return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE, end_id: int = END_ID, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text counts as empty and gives the end id alone.

    Only documents of more than ``length`` ids are cut; the first piece takes what is left over. One row of text is
    in memory at a time, and ids never leave the task.
    """
    small_batches(docs.sparkSession)
    if files is None:
        import public_tokenizers as P

        files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            data, offsets, _ = flat(batch.column(1))
            data, row, start, size, crc = data.tobytes(), [], [], [], []
            for i in range(len(offsets) - 1):
                ids = np.append(encode(data[offsets[i] : offsets[i + 1]].decode()), np.array([end_id], dtype="<u4")).astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    step = length if n <= length or at else (n % length or length)
                    step = min(step, n - at)
                    row.append(i)
                    start.append(at)
                    size.append(step)
                    crc.append(zlib.crc32(ids[at : at + step].tobytes()))
                    at += step
            row_ = np.array(row, dtype=np.int64)
            piece = np.arange(len(row_)) - np.searchsorted(row_, row_) if len(row_) else row_
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing for integer sizes: bin and offset of each item, and the number of bins."""
    n = len(sizes)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    held, made, sized = 0, 0, sizes.tolist()  # held: bit s is set if a bin with s left exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = sized[i]
        fits = held >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = with_space[left].pop()
            if not with_space[left]:
                held &= ~(1 << left)
        else:
            b, left, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - left
        left -= s
        if left:
            with_space[left].append(b)
            held |= 1 << left
    return bins, offsets, made


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins needed at least: the largest sum over compositions of two families of dual feasible functions.

    ``histogram[s]`` counts the items of size s. The threshold family drops sizes under e and lifts those over
    capacity - e; the rounding family maps x to floor((k + 1) x) / k where (k + 1) x is no integer (Fekete and Schepers).
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for e in range(0, capacity // 2 + 1, max(1, capacity // 128)):
        lifted = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        for k in range(0, 13):
            if k == 0:
                total, scale = int((lifted * histogram).sum()), capacity
            else:
                whole = (k + 1) * lifted
                value = np.where(whole % capacity == 0, lifted * k, whole // capacity * capacity)
                total, scale = int((value * histogram).sum()), capacity * k
            best = max(best, -(-total // scale))
    return best


PACKED = "doc_id {0}, piece int, start long, length long, ids_crc32 long, _at long, _part long, sequence_id long, offset long, _bins long, _bound long, _fill long"


def _pack(pieces: DataFrame, kind: str, capacity: int, tag: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy()
        bins, offsets, made = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=made).astype(np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pdf.assign(sequence_id=((tag << 24) + pdf["_part"].to_numpy()) * (1 << 32) + bins, offset=offsets, _bins=made, _bound=bound, _fill=fill[bins])

    return pieces.groupBy("_part").applyInPandas(run, PACKED.format(kind))


def pack(pieces: DataFrame, capacity: int = SEQUENCE, items: int = 100_000, least_gain: float = 1e-5) -> tuple[DataFrame, dict]:
    """Pieces with sequence_id and offset, and the certificate {bins, bound, rounds}.

    Pieces of full length are sequences of their own. The rest is dealt evenly (by row number, so that no key is hot)
    to partitions of ``items`` pieces. Each is packed by best-fit decreasing and certified by its own lower bound.
    While the total exceeds the bound of the global size histogram (``capacity`` rows), partitions with a gap give up
    their poorly filled sequences and every partition its emptiest one; the pieces given up are dealt anew, so that
    partitions exchange documents, and packed again. A round that saves nothing is undone and ends the loop, as does one
    that saves less than ``least_gain`` of all sequences (under 1 / ``least_gain`` sequences: only one that saves none).
    Null ids, repeated rows and equal pieces are pieces like others; an empty table gives an empty one.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    pieces = materialize(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for s, c in counts.items():
        histogram[s] = c
    full = int(histogram[capacity])
    bound = lower_bound(histogram, capacity)
    whole = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_at") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = int(histogram.sum()) - full
    if not n:
        return whole.select(names), {"bins": full, "bound": bound, "rounds": 0}

    def deal(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64("_at"), F.lit(math.ceil(n / items))))

    packed = materialize(_pack(deal(pieces.filter(F.col("length") < capacity), n), kind, capacity, 1), "packed")
    bins = packed.select("sequence_id").distinct().count()
    done = 1
    gain = bins
    while bins + full > bound and gain >= least_gain * (bins + full):
        worst = packed.groupBy("_part").agg(F.min("_fill").alias("_worst"))
        marked = packed.join(worst, "_part").withColumn("_free", (F.col("_fill") == F.col("_worst")) | ((F.col("_bins") > F.col("_bound")) & (F.col("_fill") < F.lit(capacity * 0.98))))
        marked = materialize(marked.drop("_worst"), "marked")
        free = marked.filter("_free")
        freed = free.agg(F.count_distinct("sequence_id").alias("b"), F.count("*").alias("n")).first()
        if freed["b"] < 2:
            break
        again = materialize(_pack(deal(free.select("doc_id", "piece", "start", "length", "ids_crc32", "_at"), freed["n"]), kind, capacity, done + 1), "packed")
        made = again.select("sequence_id").distinct().count()
        done += 1
        if made >= freed["b"]:
            discard(marked, again)
            break
        gain = freed["b"] - made
        before = packed
        packed, bins = materialize(marked.filter("NOT _free").drop("_free").unionByName(again), "packed"), bins - gain
        discard(before, marked, again)
    return whole.unionByName(packed.select(names)), {"bins": bins + full, "bound": bound, "rounds": done}


def op7_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces, and on each row the certificate: the number of sequences and the least that any packing needs."""
    packed, found = pack(tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed.withColumns({"n_sequences": F.lit(found["bins"]).cast("long"), "n_bound": F.lit(found["bound"]).cast("long")})
