"""Quality scores: document statistics, random Fourier features, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import Prefix, blocks, ngrams, row_sets, runs, space_table, words
from quorumlake.runtime import materialize, small_batches

STATISTICS = [
    "length", "words", "word_length", "long_words", "letters", "capitals", "digits", "spaces", "sentence_marks", "other_marks", "marks_in_a_row",
    "words_with_marks", "repeated_words", "distinct_words", "distinct_triples", "top_word", "lines", "line_length", "repeated_lines", "byte_entropy",
]
SCALE = 1 << 16  # statistics and features are whole multiples of 1 / SCALE, 1 / FEATURE_SCALE: sums don't depend on the order of tasks
FEATURE_SCALE = 1 << 12
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 4096
SEED = 11
THRESHOLD = 0.7


def _classes() -> dict[str, np.ndarray]:
    table = {name: np.zeros(256, dtype=np.int64) for name in ("letters", "capitals", "digits", "spaces", "sentence_marks", "other_marks")}
    table["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    table["capitals"][65:91] = 1
    table["digits"][48:58] = 1
    table["spaces"][[9, 10, 11, 12, 13, 32]] = 1
    table["sentence_marks"][[ord(c) for c in ".,;:'\"()-?"]] = 1
    table["other_marks"][33:127] = 1
    table["other_marks"] -= np.minimum(table["other_marks"], table["letters"] + table["digits"] + table["sentence_marks"])
    return table


def statistics(data: np.ndarray, offsets: np.ndarray, prefix: Prefix, separator: np.ndarray, classes: dict[str, np.ndarray]) -> np.ndarray:
    """A row of STATISTICS for each text of a block, shares and logarithms, all about 0 to 1."""
    m = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    summed = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[offsets[1:]] - c[offsets[:-1]]
    row_of = np.repeat(np.arange(m), np.diff(offsets))
    out = {name: summed(table[data]) / some for name, table in classes.items()}
    letters = out["letters"] * some
    out["capitals"] = out["capitals"] * some / np.maximum(letters, 1)
    mark = (classes["sentence_marks"] + classes["other_marks"])[data]
    twice = np.zeros(len(data), dtype=np.int64)
    if len(data) > 1:
        twice[1:] = mark[1:] & mark[:-1] & (row_of[1:] == row_of[:-1])
    out["marks_in_a_row"] = summed(twice) / some
    start, end, row = words(data, offsets, separator)
    n_words = np.bincount(row, minlength=m).astype(np.float64)
    any_words = np.maximum(n_words, 1)
    hashed = prefix.of(prefix.sums(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    width = (end - start).astype(np.float64)
    out["word_length"] = np.bincount(row, width, m) / any_words / 20
    out["long_words"] = np.bincount(row, width > 20, m) / any_words
    out["words_with_marks"] = np.bincount(row, mark[end - 1] if len(end) else width, m) / any_words
    same = np.zeros(len(hashed), dtype=bool)
    if len(hashed) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    out["repeated_words"] = np.bincount(row, same, m) / any_words
    _, distinct_row = row_sets(hashed, row)
    out["distinct_words"] = np.bincount(distinct_row, minlength=m) / any_words
    triples, at = ngrams(hashed, row, 3)
    _, triple_row = row_sets(triples, row[at])
    out["distinct_triples"] = np.bincount(triple_row, minlength=m) / np.maximum(n_words - 2, 1)
    order = np.lexsort((hashed, row))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (row[order][1:] != row[order][:-1])
    place = np.flatnonzero(new)
    most = np.zeros(m)
    np.maximum.at(most, row[order][place], np.diff(np.append(place, len(order))))
    out["top_word"] = most / any_words
    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    start, end, row = words(data, offsets, newline)
    n_lines = np.bincount(row, minlength=m).astype(np.float64)
    lines = prefix.of(prefix.sums(data), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
    _, line_row = row_sets(lines, row)
    out["repeated_lines"] = 1 - np.bincount(line_row, minlength=m) / np.maximum(n_lines, 1) - (n_lines == 0)
    out["line_length"] = np.log1p(size / np.maximum(n_lines, 1)) / 16
    out["lines"], out["length"], out["words"] = np.log1p(n_lines) / 16, np.log1p(size) / 16, np.log1p(n_words) / 16
    entropy = np.zeros(m)
    key = np.sort(row_of * 256 + data)
    place, stop = runs(key)
    share = (stop - place) / some[key[place] // 256]
    np.add.at(entropy, key[place] // 256, -share * np.log2(share) / 8)
    out["byte_entropy"] = entropy
    return np.stack([out[name] for name in STATISTICS], axis=1)


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): whole statistics of each whole text in units of 1 / SCALE; a null text is an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator, classes = Prefix(), space_table(), _classes()
        for batch in batches:
            found = [np.zeros((0, len(STATISTICS)))]
            for _, _, data, offsets, _ in blocks(batch.column(1)):
                found.append(statistics(data, offsets, prefix, separator, classes))
            whole = np.rint(np.concatenate(found) * SCALE).astype(np.int32)
            place = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(place, pa.array(whole.ravel()))], names=["doc_id", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<int>")


@dataclass
class Model:
    """Standardisation, projection and weights of the ridge fit, and the steps of its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, increasing
    values: np.ndarray  # calibrated scores there, not decreasing

    def features(self, x: np.ndarray) -> np.ndarray:
        """Whole cosines of random waves, the last column constant."""
        z = np.clip((x / SCALE - self.mean) * self.scale, -6, 6)
        waves = np.rint(FEATURE_SCALE * np.cos(z @ self.waves + self.shifts))
        return np.concatenate([waves, np.full((len(x), 1), float(FEATURE_SCALE))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores of the fit, without the last bits, in which products of matrices of different heights differ."""
        return np.rint(self.features(x) @ self.weights / FEATURE_SCALE * (1 << 24)) / (1 << 24)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of raw scores from -1 to 2."""
    return np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)


def isotonic(places: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: mean place and share of ones of each block, shares not decreasing."""
    pools: list[list[float]] = []
    for p, k, n in zip(places.tolist(), ones.tolist(), totals.tolist(), strict=True):
        pools.append([p * n, k, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for s, _, n in pools]), np.array([k / n for _, k, n in pools])


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """Model of rows (x, y, fold): those of fold 0 fit the ridge scores, those of fold 1 calibrate them.

    All rows count. Tasks sum their normal equations, in whole numbers, so the fit is the same however rows are dealt;
    the driver gets features squared numbers and BINS counts. Without rows of fold 0 all raw scores are 0, without rows
    of fold 1 they are calibrated as they are, without any row all scores are 0.5.
    """
    k = len(STATISTICS)
    part = labelled.filter("fold = 0")
    sums = part.select(F.posexplode("x").alias("at", "v"), F.lit(1).alias("one")).groupBy("at").agg(F.sum(F.col("v").cast("long")).alias("s"), F.sum(F.col("v").cast("long") * F.col("v")).alias("q"), F.count("*").alias("n")).collect()
    mean, scale, n = np.zeros(k), np.zeros(k), 0
    for r in sums:
        n = r["n"]
        mean[r["at"]] = r["s"] / n / SCALE
        variance = max(r["q"] / n / SCALE**2 - mean[r["at"]] ** 2, 0)
        scale[r["at"]] = 1 / max(variance**0.5, 1e-3)
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, 1 / width, (k, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2), dtype=np.int64)
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy().astype(np.float64)
            for lo in range(0, len(x), 1 << 14):
                z = model.features(x[lo : lo + (1 << 14)])
                total += np.rint(z.T @ np.concatenate([z, y[lo : lo + (1 << 14), None]], axis=1)).astype(np.int64)
        i, j = np.triu_indices(features + 1, 0, features + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    if n:
        table = part.select("x", "y").mapInArrow(equations, "i int, j int, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        whole = np.zeros((features + 1, features + 2))
        whole[table["i"].to_numpy(), table["j"].to_numpy()] = table["v"].to_numpy()
        gram = whole[:, :-1] / FEATURE_SCALE**2 / n
        gram = np.triu(gram) + np.triu(gram, 1).T
        penalty = ridge * np.eye(features + 1)
        penalty[-1, -1] = 0
        model.weights = np.linalg.solve(gram + penalty, whole[:, -1] / FEATURE_SCALE / n)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, y = bin_of(model.raw(_matrix(batch))), batch.column("y").to_numpy()
            total, ones = np.bincount(place, minlength=BINS), np.bincount(place, y, BINS).astype(np.int64)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(ones[seen]), pa.array(total[seen])], names=["bin", "ones", "n"])

    bins = labelled.filter("fold = 1").select("x", "y").mapInArrow(binned, "bin int, ones long, n long").groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).orderBy("bin").collect()
    if bins:
        place, ones, total = (np.array([r[c] for r in bins], dtype=np.float64) for c in ("bin", "ones", "n"))
        model.steps, model.values = isotonic((place + 0.5) / BINS * 3 - 1, ones, total)
    elif n:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def predict(stats: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``stats`` with the calibrated score in place of x."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch)))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double").withColumnRenamed("score", column)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 4; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Labels of held-out ids (remainder 2) are not read; remainders 0 and 1 fit, 3 calibrates. Null and empty texts have
    statistics of 0 and a score like any other. A row with a null id is not held out and has no label. Null labels are
    left out; repeated labels and repeated rows count each. Without labels all scores are 0.5; without documents there are
    no rows. Labels, lang, source and doc_id are no input of a score; other columns are left out. Texts are read once, in
    place; only their statistics, some 40 bytes a document, are written and meet the labels.
    """
    stats = materialize(with_statistics(docs), "statistics")
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (remainder() != 2) & F.col("doc_id").isNotNull())
    labelled = materialize(stats.join(known, "doc_id").select("x", "y", (remainder() == 3).cast("int").alias("fold")), "labelled")
    scored = predict(stats, fit(labelled))
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
