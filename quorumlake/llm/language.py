"""Language ID with word-first backoff to shorter character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import U64, Prefix, blocks, mix, runs, words
from quorumlake.runtime import small_batches

ORDER = 4
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000_000  # per language, about; the bounds on the sample that the classifier is fitted on
UNDETERMINED = "und"


def separators() -> np.ndarray:
    """All ASCII but letters separates words (texts are lower-cased first)."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    table[97:123] = False
    return table


@dataclass
class Model:
    """Sorted keys of words and of character n-grams, each with a row of log frequencies per language."""

    languages: list[str]
    word_keys: np.ndarray
    word_logs: np.ndarray
    gram_keys: list[np.ndarray]  # by length - 1
    gram_logs: list[np.ndarray]


def codes(texts: bytes) -> np.ndarray:
    return np.frombuffer(texts.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def gram_codes(chars: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n characters from each place on."""
    out = np.zeros(len(chars), dtype=U64)
    for k in range(n):
        shifted = np.zeros(len(chars), dtype=U64)
        shifted[: len(chars) - k] = chars[k:]
        out = out * U64(0x100000001B3) + shifted
    return mix(out + U64(n))


def lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _logs(counts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log relative frequency per language) from each language's (keys, counts)."""
    keys = np.unique(np.concatenate([k[c >= least] for k, c in counts] or [np.zeros(0, U64)]))
    logs = np.zeros((len(keys), len(counts)), dtype=np.float32)
    for i, (k, c) in enumerate(counts):
        total = max(1, int(c.sum()))
        logs[:, i] = math.log(0.2 / total)
        at, found = lookup(keys, k)
        logs[at[found], i] = np.log(c[found] / total)
    # the same floor for all languages: differences, not sample sizes, decide
    return keys, np.maximum(logs, np.log(1e-7))


def fit(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", order: int = ORDER, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Model of the usable rows' texts and labels.

    About ``train_docs`` rows of each language, or fewer that hold ``train_chars`` characters, are taken by a hash of
    their id, so the sample and the model stay bounded for any corpus; rows without text or label are left out, repeated
    rows count as often as they stand. Words and n-grams are counted per task before they are summed.
    """
    small_batches(docs.sparkSession)
    labelled = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: max(r[1] / train_docs, (r[2] or 0) / train_chars) for r in labelled.groupBy(lang).agg(F.count("*"), F.sum(F.length(text))).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0, U64), np.zeros((0, 0), np.float32), [np.zeros(0, U64)] * order, [np.zeros((0, 0), np.float32)] * order)
    part = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int(1_000_000 / max(1.0, sizes[k])) + 1)])
    sample = labelled.filter(part < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator = Prefix(), separators()
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                lower = pc.utf8_lower(batch.column(1).filter(pc.equal(batch.column(0), name)))
                for _, _, data, offsets, _ in blocks(lower):
                    start, end, _ = words(data, offsets, separator)
                    if not len(start):
                        continue
                    key, count = np.unique(prefix.of(prefix.sums(data), start, end), return_counts=True)
                    found = [(0, key, count)]
                    spaced = np.where(separator[data], np.uint8(32), data).tobytes()
                    chars = codes(b" " + spaced + b" ")
                    letter = chars != 32
                    for n in range(1, order + 1):
                        whole = np.ones(len(chars), dtype=bool)
                        if n > 1:
                            whole[len(chars) - n + 1 :] = False
                        for k in range(1, n - 1):  # spaces at the ends only
                            whole[: len(chars) - k] &= letter[k:]
                        any_letter = letter.copy()
                        if n > 1:
                            any_letter[:-1] |= letter[1:]
                        whole &= any_letter
                        found.append((n, *np.unique(gram_codes(chars, n)[whole], return_counts=True)))
                    for n, key, count in found:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "n", "key", "count"])

    table = sample.mapInArrow(counted, "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count")).filter((F.col("count") > 1) | (F.col("n") == 1)).toArrow()
    which, n = np.asarray(table["lang"].combine_chunks().cast(pa.string()).to_numpy(zero_copy_only=False)), table["n"].to_numpy()
    key, count = table["key"].to_numpy().view(U64), table["count"].to_numpy()

    def of(level: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for name in languages:
            pick = (n == level) & (which == name)
            order_ = np.argsort(key[pick])
            out.append((key[pick][order_], count[pick][order_]))
        return out

    word_keys, word_logs = _logs(of(0), 2)
    grams = [_logs(of(k), 2 if k > 1 else 1) for k in range(1, order + 1)]
    return Model(languages, word_keys, word_logs, [g[0] for g in grams], [g[1] for g in grams])


def unseen_logs(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log frequency per language of words the model has not seen: the mean over their places of the longest known n-gram."""
    padded = b" " + b" ".join(data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)) + b" "
    chars = codes(padded)
    space = chars == 32
    word = np.cumsum(space)[: len(chars)] - 1  # a place belongs to the word after its space
    logs = np.zeros((len(chars), len(model.languages)), dtype=np.float32)
    todo = np.ones(len(chars), dtype=bool)
    todo[-1] = False
    for n in range(len(model.gram_keys), 0, -1):
        place = np.flatnonzero(todo)
        if not len(place):
            break
        key = gram_codes(chars, n)[place]
        at, found = lookup(model.gram_keys[n - 1], key)
        logs[place[found]] = model.gram_logs[n - 1][at[found]]
        todo[place[found]] = False
    place = np.arange(len(chars) - 1)
    starts = runs(word[place])[0]
    sums = np.add.reduceat(logs[:-1], starts, axis=0)
    return sums / np.diff(np.append(starts, len(place)))[:, None]


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``pred`` and ``score`` (share of the best language, 0 to 1) at the end.

    Null texts and texts without a letter are ``und`` with score 0, as is all if the model is empty. Ties go to the
    first language by name. Whole texts are read; the model goes to the tasks with the function (its size is bounded
    by the training sample). Columns of ``docs`` that are named like the two new ones give way to them.
    """
    small_batches(docs.sparkSession)
    languages = model.languages
    docs = docs.select([c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator = Prefix(), separators()
        cached_keys, cached_logs = np.zeros(0, U64), np.zeros((0, len(languages)), np.float32)
        at_text = names.index(text)
        for batch in batches:
            best, share = [], []
            raw = batch.column(at_text)
            lower = pc.utf8_lower(raw.cast(pa.string()))
            for lo, hi, data, offsets, nulls in blocks(lower):
                m = hi - lo
                sums = np.zeros((m, max(1, len(languages))))
                start, end, row = words(data, offsets, separator)
                if len(start) and languages:
                    hashed = prefix.of(prefix.sums(data), start, end)
                    key, first, back = np.unique(hashed, return_index=True, return_inverse=True)
                    logs = np.zeros((len(key), len(languages)), dtype=np.float32)
                    at, known = lookup(model.word_keys, key)
                    logs[known] = model.word_logs[at[known]]
                    at, cached = lookup(cached_keys, key)
                    cached &= ~known
                    logs[cached] = cached_logs[at[cached]] if cached.any() else 0
                    new = np.flatnonzero(~known & ~cached)
                    if len(new):
                        logs[new] = unseen_logs(model, data, start[first[new]], end[first[new]])
                        if len(cached_keys) < 100_000:
                            order = np.argsort(np.concatenate([cached_keys, key[new]]), kind="stable")
                            cached_keys, cached_logs = np.concatenate([cached_keys, key[new]])[order], np.concatenate([cached_logs, logs[new]])[order]
                    begin = runs(row)[0]
                    sums[row[begin]] = np.add.reduceat(logs[back], begin, axis=0, dtype=np.float64)
                count = np.bincount(row, minlength=m)
                has = np.zeros(m, dtype=bool)
                letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has & (count > 0) & ~nulls).tolist():  # no ASCII letter
                    has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
                has &= bool(languages)
                mean = sums / np.maximum(count, 1)[:, None]
                odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(count, 30)[:, None])
                top = mean.argmax(axis=1)
                share.append(np.where(has, odds.max(axis=1) / odds.sum(axis=1), 0.0))
                best += [languages[t] if h else UNDETERMINED for t, h in zip(top.tolist(), has.tolist(), strict=True)]
            shares = np.concatenate(share) if share else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(shares)], names=[f"c{i}" for i in range(len(names))] + ["_p", "_s"])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = renamed.mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) + ", _p string, _s double")
    return out.toDF(*names, pred, score)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's text is 2 modulo 4; a null id is not held out, and its label is learnt from like any other."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
