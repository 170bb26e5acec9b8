"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words and, hashed with a sign, all other words of the corpus. A
distributed randomised SVD spans a latent space of ``RANK`` dimensions: every task multiplies its passages by a sparse
random test matrix and back, the sums go to the driver (vocabulary x test columns), and the leading right singular
vectors of all passages come from them by Nystroem's formula (Halko, Martinsson and Tropp, 2011; Tropp et al., 2017).
Passages and items are compared in that space alone, scaled by the inverse singular values as queries are folded into
latent semantic indexes. Passages are overlapping windows; an item longer than a window is searched for by its parts.
Where a latent cosine reaches ``COSINE`` and the surroundings hold as many of the item's rarer words as a leak must, the
pair is verified at once, while the words are at hand, by the longest common subsequence with the item and by the item's
closing words, its answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import U64, Prefix, binary, blocks, runs, words
from quorumlake.runtime import small_batches

UNIT, WINDOW, PASSAGE = 8, 16, 32  # words: step of the search, its windows, the passages that the latent space is of
COSINE, LCS, ANSWER = 0.25, 0.6, 0.5
RANK, OVERSAMPLE, NONZEROS, REST = 64, 8, 4, 4096
MAX_SHARE, RARE, SELDOM = 0.05, 1e-4, 0.01
ITEM_BLOCK, ITEM_CHARS = 50_000, 20_000_000
CELLS, BLOCK_BYTES, TARGET_STEP = 1 << 17, 1 << 19, 1024
LEADING = 18


def punctuation() -> np.ndarray:
    """ASCII bytes other than letters and digits separate words."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    table[48:58] = table[65:91] = table[97:123] = False
    return table


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.string()))


class Items:
    """A block of benchmark items: word hashes, vocabulary, weights, latent basis."""

    def __init__(self, ids: list, texts: list[str]):
        prefix = Prefix()
        self.ids, self.words = [], []
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer(lowered(pa.array([text]))[0].as_py().encode(), dtype=np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]), punctuation())
            if len(start):
                self.ids.append(item)
                self.words.append(prefix.of(prefix.sums(data), start, end))
        # what windows are compared with: each item, or if it is longer than a window its parts
        targets = [np.array_split(w, -(-len(w) // WINDOW)) for w in self.words]
        self.targets = [t for several in targets for t in several]
        self.owner = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, U64)
        self.size = len(self.vocabulary) + REST  # dimensions: these words, and all others by hash
        self.weights = np.ones(self.size, dtype=np.float32)
        self.basis = np.zeros((self.size, 0), dtype=np.float32)

    def weigh(self, units: int, counts: np.ndarray) -> None:
        """Inverse document frequencies, from shares of the units alone, so a passage scores alike at every size of the
        corpus; words in fewer than ``RARE`` of the units gain nothing by more of them. Words in more than ``MAX_SHARE``
        of all units weigh nothing, but the rarer half of each item's and each part's words always weigh, so an item
        that much of the corpus repeats is found as well as any other."""
        idf = -np.log(counts / max(units, 1) + RARE)
        common_word = counts > MAX_SHARE * units
        for w in self.targets:
            at = np.unique(np.searchsorted(self.vocabulary, w))
            common_word[at[np.argsort(counts[at], kind="stable")[: (len(at) + 1) // 2]]] = False
        self.weights = np.where(common_word, 0, np.maximum(idf, 0.1)).astype(np.float32)
        self.seldom = counts[: len(self.vocabulary)] < SELDOM * units

    def postings(self, lcs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items by seldom word (starts and items), and how many of its seldom words each item's leak must show: ``lcs``
        of all its words, less those that aren't seldom."""
        at = [np.searchsorted(self.vocabulary, w) for w in self.words]
        needed = np.array([math.ceil(lcs * len(x) - 1e-9) - (~self.seldom[x]).sum() for x in at])
        word = np.concatenate([np.unique(x[self.seldom[x]]) for x in at])
        item = np.repeat(np.arange(len(at)), [len(np.unique(x[self.seldom[x]])) for x in at])
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1)), item[order], needed

    def latent(self) -> np.ndarray:
        """Unit vectors of the items and their parts in the latent space; one that the space doesn't hold is null."""
        out = np.zeros((len(self.targets), self.basis.shape[1]), dtype=np.float32)
        for i, w in enumerate(self.targets):
            at = np.searchsorted(self.vocabulary, w)
            out[i] = self.weights[at] @ self.basis[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def leading_bits(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << LEADING, dtype=bool)
    out[(vocabulary >> U64(64 - LEADING)).astype(np.int64)] = True
    return out


class Passages:
    """Words of a block's texts as dimensions with signs, in units of ``UNIT`` words of one row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prefix: Prefix, separator: np.ndarray, vocabulary: np.ndarray, leading: np.ndarray):
        start, end, self.row = words(data, offsets, separator)
        self.hashes = prefix.of(prefix.sums(data), start, end) if len(start) else np.zeros(0, U64)
        rows = len(offsets) - 1
        self.length = np.bincount(self.row, minlength=rows)
        self.first = np.cumsum(self.length) - self.length
        place = np.arange(len(self.row)) - self.first[self.row]
        per_row = -(-self.length // UNIT)
        self.unit_first = np.cumsum(per_row) - per_row
        self.units = int(per_row.sum())
        self.unit_row = np.repeat(np.arange(rows), per_row)
        self.unit_place = np.arange(self.units) - self.unit_first[self.unit_row]
        self.unit = np.cumsum(place & (UNIT - 1) == 0) - 1  # every unit has a word
        # a first look by the leading bits of a hash settles most words that are not in the vocabulary
        maybe = np.flatnonzero(leading[(self.hashes >> U64(64 - LEADING)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocabulary, self.hashes[maybe]), max(0, len(vocabulary) - 1))
        found = vocabulary[at] == self.hashes[maybe] if len(vocabulary) else np.zeros(0, dtype=bool)
        self.dim = len(vocabulary) + (self.hashes & U64(REST - 1)).astype(np.int64)
        self.sign = np.where(self.hashes >> U64(63), np.float32(1), np.float32(-1))
        self.dim[maybe[found]] = at[found]
        self.sign[maybe[found]] = 1
        self.known = self.dim < len(vocabulary)

    def weighed(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that weigh, and their values."""
        value = weights[self.dim] * self.sign
        at = np.flatnonzero(value)
        return at, value[at]

    def projected(self, basis: np.ndarray, weights: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The vectors of the units that are alive times ``basis``, some words at a time."""
        out = np.zeros((self.units, basis.shape[1]), dtype=np.float32)
        at, value = self.weighed(weights)
        pick = alive[self.unit[at]]
        at, value = at[pick], value[pick]
        dim, unit = self.dim[at], self.unit[at]
        step = max(1, CELLS // max(1, basis.shape[1]))
        lo = 0
        while lo < len(at):
            hi = min(len(at), lo + step)
            if hi < len(at):  # whole units
                hi = int(np.searchsorted(unit, unit[hi - 1], side="left")) if unit[hi - 1] > unit[lo] else int(np.searchsorted(unit, unit[lo], side="right"))
            start = runs(unit[lo:hi])[0]
            out[unit[lo:hi][start]] = np.add.reduceat(basis[dim[lo:hi]] * value[lo:hi, None], start, axis=0)
            lo = hi
        return out

    def alive(self, seen: np.ndarray, needed: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Windows whose surroundings may hold as many seldom words as some item needs, by counts of cells of 8 units: from
        the first cell of a window's surroundings that has a word on, the cells of that width must hold enough."""
        if (needed <= 0).any():
            return np.ones(self.units, dtype=bool)
        cells = (self.units >> 3) + 1
        key, many = np.unique(seen // self.units * cells + (seen % self.units >> 3), return_counts=True)
        total = np.concatenate([[0], np.cumsum(many)])
        item, cell = np.divmod(key, cells)
        last = np.minimum(cell + (2 + 2 * reach[item] + 7) // 8 + 1, cells - 1)
        enough = total[np.searchsorted(key, item * cells + last, side="right")] - total[:-1] >= needed[item]
        first, width = 8 * cell[enough], reach[item[enough]] + 2
        mark = np.zeros(self.units + 1, dtype=np.int64)
        np.add.at(mark, np.clip(first - width, 0, self.units), 1)
        np.add.at(mark, np.clip(first + 8 + width, 0, self.units), -1)
        return np.cumsum(mark[:-1]) > 0

    def shared(self, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Where the items' seldom words stand: item times number of units plus unit, sorted."""
        known = np.flatnonzero(self.known)
        word = self.dim[known]
        many = starts[word + 1] - starts[word]
        pick = many > 0
        known, word, many = known[pick], word[pick], many[pick]
        item = items[np.repeat(starts[word] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        return np.sort(item * self.units + np.repeat(self.unit[known], many))


def common(region: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence with an item of n words, bit-parallel: the item's places left as they fill."""
    full = (1 << n) - 1
    v = full
    for h in region.tolist():
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        out[h] = out.get(h, 0) | 1 << i
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): each document with each item that it leaks, at its best passage.

    Words are runs of letters, digits and non-ASCII bytes, lower-cased. A pair is a leak if ``lcs`` of the item's
    words follow each other in the passage's surroundings in the item's order and ``answer`` of its last quarter do too,
    or if 0.85 of all words do. Items without words and null or empty texts match nothing; repeated rows give repeated
    results; equal items are each reported; columns of ``docs`` beyond the two are left out. Texts are never shuffled or
    cut: three scans for each ``ITEM_BLOCK`` items, or fewer that hold ``ITEM_CHARS`` characters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, own = benchmark.schema[item_id].dataType.simpleString(), base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, item_id {kind}, cosine double, lcs double, answer double"
    out, held, size = None, [], 0

    def block(rows: list) -> DataFrame | None:
        items = Items([r[0] for r in rows], [r[1] for r in rows])
        if not items.ids:
            return None
        _weigh(base, items)
        _span(base, items, rank)
        return _search(base, items, schema, cosine, lcs, answer)

    for row in benchmark.select(item_id, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        held.append(row)
        size += len(row[1])
        if len(held) == ITEM_BLOCK or size >= ITEM_CHARS:
            found, held, size = block(held), [], 0
            out = found if out is None else out if found is None else out.unionByName(found)
    found = block(held) if held else None
    out = found if out is None else out if found is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _packed_sum(total: np.ndarray, step: int) -> pa.RecordBatch:
    """Rows of a table as one binary value for each ``step`` of them that aren't all null."""
    at = [i for i in range(0, len(total), step) if total[i : i + step].any()]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), binary([np.ascontiguousarray(total[i : i + step]).tobytes() for i in at])], names=["at", "data"])


def _summed(parts: DataFrame, kind: type, shape: tuple[int, ...], step: int) -> np.ndarray:
    """Sum of packed tables, by distributed sums of each packed part."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table["data"]:
            values = np.frombuffer(x.as_buffer(), dtype=kind).astype(np.float64)
            total = values if total is None else total + values
        return pa.table({"at": table["at"].slice(0, 1), "data": binary([total.tobytes()])})

    out = np.zeros(shape)
    for row in parts.groupBy("at").applyInArrow(add, "at long, data binary").collect():  # a table of the vocabulary: bounded by the benchmark
        values = np.frombuffer(row["data"], dtype=np.float64).reshape(-1, *shape[1:])
        out[row["at"] : row["at"] + len(values)] = values
    return out


def _weigh(base: DataFrame, items: Items) -> None:
    vocabulary, size = items.vocabulary, items.size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator, leading = Prefix(), punctuation(), leading_bits(vocabulary)
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets, _ in blocks(lowered(batch.column(0))):
                p = Passages(data, offsets, prefix, separator, vocabulary, leading)
                total[:-1] += np.bincount(p.dim, minlength=size)
                total[-1] += p.units
        yield _packed_sum(total, 1 << 16)

    total = _summed(base.select("text").mapInArrow(counted, "at long, data binary"), np.int64, (size + 1,), 1 << 16)
    items.weigh(int(total[-1]), total[:-1])


def sparse_test_matrix(size: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random test matrix: for each dimension ``NONZEROS`` columns and signs."""
    rng = np.random.default_rng(11)
    return rng.integers(0, columns, (NONZEROS, size)), rng.choice(np.array([-1, 1], dtype=np.float32), (NONZEROS, size))


def _span(base: DataFrame, items: Items, rank: int) -> None:
    """The latent basis, from the sum over all passages of each passage's vector times its product with the test matrix."""
    size, columns = items.size, min(items.size, rank + OVERSAMPLE)
    column, sign = sparse_test_matrix(size, columns)
    weights, vocabulary = items.weights, items.vocabulary

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator, leading = Prefix(), punctuation(), leading_bits(vocabulary)
        total = np.zeros((size, columns), dtype=np.float32)
        for batch in batches:
            for _, _, data, offsets, _ in blocks(lowered(batch.column(0))):
                p = Passages(data, offsets, prefix, separator, vocabulary, leading)
                if not p.units:
                    continue
                # passages side by side: each word once
                at, value = p.weighed(weights)
                dim, passage = p.dim[at], (np.cumsum(p.unit_place % (PASSAGE // UNIT) == 0) - 1)[p.unit[at]]
                first = range(int(passage[-1]) + 1 if len(passage) else 0)
                norm = np.sqrt(np.bincount(passage, weights=value.astype(np.float64) ** 2, minlength=len(first)))
                value = value / np.where(norm > 0, norm, 1)[passage].astype(np.float32)
                product = sum(np.bincount(passage * columns + column[k][dim], weights=value * sign[k][dim], minlength=len(first) * columns) for k in range(NONZEROS))
                product = product.reshape(-1, columns).astype(np.float32)
                order = np.argsort(dim.astype(np.uint16) if size < 1 << 16 else dim, kind="stable")  # short keys sort in linear time
                dim, value, passage = dim[order], value[order], passage[order]
                step = CELLS // columns
                for lo in range(0, len(dim), step):
                    d = dim[lo : lo + step]
                    start = runs(d)[0]
                    total[d[start]] += np.add.reduceat(product[passage[lo : lo + step]] * value[lo : lo + step, None], start, axis=0)
        yield _packed_sum(total, 256)

    sketch = _summed(base.select("text").mapInArrow(multiplied, "at long, data binary"), np.float32, (size, columns), 256)
    items.basis = latent_basis(sketch, column, sign, rank)


def latent_basis(sketch: np.ndarray, column: np.ndarray, sign: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors over their singular values, from the Gram matrix times the test matrix."""
    core = np.zeros((sketch.shape[1], sketch.shape[1]))
    for k in range(NONZEROS):
        np.add.at(core, column[k], sign[k][:, None] * sketch)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    half = sketch @ (vector[:, keep] / np.sqrt(value[keep]))  # half times its transpose is Nystroem's approximation
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    keep = s > 1e-3 * max(s.max(initial=0), 1e-12)
    return (u[:, keep] / s[keep]).astype(np.float32)


def _search(base: DataFrame, items: Items, schema: str, cosine: float, lcs: float, answer: float) -> DataFrame:
    targets = items.latent()
    starts, posted, needed = items.postings(lcs)
    n_words = np.array([len(w) for w in items.words])
    reach = -(-n_words // UNIT)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, separator, leading = Prefix(), punctuation(), leading_bits(items.vocabulary)
        masks = [places(w) for w in items.words]
        tails = [w[-max(1, len(w) // 4) :] for w in items.words]
        tail_masks = [places(w) for w in tails]
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for lo, _, data, offsets, _ in blocks(lowered(batch.column(1)), BLOCK_BYTES):
                p = Passages(data, offsets, prefix, separator, items.vocabulary, leading)
                if not p.units or not items.basis.shape[1]:
                    continue
                seen = p.shared(starts, posted)
                alive = p.alive(seen, needed, reach)
                at = np.flatnonzero(alive)
                if not len(at):
                    continue
                alive[1:] |= alive[:-1].copy()  # a window is a unit and the one after it
                units = p.projected(items.basis, items.weights, alive)
                after = at[:-1] if at[-1] == p.units - 1 else at
                after = after[p.unit_row[after + 1] == p.unit_row[after]]
                vectors = units[at]
                vectors[np.searchsorted(at, after)] += units[after + 1]
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                first_unit = p.unit_first[p.unit_row]
                end_unit = np.append(p.unit_first[1:], p.units)[p.unit_row]
                for a in range(0, len(targets), TARGET_STEP):
                    block = targets[a : a + TARGET_STEP]
                    i0, i1 = int(items.owner[a]), int(items.owner[a + len(block) - 1]) + 1
                    own = seen[slice(*np.searchsorted(seen, [i0 * p.units, i1 * p.units]))]
                    cells = (p.units >> 3) + 1  # of 8 units: a first bound without a search
                    coarse = np.bincount((own // p.units - i0) * cells + (own % p.units >> 3), minlength=(i1 - i0) * cells).reshape(-1, cells)
                    coarse = np.concatenate([np.zeros((i1 - i0, 1), dtype=np.int64), np.cumsum(coarse, axis=1)], axis=1)
                    step = max(1, CELLS // len(block))
                    pairs: dict[tuple[int, int], float] = {}
                    for u in range(0, len(at), step):
                        score = vectors[u : u + step] @ block.T
                        window, t = np.divmod(np.flatnonzero(score >= cosine), len(block))
                        item, score, window = items.owner[a + t], score[window, t], at[window + u]
                        left = np.maximum(first_unit[window], window - reach[item])
                        right = np.minimum(end_unit[window], window + WINDOW // UNIT + reach[item])
                        may = np.flatnonzero(coarse[item - i0, (right + 7) >> 3] - coarse[item - i0, left >> 3] >= needed[item])
                        item, score, window, left, right = (x[may] for x in (item, score, window, left, right))
                        enough = np.searchsorted(seen, item * p.units + right) - np.searchsorted(seen, item * p.units + left) >= needed[item]
                        for i, j, c in zip(window[enough].tolist(), item[enough].tolist(), score[enough].tolist(), strict=True):
                            pairs[i, j] = max(c, pairs.get((i, j), -1.0))
                    for (i, j), c in pairs.items():
                        row, n = int(p.unit_row[i]), int(n_words[j])
                        left = int(p.first[row] + (max(first_unit[i], i - reach[j]) - first_unit[i]) * UNIT)
                        right = min(int(p.first[row] + p.length[row]), int(p.first[row] + (i + WINDOW // UNIT + reach[j] - first_unit[i]) * UNIT))
                        region = p.hashes[left:right][p.known[left:right]]  # other words are in no item
                        share = common(region, masks[j], n) / n
                        if share < lcs:
                            continue
                        closing = common(region, tail_masks[j], len(tails[j])) / len(tails[j])
                        if share >= 0.85 or closing >= answer:
                            best = (share, closing, min(1.0, c))
                            found[lo + row, j] = max(found.get((lo + row, j), best), best)
            rows_, which = [k[0] for k in found], [k[1] for k in found]
            ids = batch.column(0).take(pa.array(rows_, pa.int64()))
            kind = pa.array(items.ids).type
            yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[j] for j in which], kind), pa.array([v[2] for v in found.values()], pa.float64()), pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.float64())], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return base.mapInArrow(searched, schema)


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
