"""Exact Jaccard self-join of word n-gram sets by a pigeonhole over a partitioned universe.

Two sets whose symmetric difference is at most H agree in one of H + 1 parts of the universe. Sets are banded by size;
for each band that a set's larger partners may lie in, the hashed universe is cut into segments with thresholds, both by
cost. Large sets use many segments of threshold 0, of which only those with enough members are indexed: a set with more
such segments than H is found by them, whatever the rest, and shared single n-grams make no candidates. Small sets use
few segments of threshold 1, which emit their one-deletion neighbourhoods and stand for two units of H each. A set that
falls short is cut again by another hash, and at last indexed with all its segments, empty ones too.

Near copies are joined to classes before the index is asked: sets that agree in three minima meet the least of them, and
only pairs that hold when compared exactly count. Signatures then carry classes, so a cluster of any size costs a
signature one entry, and only signatures that lie in several classes make candidates. Of candidate classes, pairs of sets
that sizes and parity bitmaps (a lower bound of the difference) don't rule out are compared exactly, leaving out pairs
within a class, and the links found join classes to components. Texts are read again for such pairs only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.llm.blocks import U64, Prefix, binary, blocks, framed, mix, ngrams, pack_sorted, release, row_sets, runs, space_table, unframed, unpack_sorted, words
from quorumlake.llm.components import components
from quorumlake.runtime import broadcast_if_small, discard, materialize, parallelism, small_batches

SEEDS = 3  # partitions tried; the last one indexes all segments
TILE_SETS, TILE_VALUES = 20_000, 4_000_000
BIT_SETS, BIT_VALUES = 1_000, 4_000_000  # sets, and members that their bitmaps stand for, in a tile of bitmaps
MOST_PAIRS = 16  # possible links that a tile names one by one, a set
STAR_SETS, STAR_VALUES = 2_000, 1_000_000  # of one centre in one task
FLUSH = 1_000_000
LEAST_BUCKETS = 64
BANDS, BINS = 4, 3  # near copies are tried by 4 keys of 3 minima
NODE = "struct<k1:bigint,k2:bigint>"
SENT = "bucket long, g long, kind long, k1 long, k2 long, data binary"


class Bands:
    """Size bands for a threshold num / den: segments, how many of them are loose, and the least size indexed."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den, self.low = num, den, [1]
        while len(self.low) < 4 or self.low[-4] <= largest:  # a set meets its own band and the two above
            self.low.append(int(self.low[-1] * math.sqrt(den / num)) + 1)
        self.low = np.array(self.low, dtype=np.int64)
        self.high = self.low[1:] - 1
        plans = [self.plan(int(lo), int(hi)) for lo, hi in zip(self.low[:-1], self.high, strict=True)]
        self.segments, self.loose, self.least = (np.array(x, dtype=np.int64) for x in zip(*plans, strict=True))

    def need(self, size: int | np.ndarray, high: int | np.ndarray) -> int | np.ndarray:
        """One more than the differences that linked sets of this size and at most ``high`` can have."""
        return (self.den - self.num) * (size + high) // (self.den + self.num) + 1

    def plan(self, lo: int, hi: int) -> tuple[int, int, int]:
        """Segments, loose ones, least indexed size: the largest least size that most sets of the band can meet,
        then the fewest segments; loose segments where few units are needed, as their neighbourhoods then cost little."""
        most = self.need(hi, hi)
        if most <= 8:
            return -(-most // 2), most // 2, 1
        for least in (3, 2, 1):
            for segments in range(most, 3 * most, max(1, most // 16)):
                if all(self.enough(size, segments, least, self.need(size, hi)) for size in (-(-lo * self.num // self.den), lo, hi)):
                    return segments, 0, least
        return most, 0, 1

    @staticmethod
    def enough(size: int, segments: int, least: int, need: int) -> bool:
        """Whether a set of this size has ``need`` segments of ``least`` members but for one set in six or so."""
        mean = size / segments
        full = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
        return segments * full - math.sqrt(segments * full * (1 - full)) >= need

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


class Shingler:
    """Distinct word n-gram hashes per row of a text column."""

    def __init__(self, n: int):
        self.n, self.prefix, self.separator = n, Prefix(lower=True), space_table()

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, row = words(data, offsets, self.separator)
        if not len(start):
            return np.zeros(0, dtype=U64), row
        hashed = self.prefix.of(self.prefix.sums(data), start, end)
        values, at = ngrams(hashed, row, self.n)
        values, rows = [values], [row[at]]
        count = np.bincount(row, minlength=len(offsets) - 1)[row]
        for k in range(1, self.n):  # shorter texts: all their words as one
            few = np.flatnonzero(count == k)
            if len(few):
                v, at = ngrams(hashed[few], row[few], k)
                values.append(v)
                rows.append(row[few][at])
        return row_sets(np.concatenate(values), np.concatenate(rows))


def set_keys(values: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit sum hash of each row's set."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(mix(values + U64(salt)), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]]))
    return np.diff(bounds), out[0], out[1]


def signatures(values: np.ndarray, row: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and the rows they are of. ``values`` are sorted by row and value."""
    out_sig, out_row = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    own, n_rows = bands.of(np.maximum(sizes, 1)), len(sizes)
    hashed = mix(values ^ U64(0xA54FF53A5F1D36F1))

    def emit(values: np.ndarray, hashed: np.ndarray, row: np.ndarray, band: np.ndarray, seed: int) -> None:
        if not len(values):
            return
        per_row = bands.segments[band]
        segment = (((values >> U64(32)) * per_row.astype(U64)[row]) >> U64(32)).astype(np.int64)
        change = np.ones(len(values), dtype=bool)
        change[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
        start = np.flatnonzero(change)
        srow, sseg, many = row[start], segment[start], np.diff(np.append(start, len(values)))
        total = np.add.reduceat(hashed, start)
        place = mix((band[srow].astype(U64) << U64(40)) + (sseg.astype(U64) << U64(4)) + U64(seed))
        loose = sseg < bands.loose[band[srow]]
        last = seed + 1 == SEEDS
        send = loose | (many >= bands.least[band[srow]]) | last
        out_sig.append(mix(total[send] + place[send]))
        out_row.append(srow[send])
        if loose.any():  # a variant meets equal variants and whole segments
            member = np.repeat(np.arange(len(start)), many)
            pick = loose[member]
            pick &= many[member] > 1
            out_sig.append(mix(total[member[pick]] - hashed[pick] + place[member[pick]]))
            out_row.append(row[pick])
        units = np.where(loose, np.where(many > 1, 2, 0), many >= bands.least[band[srow]])
        units = np.bincount(srow, weights=units, minlength=n_rows)
        late = (np.bincount(row, minlength=n_rows) > 0) & (units < bands.need(sizes, bands.high[band]))
        if not late.any():
            return
        if not last:
            pick = late[row]
            again = mix(values[pick] + U64(0x3C6EF372FE94F82B))
            order = np.lexsort((again, row[pick]))
            emit(again[order], hashed[pick][order], row[pick][order], band, seed + 1)
        else:
            here = late[srow]
            for r, lo, hi in zip(srow[here][runs(srow[here])[0]].tolist(), *runs(srow[here]), strict=True):
                gone = np.setdiff1d(np.arange(per_row[r]), sseg[here][lo:hi])
                out_sig.append(mix(mix((U64(band[r]) << U64(40)) + (gone.astype(U64) << U64(4)) + U64(seed))))
                out_row.append(np.full(len(gone), r))
            single = here & loose & (many == 1)  # whose only variant is empty
            out_sig.append(mix(place[single]))
            out_row.append(srow[single])

    for up in range(3):
        band = own + up
        can = (sizes > 0) & (sizes * bands.den >= bands.low[band] * bands.num)
        pick = can[row]
        emit(values[pick], hashed[pick], row[pick], band, 0)
    return np.concatenate(out_sig), np.concatenate(out_row)


def minima(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """``BANDS`` keys a row, each of the least values in ``BINS`` parts of the universe; an empty part takes the next one's."""
    none, parts = U64((1 << 64) - 1), BANDS * BINS
    least = np.full((n_rows, parts), none, dtype=U64)
    if len(values):
        part = (((values >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        least[row[first], part[first]] = values[first]
    for k in [*range(parts - 1, -1, -1)] * 2:
        empty = least[:, k] == none
        least[empty, k] = least[empty, (k + 1) % parts]
    least = least.reshape(n_rows, BANDS, BINS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), (n_rows, BANDS))
    for k in range(BINS):
        key = mix(key * U64(0xD1342543DE82EF95) + least[:, :, k])
    return key


def parities(values: np.ndarray, row: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[bytes]:
    """A bitmap a row: each value flips the bit that its hash names, so two sets differ in as many values at least as their
    bitmaps in bits. Bitmaps have a power of two of bits, some eight for each difference that linked sets of the size can have."""
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(16 * (den - num) * sizes / (den + num), 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    flipped = np.bincount(start[row] + (mix(values ^ U64(0x510E527FADE682D1)) & (bits[row] - 1).astype(U64)).astype(np.int64), minlength=start[-1]) & 1
    packed = np.packbits(flipped.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] if n else b"" for a, b, n in zip(start[:-1].tolist(), start[1:].tolist(), sizes.tolist(), strict=True)]


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) with as many words as asked for: bit k of the shorter one is the sum of those that end alike."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def possible(maps: list[bytes], size: np.ndarray, known: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with different ``known`` that sizes and bitmaps don't rule out as links."""
    words = np.array([len(m) // 8 for m in maps], dtype=np.int64)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    order = np.argsort(size, kind="stable")
    for w in np.unique(words).tolist():
        own = order[words[order] == w]
        near = order[(words[order] >= w) & (size[order] * num <= size[own].max() * den)]
        wide = np.zeros((len(near), w), dtype=U64)
        for v in np.unique(words[near]).tolist():
            pick = np.flatnonzero(words[near] == v)
            wide[pick] = folded(np.frombuffer(b"".join(maps[i] for i in near[pick]), dtype=U64).reshape(len(pick), v), w)
        place = np.empty(len(size), dtype=np.int64)
        place[near] = np.arange(len(near))
        for i in own.tolist():
            k = int(place[i])
            last = int(np.searchsorted(size[near], size[i] * den // num, side="right"))
            other = near[k + 1 : last]
            apart = known[other] != known[i]
            if apart.any():
                rest = np.flatnonzero(apart) + k + 1
                differ = np.bitwise_count(wide[rest] ^ wide[k]).sum(axis=1, dtype=np.int64)
                hit = near[rest[differ * (den + num) <= (den - num) * (size[near[rest]] + size[i])]]
                a.append(np.full(len(hit), i))
                b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def shared(center: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of the other sets (none empty) has in common with the sorted ``center``."""
    pool = np.concatenate(others)
    at = np.minimum(np.searchsorted(center, pool), len(center) - 1)
    return np.add.reduceat((center[at] == pool).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def linked(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a forest over the exact links among ``sets`` (sorted, distinct values).

    Pairs that are already connected, by an edge found before or by equal values of ``known``, are skipped. First each
    of a few centres is compared with all sets at once; what stays apart then goes through a prefix index ordered from
    rare to frequent values, one bulk comparison a member of a posting list that still holds several components.
    """
    n, forest = len(sets), []
    root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], dtype=np.int64)

    def compare(c: int, other: np.ndarray) -> None:
        other = other[(root[other] != root[c]) & (size[other] * num <= size[c] * den) & (size[c] * num <= size[other] * den)]
        if not len(other):
            return
        both = shared(sets[c], [sets[i] for i in other])
        for i in other[both * den >= num * (size[other] + size[c] - both)].tolist():
            if root[i] != root[c]:
                root[root == root[i]] = root[c]
                forest.append((c, i))

    done = np.zeros(n, dtype=bool)
    for turn in range(n if n <= 64 else 16):
        todo = np.flatnonzero(~done)
        if not len(todo) or (root == root[0]).all():
            return forest
        c = int(todo[0])
        if n > 64 and turn:  # a set that is still alone, if there is one
            alone = todo[np.bincount(root, minlength=n)[root[todo]] == 1]
            c = int(alone[0]) if len(alone) else c
        done[c] = True
        compare(c, todo)
    rest = np.flatnonzero(~done)
    if len(rest) < 2:
        return forest
    pool, owner = np.concatenate([sets[i] for i in rest]), np.repeat(np.arange(len(rest)), size[rest])
    value, inverse, count = np.unique(pool, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), dtype=np.int64)
    rank[np.lexsort((value, count))] = np.arange(len(value))
    order = np.lexsort((rank[inverse], owner))
    rank_, owner_ = rank[inverse][order], owner[order]
    begin = np.searchsorted(owner_, np.arange(len(rest)))
    keep = size[rest] - -(-size[rest] * num // den) + 1
    in_prefix = np.arange(len(owner_)) - begin[owner_] < keep[owner_]
    rank_, owner_ = rank_[in_prefix], owner_[in_prefix]
    order = np.lexsort((owner_, rank_))
    rank_, owner_ = rank_[order], owner_[order]
    for lo, hi in zip(*runs(rank_), strict=True):
        members = rest[owner_[lo:hi]]
        for i, x in enumerate(members[:-1].tolist()):
            if (root[members] == root[x]).all():
                break
            compare(x, members[i + 1 :])
    return forest


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node that isn't the least one itself."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        np.minimum.at(least, label, least.copy())  # a root takes what its members have found
        least = least[least]
        if (least == label).all():
            break
        label = least
    apart = label != np.arange(len(node))
    return node[apart], node[label[apart]]


def _fetched(base: DataFrame, needed: DataFrame, n: int, buckets: int) -> DataFrame:
    """The sets of rows that ``needed`` names (rk, k1, k2, to: array of (g, kind)), sent to the buckets of their groups g."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            met: set[tuple[int, int]] = set()
            for lo, hi, data, offsets, _ in blocks(batch.column(0)):
                values, row = shingler.sets(data, offsets)
                _, k1, k2 = set_keys(values, row, hi - lo)
                part = batch.slice(lo, hi - lo)
                own = (k1.view(np.int64) == part.column(1).to_numpy()) & (k2.view(np.int64) == part.column(2).to_numpy())  # else another row with the same hash
                bound = np.searchsorted(row, np.arange(hi - lo + 1))
                out, size = [], 0
                for j in np.flatnonzero(own).tolist():
                    key = (part.column(1)[j].as_py(), part.column(2)[j].as_py())
                    if key in met:  # repeated rows once a batch
                        continue
                    met.add(key)
                    body = values[bound[j] : bound[j + 1]].tobytes()
                    for to in part.column(3)[j].as_py():
                        out.append((to["g"] % buckets, to["g"], to["kind"], *key, body))
                        size += len(body)
                        if size > 1 << 23:
                            yield packed(out)
                            out, size = [], 0
                if out:
                    yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        *longs, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), binary(list(data))], names=["bucket", "g", "kind", "k1", "k2", "data"])

    return base.join(broadcast_if_small(needed, 96), "rk").select("text", "k1", "k2", "to").mapInArrow(gathered, SENT)


def _compared(sent: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of sets in one group; a set of kind 0 is compared with the group's set of kind 1 only, else kinds are classes."""

    def verified(table: pa.Table) -> pa.Table:
        g, kind, k1, k2 = (table[x].to_numpy() for x in ("g", "kind", "k1", "k2"))
        order = np.lexsort((k2, k1, g))
        data = table["data"].combine_chunks() if isinstance(table["data"], pa.ChunkedArray) else table["data"]
        a, b = [], []
        for lo, hi in zip(*runs(g[order]), strict=True):
            at = order[lo:hi]
            at = at[np.concatenate([[True], (k1[at[1:]] != k1[at[:-1]]) | (k2[at[1:]] != k2[at[:-1]])])]  # repeated rows once
            sets = [np.frombuffer(data[int(i)].as_buffer(), dtype=U64) for i in at]
            if kind[at].min() == 0:
                c = int(np.argmax(kind[at]))
                size = np.array([len(x) for x in sets])
                both = shared(sets[c], sets)
                found = [(c, i) for i in np.flatnonzero(both * den >= num * (size + size[c] - both)).tolist() if i != c]
            else:
                found = linked(sets, num, den, kind[at])
            a += [at[x] for x, _ in found]
            b += [at[y] for _, y in found]
        release()
        node = lambda at: pa.StructArray.from_arrays([pa.array(k1[at], pa.int64()), pa.array(k2[at], pa.int64())], ["k1", "k2"])
        return pa.table({"a": node(np.array(a, dtype=np.int64)), "b": node(np.array(b, dtype=np.int64))})

    return sent.groupBy("bucket").applyInArrow(verified, f"a {NODE}, b {NODE}")


def _near_copies(base: DataFrame, sets: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """Links found by equal minima: the sets of each key against the least one, compared exactly."""
    one = F.struct("k1", "k2", "rk", "n")
    keyed = sets.select(one.alias("s"), F.posexplode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("i", "key"))
    centers = keyed.groupBy("i", "key").agg(F.min("s").alias("c"), F.count("*").alias("many")).filter("many > 1").drop("many")
    edges = stars = materialize(keyed.join(centers, ["i", "key"]).filter("s <> c").select("c", "s").distinct(), "stars")
    links = _verified(base, edges, num, den, n)
    discard(stars)
    return links


def _verified(base: DataFrame, edges: DataFrame, num: int, den: int, n: int) -> DataFrame | None:
    """The edges (c, s: structs of k1, k2, rk, n) that are links when whole sets are compared; None without edges."""
    total = edges.agg(F.sum("s.n")).first()[0]
    if not total:
        return None
    # a centre with many others meets them in several tasks; such centres are at most one in STAR_SETS edges
    split = edges.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / STAR_SETS, F.sum("s.n") / STAR_VALUES)).alias("parts")).filter("parts > 1")
    split = broadcast_if_small(materialize(split, "centers"), 40)
    edges = edges.join(split, "c", "left").withColumn("g", F.xxhash64("c.k1", "c.k2", F.pmod(F.xxhash64("s.k1", "s.k2"), F.coalesce("parts", F.lit(1)))))
    ends = edges.select("s.rk", "s.k1", "s.k2", "g", F.lit(0).cast("long").alias("kind")).unionByName(edges.select("c.rk", "c.k1", "c.k2", "g", F.lit(1).cast("long").alias("kind")).distinct())
    needed = materialize(ends.groupBy("rk", "k1", "k2").agg(F.collect_list(F.struct("g", "kind")).alias("to")), "ends")
    buckets = max(parallelism(base.sparkSession), math.ceil(2 * total / TILE_VALUES))
    links = materialize(_compared(_fetched(base, needed, n, buckets), num, den), "links")
    discard(needed)
    return links


def _contested(base: DataFrame, classes: DataFrame, bands: Bands, n: int, total: int) -> DataFrame:
    """Candidate classes: (u, v) edges of forests over classes that share a signature. ``classes``: rk, cls of rows that aren't a class of their own."""
    # from the data alone: a class that meets others by many signatures is named once a bucket, on any cluster alike
    buckets = max(LEAST_BUCKETS, math.ceil(total / 2_000_000))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, many = Shingler(n), [], 0

        def flush() -> pa.RecordBatch:
            sig, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
            sig, cls = sig[once], cls[once]
            cut = np.searchsorted(sig, (np.arange(buckets + 1, dtype=object) * ((1 << 64) // buckets)).clip(0, (1 << 64) - 1).astype(U64))
            cut[0], cut[-1] = 0, len(sig)
            some = np.flatnonzero(np.diff(cut))
            names, which = np.unique(cls, return_inverse=True)
            parts = []
            for i in some:
                here, short = np.unique(which[cut[i] : cut[i + 1]], return_inverse=True)
                short = short.astype(np.uint16 if len(here) < 1 << 16 else np.uint32)
                parts.append(framed(pack_sorted(sig[cut[i] : cut[i + 1]]), names[here].tobytes(), short.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(some.tolist(), pa.int64()), binary(parts)], names=["bucket", "data"])

        for batch in batches:
            for lo, hi, data, offsets, _ in blocks(batch.column(0)):
                values, row = shingler.sets(data, offsets)
                size, k1, _ = set_keys(values, row, hi - lo)
                given = batch.column(1).slice(lo, hi - lo)
                cls = np.where(np.asarray(given.is_null()), k1, given.fill_null(0).to_numpy().view(U64))
                _, first = np.unique(k1, return_index=True)  # equal sets of a block once
                one = np.zeros(hi - lo, dtype=bool)
                one[first] = True
                sig, of = signatures(values[one[row]], row[one[row]], size, bands)
                held.append((sig, cls[of]))
                many += len(sig)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    def grouped(table: pa.Table) -> pa.Table:
        sig, cls = [], []
        for part in table["data"]:
            packed, names, short = unframed(part.as_py())
            names = np.frombuffer(names, dtype=U64)
            sig.append(unpack_sorted(packed))
            cls.append(names[np.frombuffer(short, np.uint16 if len(names) < 1 << 16 else np.uint32)])
        sig, cls = np.concatenate(sig), np.concatenate(cls)
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        again = np.flatnonzero((sig[1:] == sig[:-1]) & (cls[1:] != cls[:-1])) + 1  # neighbours in a run of one signature
        u, v = forest_of(cls[again].view(np.int64), cls[again - 1].view(np.int64))
        del sig, cls, order
        release()
        return pa.table({"a": u, "b": v})

    rows = base.join(broadcast_if_small(classes, 32), "rk", "left").select("text", "cls")
    return rows.mapInArrow(signed, "bucket long, data binary").groupBy("bucket").applyInArrow(grouped, "a long, b long")


def _possible_pairs(rows: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (c, s) of sets in different classes of one group that bitmaps don't rule out; and, with null c and s, the tiles ``g``
    that have too many such pairs to name them. ``members`` has rk, k1, k2, cls, and ``to``, the tiles that a set is compared in."""
    bits = rows.join(broadcast_if_small(members.select("rk", "k1", "k2"), 48), ["rk", "k1", "k2"]).groupBy("rk", "k1", "k2").agg(F.first("n").alias("n"), F.first("par").alias("par"))
    tiles = bits.join(members.select("rk", "k1", "k2", "cls", F.explode("to").alias("g")), ["rk", "k1", "k2"])

    def paired(table: pa.Table) -> pa.Table:
        g, k1, k2, rk, n, cls = (table[c].to_numpy() for c in ("g", "k1", "k2", "rk", "n", "cls"))
        maps = table["par"].to_pylist()
        order, a, b, dense = np.lexsort((k2, k1, g)), [], [], []
        for lo, hi in zip(*runs(g[order]), strict=True):
            at = order[lo:hi]
            x, y = possible([maps[i] for i in at.tolist()], n[at], cls[at], num, den)
            if len(x) > MOST_PAIRS * len(at):
                dense.append(int(g[at[0]]))
                continue
            a.append(at[x])
            b.append(at[y])
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b))
        gone = np.concatenate([np.zeros(len(a), dtype=bool), np.ones(len(dense), dtype=bool)])

        def node(at: np.ndarray) -> pa.Array:
            at = np.concatenate([at, np.zeros(len(dense), dtype=np.int64)])
            return pa.StructArray.from_arrays([pa.array(v[at]) for v in (k1, k2, rk, n)], ["k1", "k2", "rk", "n"], mask=pa.array(gone))

        return pa.table({"c": node(a), "s": node(b), "g": pa.array(np.concatenate([g[a], np.array(dense, dtype=np.int64)]))})

    one = "struct<k1:bigint,k2:bigint,rk:bigint,n:bigint>"
    return tiles.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(4 * parallelism(rows.sparkSession)))).groupBy("bucket").applyInArrow(paired, f"c {one}, s {one}, g long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Half of what a row is known by: its id and text; rows that agree in both are one for every decision."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def other_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The other half, by another seed: at 10^10 rows two different ones are expected to share 64 bits, but not 128."""
    return F.xxhash64(F.lit("other"), F.col(text), F.col(doc_id))


def _tiled(members: DataFrame, sets: int, values: int) -> DataFrame:
    """``members`` with the tiles that they are compared in: a group of candidate classes that is too large for one is cut into
    parts, each pair of which has a tile."""
    weight = members.groupBy("together").agg(F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / values)).alias("tiles"))
    mine = F.pmod(F.col("node.k2"), F.col("tiles"))
    tiled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda other: F.xxhash64("together", F.least(mine, other), F.greatest(mine, other)))
    return members.join(weight, "together").select("rk", "node.k1", "node.k2", "n", "cls", "together", "node", tiled.alias("to"))


def _links(base: DataFrame, rows: DataFrame, members: DataFrame, num: int, den: int, n: int) -> list[DataFrame | None]:
    """Links between candidate classes. Bitmaps, which never rule out a link, choose the pairs whose texts are read again and
    compared; only groups in which very many pairs are possible are compared as a whole, tile by tile."""
    pairs = materialize(_possible_pairs(rows, _tiled(members, BIT_SETS, BIT_VALUES), num, den), "pairs")
    named = _verified(base, pairs.filter("c IS NOT NULL").select("c", "s").distinct(), num, den, n)
    dense = pairs.filter("c IS NULL").select("g").distinct()
    if not dense.limit(1).count():
        discard(pairs)
        return [named]
    small = _tiled(members, BIT_SETS, BIT_VALUES).select("together", F.explode("to").alias("g"))
    crowded = materialize(small.join(dense, "g", "left_semi").select("together").distinct(), "crowded")
    whole = _tiled(members.join(crowded, "together", "left_semi"), TILE_SETS, TILE_VALUES)
    kind = F.when(F.col("cls") == 0, 1).otherwise(F.col("cls"))
    needed = materialize(whole.select("rk", "k1", "k2", "n", F.transform("to", lambda g: F.struct(g.alias("g"), kind.alias("kind"))).alias("to")), "candidates")
    moved = needed.agg(F.sum(F.col("n") * F.size("to"))).first()[0]
    buckets = max(parallelism(base.sparkSession), math.ceil(moved / TILE_VALUES))
    links = materialize(_compared(_fetched(base, needed.drop("n"), n, buckets), num, den), "links")
    discard(pairs, crowded, needed)
    return [named, links]


def similar_sets(docs: DataFrame, num: int = 85, den: int = 100, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, rk and rq (``row_key``, ``other_key``), n (shingles), component.

    The component is named by one of its sets. It is null for null texts and those without words, which have no shingles;
    repeated rows, and rows with equal sets, have the same one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumns({"rk": row_key(), "rq": other_key()})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for lo, hi, data, offsets, _ in blocks(batch.column(1)):
                values, row = shingler.sets(data, offsets)
                size, k1, k2 = set_keys(values, row, hi - lo)
                least = minima(values, row, hi - lo).view(np.int64)
                bits = binary(parities(values, row, size, num, den))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), bits, *(pa.array(least[:, i].copy()) for i in range(BANDS))], names=["doc_id", "rk", "rq", "n", "k1", "k2", "par", *(f"b{i}" for i in range(BANDS))])

    rows = materialize(base.mapInArrow(keys, "doc_id long, rk long, rq long, n long, k1 long, k2 long, par binary, " + ", ".join(f"b{i} long" for i in range(BANDS))), "rows")
    facts = rows.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    if not facts["largest"]:
        return rows.select("doc_id", "rk", "rq", "n", F.lit(None).cast(NODE).alias("component"))
    sets = materialize(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("rk").alias("rk"), F.max("n").alias("n"), *(F.max(f"b{i}").alias(f"b{i}") for i in range(BANDS))), "sets")
    node = F.struct("k1", "k2")
    near = _near_copies(base, sets, num, den, n)
    classes = spark.createDataFrame([], f"node {NODE}, root {NODE}") if near is None else components(near)
    labelled = materialize(sets.select(node.alias("node"), "rk", "n").join(classes, "node", "left").select("node", "rk", "n", F.coalesce("root", "node").alias("root")), "classes")
    several = labelled.filter("root <> node").select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("root.k1").alias("cls"))
    exceptions = materialize(rows.join(several, ["k1", "k2"]).select("rk", "cls").distinct(), "exceptions")
    candidates = components(_contested(base, exceptions, Bands(num, den, int(facts["largest"])), n, facts["total"]))
    discard(exceptions)
    members = materialize(labelled.withColumn("cls", F.col("root.k1")).join(candidates.select(F.col("node").alias("cls"), F.col("root").alias("together")), "cls").select("node", "rk", "n", "cls", "together"), "members")
    links = [found for found in _links(base, rows, members, num, den, n) if found is not None]
    discard(members)
    if links:
        edges = labelled.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")
        found = components(reduce(DataFrame.unionByName, links, edges))
        discard(*links)
        labelled = labelled.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = labelled.select("node.k1", "node.k2", F.col("root").alias("component"))
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", "rk", "rq", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"))


def similar_components(docs: DataFrame, num: int = 85, den: int = 100, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. Texts with fewer than ``n`` words have one
    shingle, their whole sequence; empty and null texts have none and are linked with nothing. Repeated rows and equal
    sets are one class, rows that repeat a doc_id with another text are rows of their own; component_id is the smallest
    doc_id reachable, null where no row of the component has an id. Memory of a task: one block or text, one bucket of
    signatures, or one tile of sets; candidate classes beyond ``TILE_SETS`` sets are split into blocks, each pair of
    which is a tile of its own. Sets are told apart by 128-bit hashes.
    """
    rows = similar_sets(docs, num, den, n, doc_id, text)
    least = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100, 4)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(m.c, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT u, min(v) AS c FROM r GROUP BY 1) m ON m.u = w.doc_id
"""
