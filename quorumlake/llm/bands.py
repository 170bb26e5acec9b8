"""Join of lines to items on near prices: difference arrays over sorted distinct prices, and a bounded outward search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quorumlake.llm.blocks import runs
from quorumlake.runtime import materialize

CENTS, PER_MILLE = 50, 5  # a pair's gap is at most CENTS, or PER_MILLE thousandths of the smaller price
TOP = 10
LEAST = -(1 << 63)  # stands for a null line_no, which sorts first
MOST = 1e13  # amounts and prices beyond are no money; they never pair
CHUNK = 1 << 18  # rows that a task thins out at once


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null for null, NaN and what is beyond MOST."""
    return F.when(F.abs(x) <= MOST, F.floor(F.lit(100.0) * x + F.lit(0.5)).cast("long"))


def unit_price(amount: Column, quantity: Column) -> Column:
    """floor((2 * amount + quantity) / (2 * quantity)) in integers; null if the quantity is 0."""
    q = quantity.cast("long")
    top, bottom = F.signum(q).cast("long") * (2 * amount + q), F.nullif(F.abs(2 * q), F.lit(0).cast("long"))
    return F.call_function("div", top - F.pmod(top, bottom), bottom)


def lowest(u: Column) -> Column:
    """The lowest price that a line of unit price ``u`` pairs with: gap <= 50, or 1005 * price >= 1000 * u."""
    scale = F.lit(1000 + PER_MILLE).cast("long")
    return F.least(u - CENTS, F.call_function("div", 1000 * u + F.pmod(-1000 * u, scale), scale))


def highest(u: Column) -> Column:
    scale = F.lit(1000).cast("long")
    top = (1000 + PER_MILLE) * u
    return F.greatest(u + CENTS, F.call_function("div", top - F.pmod(top, scale), scale))


def bucket(v: Column) -> Column:
    """Buckets of 32 cents below 4096, and 64 for each doubling beyond: increasing in ``v``, and a band spans a few of them."""

    def of(x: Column) -> Column:
        shift = F.length(F.bin(x)) - 7
        at = F.call_function("div", x, F.call_function("pow", F.lit(2), F.greatest(shift, F.lit(5))).cast("long"))
        return F.when(shift <= 5, at).otherwise(128 + (shift - 6) * 64 + at - 64)

    return F.when(v >= 0, of(v)).otherwise(-1 - of(-1 - v)).cast("long")


def paired(u: Column, p: Column) -> Column:
    gap = F.abs(u - p)
    return (gap <= CENTS) | (1000 * gap <= PER_MILLE * F.least(u, p))


def first_ranks(group: np.ndarray, most: int) -> np.ndarray:
    """Mask of the first ``most`` rows of each run of equal ``group``."""
    start, end = runs(group)
    return np.arange(len(group)) - np.repeat(start, end - start) < most


def thinned(u: np.ndarray, item: np.ndarray, top: int) -> np.ndarray:
    """Of rows in order, places of each unit price's first 2 * top among its items' first ``top``: whichever one item is
    left out, the first ``top`` of the others are there."""
    run = np.cumsum(np.concatenate([[0], u[1:] != u[:-1]])) if len(u) else u
    by_item = np.lexsort((item, run))
    pair = run[by_item] * 2
    pair = np.cumsum(np.concatenate([[0], (pair[1:] != pair[:-1]) | (item[by_item][1:] != item[by_item][:-1])])) if len(u) else pair
    keep = np.sort(by_item[first_ranks(pair, top)])
    return keep[first_ranks(run[keep], 2 * top)]


CELL = "u long, item_id long, n long, crc long, sales array<long>, nos array<long>, items array<long>"


def _cells(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Of lines sorted by unit price and order: a row for each (u, item) with count and checksums, and one for each u, without
    item, with these and its thinned-out lines. Rows of a chunk are complete in themselves; later sums add them up."""

    def lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))

    def cells(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        u, sale, no, item, crc = (table[c].to_numpy() for c in ("u", "sale_id", "line_no", "item_id", "crc"))
        start, end = runs(u)
        keep = thinned(u, item, top)
        size = np.bincount(np.searchsorted(start, keep, side="right") - 1, minlength=len(start))
        yield pa.RecordBatch.from_arrays([
            pa.array(u[start]), pa.nulls(len(start), pa.int64()), pa.array(end - start), pa.array(np.add.reduceat(crc, start)),
            *[lists(x[keep], size) for x in (sale, no, item)],
        ], names=names)
        order = np.lexsort((item, u))
        u, item, crc = u[order], item[order], crc[order]
        start = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (item[1:] != item[:-1])]))
        none = pa.nulls(len(start), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(u[start]), pa.array(item[start]), pa.array(np.diff(np.append(start, len(u)))), pa.array(np.add.reduceat(crc, start)), none, none, none], names=names)

    names = [x.split()[0] for x in CELL.split(", ")]
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from cells(held)
            held = []
    if held:
        yield from cells(held)


def nearest(p: int, top: int, u: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places of the first 2 * top lines, ``top`` an item at most, by distance from ``p``; lines are sorted by ``u`` and order.

    The search goes outward from ``p`` within the band and doubles its reach until enough are found.
    """
    floor_, ceil_ = min(p - CENTS, -((-1000 * p) // (1000 + PER_MILLE))), max(p + CENTS, (1000 + PER_MILLE) * p // 1000)
    a, b, at = (int(np.searchsorted(u, x, side=s)) for x, s in ((floor_, "left"), (ceil_, "right"), (p, "right")))
    reach = 2 * top
    while True:
        lo, hi = max(a, at - reach), min(b, at + reach)
        lo = max(a, int(np.searchsorted(u, u[lo], side="left"))) if lo < at else lo  # whole unit prices
        hi = min(b, int(np.searchsorted(u, u[hi - 1], side="right"))) if hi > at else hi
        gap = np.abs(u[lo:hi] - p)
        cut = [int(p - u[lo])] if a < lo else []  # beyond these gaps more lines may follow
        cut += [int(u[hi - 1] - p)] if hi < b else []
        sure = min(cut, default=None)
        order = np.argsort(gap, kind="stable")  # of one gap the lower unit price comes first, then order
        if sure is not None:
            order = order[: np.searchsorted(gap[order], sure, side="right")]
        found = lo + order
        rank = np.lexsort((np.arange(len(found)), item[found]))
        kept = np.zeros(len(found), dtype=bool)
        kept[rank] = first_ranks(item[found][rank], top)
        found = found[kept][: 2 * top]
        if len(found) == 2 * top or sure is None:
            return found
        reach *= 2


NEAR = ["gap", "u", "sale_id", "line_no", "line_item_id"]
BAND = f"p long, n_pairs long, gap_sum long, lines_crc long, near array<struct<{','.join(f'{x}:long' for x in NEAR)}>>"


def _band(part: pa.Table, top: int) -> pa.Table:
    """Sums and nearest lines of each distinct price of a bucket, from all the cells whose prices can be in it."""
    price = np.asarray(part["n"].is_null())
    cell = part.filter(pa.array(~price))
    prices = np.unique(part["v"].to_numpy()[price])
    u, n, crc, lo, hi = (cell[c].to_numpy().astype(np.int64) for c in ("v", "n", "crc", "lo", "hi"))
    sums = {}
    for side, first, end in (("low", np.searchsorted(prices, lo), np.searchsorted(prices, u, side="right")), ("high", np.searchsorted(prices, u, side="right"), np.searchsorted(prices, hi, side="right"))):
        steps = np.zeros((3, len(prices) + 1), dtype=np.int64)
        for row, x in zip(steps, (n, n * u, crc), strict=True):
            np.add.at(row, first, x)
            np.subtract.at(row, end, x)
        sums[side] = np.cumsum(steps, axis=1)[:, :-1]
    low, high = sums["low"], sums["high"]
    gaps = low[1] - low[0] * prices + high[0] * prices - high[1]
    lines = [np.repeat(u, pc.list_value_length(cell["sales"]).to_numpy().astype(np.int64)), *[pc.list_flatten(cell[c]).to_numpy().astype(np.int64) for c in ("sales", "nos", "items")]]
    order = np.lexsort(lines[::-1])
    lines = [x[order] for x in lines]
    found = [nearest(p, top, lines[0], lines[3]) for p in prices.tolist()]
    at = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
    size = np.array([len(x) for x in found], dtype=np.int64)
    near_u, sale, no, item = (x[at] for x in lines)
    fields = [pa.array(np.abs(near_u - np.repeat(prices, size))), pa.array(near_u), pa.array(sale), pa.array(no, mask=no == LEAST), pa.array(item)]
    near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.StructArray.from_arrays(fields, names=NEAR))
    return pa.table([pa.array(prices), pa.array(low[0] + high[0]), pa.array(gaps), pa.array(low[2] + high[2]), near], names=["p", "n_pairs", "gap_sum", "lines_crc", "near"])


def _first_lines(cells: DataFrame, top: int) -> DataFrame:
    """(u, sales, nos, items): the lists of a unit price from all chunks, thinned out again to one. Tasks keep as few lines of a
    unit price before the shuffle, so one with a third of all lines costs a task what it costs any other."""
    lines = cells.select("u", F.explode(F.arrays_zip("sales", "nos", "items")).alias("l")).select("u", "l.*")
    by_item = W.partitionBy("u", "items").orderBy("sales", "nos")
    by_price = W.partitionBy("u").orderBy("sales", "nos", "items")
    kept = lines.withColumn("_k", F.row_number().over(by_item)).filter(F.col("_k") <= top)
    kept = kept.withColumn("_k", F.row_number().over(by_price)).filter(F.col("_k") <= 2 * top)
    one = kept.groupBy("u").agg(F.collect_list(F.struct("sales", "nos", "items")).alias("l"))  # 2 * top at most
    return one.select("u", *[F.col("l")[c].alias(c) for c in ("sales", "nos", "items")])


def near_prices(lines: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """For each row of ``items`` its first ``top`` pairs, one row each, and the count, gap sum and checksum of all its pairs.

    Every line adds its count, unit price and checksum at the ends of the range of prices that it pairs with: to a
    difference array over the sorted distinct prices, one for the prices up to its own and one for those above. The lines
    of the item itself are subtracted. Ranks come from an outward search over each unit price's first ``2 * top`` lines,
    ``top`` an item at most, which are enough whichever item is left out.

    Lines with a null in sale_id, item_id, quantity or amount, without quantity or with an amount that is no number never
    pair, nor do items whose price is null or no number. A null line_no sorts first and is empty in the checksum; a null
    item_id is unlike all others; repeated lines and repeated items count each. Empty tables give no rows, or items
    without pairs. Other columns are left out.

    Lines are dealt by ranges of (u, sale, number), so that none is too large whatever repeats; prices and the sums of
    lines meet in price buckets, which hold a bounded number of distinct integers. Nothing is broadcast or collected.
    """
    sale, no, item = F.col("sale_id").cast("long"), F.coalesce(F.col("line_no").cast("long"), F.lit(LEAST)), F.col("item_id").cast("long")
    usable = lines.select(sale.alias("sale_id"), no.alias("line_no"), item.alias("item_id"), unit_price(cents(F.col("amount")), F.col("quantity")).alias("u"), (F.monotonically_increasing_id() % 1024).alias("_deal"))
    usable = usable.filter("sale_id IS NOT NULL AND item_id IS NOT NULL AND u IS NOT NULL")
    dealt = usable.repartitionByRange("u", "sale_id", "line_no", "_deal").sortWithinPartitions("u", "sale_id", "line_no", "item_id")
    text = F.concat_ws(",", "sale_id", F.when(F.col("line_no") != LEAST, F.col("line_no").cast("string")).otherwise(""), "item_id")
    cells = materialize(dealt.select("u", "sale_id", "line_no", "item_id", F.crc32(text.cast("binary")).alias("crc")).mapInArrow(lambda b: _cells(b, top), CELL), "cells")

    wares = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p"))
    price = wares.filter("p IS NOT NULL").select("p").distinct().select(bucket(F.col("p")).alias("bucket"), F.col("p").alias("v"))
    u = F.col("u")
    parts_of = cells.filter("item_id IS NULL")
    totals = parts_of.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    ranged = totals.join(_first_lines(parts_of, top), "u").select(u.alias("v"), "n", "crc", lowest(u).alias("lo"), highest(u).alias("hi"), "sales", "nos", "items")
    spread = ranged.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    parts = spread.unionByName(price, allowMissingColumns=True).repartitionByRange("bucket")
    bands = parts.groupBy("bucket").applyInArrow(lambda part: _band(part, top), BAND)

    own = cells.filter("item_id IS NOT NULL").groupBy("item_id", "u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(wares.filter("p IS NOT NULL").distinct(), "item_id").filter(paired(u, F.col("p")))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.abs(u - F.col("p"))).alias("own_gap"), F.sum("crc").alias("own_crc"))
    all_ = wares.join(own, ["item_id", "p"], "left").join(bands, "p", "left")
    others = F.slice(F.filter("near", lambda x: ~x["line_item_id"].eqNullSafe(F.col("item_id"))), 1, top)
    less = lambda x, y: (F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("long").alias(x)
    out = all_.select("item_id", F.posexplode_outer(others).alias("at", "pair"), less("n_pairs", "own_n"), less("gap_sum", "own_gap"), less("lines_crc", "own_crc"))
    return out.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), *[F.col("pair")[c].alias(c) for c in NEAR], "n_pairs", "gap_sum", "lines_crc")


def op12_near_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prices(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/items.parquet"))


# CRC-32 by halves of a byte; the 16 fixed values are those of the reflected polynomial 0xEDB88320
OP12_SQL = f"""
WITH i AS (SELECT item_id, CASE WHEN abs(price) <= {MOST} THEN CAST(floor(100 * price + 0.5) AS BIGINT) END AS p, row_number() OVER () AS ware FROM items),
a AS (SELECT sale_id, line_no, item_id, CAST(quantity AS BIGINT) AS q, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a FROM sale_lines
      WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND abs(amount) <= {MOST}),
b AS (SELECT sale_id, line_no, item_id, sign(q) * (2 * a + q) AS x, abs(2 * q) AS y FROM a),
l AS (SELECT sale_id, line_no, item_id, CAST((x - ((x % y) + y) % y) // y AS BIGINT) AS u,
      [ord(c) FOR c IN string_split(sale_id || ',' || coalesce(CAST(line_no AS VARCHAR), '') || ',' || item_id, '')] AS bytes FROM b),
t AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
c AS (SELECT sale_id, line_no, item_id, u, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda s, x:
      xor(t[(xor(t[(xor(s, x) & 15) + 1], xor(s, x) >> 4) & 15) + 1], xor(t[(xor(s, x) & 15) + 1], xor(s, x) >> 4) >> 4))) AS crc FROM l, t),
m AS (SELECT i.ware, abs(u - p) AS gap, u, sale_id, line_no, c.item_id AS line_item_id, crc FROM i JOIN c
      ON u BETWEEN p - greatest({CENTS}, 6 * abs(p) // 1000) AND p + greatest({CENTS}, 6 * abs(p) // 1000)
      WHERE c.item_id IS DISTINCT FROM i.item_id AND (abs(u - p) <= {CENTS} OR 1000 * abs(u - p) <= {PER_MILLE} * least(u, p))),
r AS (SELECT *, row_number() OVER (PARTITION BY ware ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM m),
s AS (SELECT ware, count(*) AS n, sum(gap) AS g, sum(crc) AS k FROM m GROUP BY ware)
SELECT i.item_id, CAST(coalesce(r.rank, 0) AS INTEGER) AS rank, r.gap, r.u, r.sale_id, CAST(r.line_no AS BIGINT) AS line_no, r.line_item_id,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_pairs, CAST(coalesce(s.g, 0) AS BIGINT) AS gap_sum, CAST(coalesce(s.k, 0) AS BIGINT) AS lines_crc
FROM i LEFT JOIN s USING (ware) LEFT JOIN (SELECT * FROM r WHERE rank <= {TOP}) r USING (ware)
"""
