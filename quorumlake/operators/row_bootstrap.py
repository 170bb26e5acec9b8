"""Bootstraps of rows: multinomial counts drawn from the top down, block by block, without replicates of the rows.

Rows that agree in all that is summed are exchangeable, so drawing n of n rows is drawing the counts of their cells. A group's
cells are split into blocks; how many of the n draws fall into a block comes from halving the draws between halves of the
blocks, each half's share a binomial number that every task finds for itself from a seed, and within a block the cells share its
draws. So totals are exactly n, no task needs another's numbers, and a group with a third of all rows has many blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quorumlake.runtime import materialize

BLOCK_CELLS = 1 << 14  # cells that a block holds, about
AT_ONCE = 1 << 22  # numbers of replicates x cells that a task holds


def block_draws(sizes: np.ndarray, block: int, reps: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each replicate's draws fall into ``block`` of a power of two blocks that hold ``sizes`` rows."""
    lo, hi, node = 0, len(sizes), 1
    draws = np.full(reps, sizes.sum(), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, right = int(sizes[lo:mid].sum()), int(sizes[mid:hi].sum())
        share = left / (left + right) if left + right else 0.0
        first = np.random.default_rng((*seed, node)).binomial(draws, share)
        if block < mid:
            draws, hi, node = first, mid, 2 * node
        else:
            draws, lo, node = draws - first, mid, 2 * node + 1
    return draws


def _drawn(table: pa.Table, sums: list[str], keys: list[str], reps: int, seed: int) -> pa.Table:
    order = table.sort_by([(c, "ascending") for c in [*sums, "_n"]])  # cells in an order of their own, whatever the shuffle's
    n, values = order["_n"].to_numpy(), np.stack([order[c].to_numpy() for c in sums], axis=1)
    sizes = np.zeros(1 << int(order["_bits"][0].as_py()), dtype=np.int64)
    for part in order["_sizes"][0].as_py():
        sizes[part["b"]] = part["n"]
    block, group = int(order["_block"][0].as_py()), int(order["_hash"][0].as_py()) & ((1 << 64) - 1)
    draws = block_draws(sizes, block, reps, (seed, group))
    rng = np.random.default_rng((seed, group, len(sizes), block, 1))
    out, step = np.zeros((reps, len(sums))), max(1, AT_ONCE // len(n))
    for lo in range(0, reps, step):
        out[lo : lo + step] = rng.multinomial(draws[lo : lo + step], n / n.sum()) @ values
    head = [pa.chunked_array([pa.repeat(order[k][0], reps)]) for k in keys]
    return pa.table([*head, pa.array(np.arange(reps, dtype=np.int32)), pa.array(draws), *[pa.array(out[:, j]) for j in range(len(sums))]], names=[*keys, "rep", "_draws", *sums])


def row_replicates(df: DataFrame, sums: dict[str, Column], reps: int, by: list[str] | None = None, seed: int = 0, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(by, rep, n, and the sums over the drawn rows) for ``reps`` replicates of n of the n rows of each group.

    Nulls add nothing to a sum; null groups are groups; an empty table has no replicates. The draws depend on ``seed``, the
    group and its rows alone, not on how they are dealt. Rows are reduced to cells in the tasks that read them; what is
    shuffled is cells, and a number for each replicate and block.
    """
    by, names = by or [], list(sums)
    rows = df.select(*by, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()])
    cells = materialize(rows.groupBy(*by, *sums).agg(F.count("*").alias("_n")), "cells")
    group = F.xxhash64(F.lit(1), *by)
    many = cells.groupBy(*by).agg(F.count("*").alias("_cells"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_cells") / block_cells))).cast("int")
    many = many.select(group.alias("_hash"), bits.alias("_bits"))
    spread = F.shiftrightunsigned(F.xxhash64(*sums, F.lit(2)), 40)  # 24 bits
    dealt = cells.withColumn("_hash", group).join(many, "_hash").withColumn("_block", spread.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int"))
    sizes = dealt.groupBy("_hash", "_block").agg(F.sum("_n").alias("n")).groupBy("_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), "n"))).alias("_sizes"))
    fields = T.StructType([*[df.schema[k] for k in by], T.StructField("rep", T.IntegerType()), T.StructField("_draws", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in sums]])
    parts = dealt.join(sizes, "_hash").groupBy("_hash", "_block").applyInArrow(lambda t: _drawn(t, names, by, reps, seed), fields)
    return parts.groupBy(*by, "rep").agg(F.sum("_draws").alias("n"), *[F.sum(k).alias(k) for k in sums])
