"""Ordered series and parent chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from quorumlake.operators.ordering import numbered
from quorumlake.runtime import discard, materialize


def first_sustained(df: DataFrame, order: str, value: str, by: list[str] = [], rise: float = 0.5, dip: float = 0.02) -> DataFrame:  # noqa: B006
    """The first point after the start that has made ``rise`` of the way from start to end and hasn't fallen by more than ``dip``."""
    if not by:
        return _first_sustained_alone(df, order, value, rise, dip)
    w = W.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first_value(value).over(whole), F.last_value(value).over(whole)
    marked = df.withColumns({"_prev": F.lag(value).over(w), "_goal": first + rise * (last - first)})
    good = marked.filter((F.col("_prev").isNotNull()) & (F.col(value) >= F.col("_goal")) & (F.col(value) >= F.col("_prev") - dip))
    return good.groupBy(*by).agg(F.min_by(order, order).alias(order), F.min_by(value, order).alias(value))


def _first_sustained_alone(df: DataFrame, order: str, value: str, rise: float, dip: float) -> DataFrame:
    """One series of any length: points are numbered by ranges, and each meets the one before it by number."""
    points = numbered(df.select(order, value), order, name="_k")
    before = points.select((F.col("_k") + 1).alias("_k"), F.col(value).alias("_prev"))
    ends = points.agg(F.min_by(value, "_k").alias("_first"), F.max_by(value, "_k").alias("_last"))  # one row
    marked = points.join(before, "_k").crossJoin(F.broadcast(ends)).withColumn("_goal", F.col("_first") + rise * (F.col("_last") - F.col("_first")))
    good = marked.filter(F.col("_prev").isNotNull() & (F.col(value) >= F.col("_goal")) & (F.col(value) >= F.col("_prev") - dip))
    return good.agg(F.min(order).alias(order), F.min_by(value, order).alias(value))


class CyclicLineage(ValueError):
    """Parent chains that never end."""


def _written(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` as a table, and how many rows it has, from one job."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return table, seen.get["n"]


def _jumps(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (name, ancestor) of ancestors at distances 1, 2, 4 and so on, each written, until no chain is as long; and
    the last of them if chains are longer than there are names, as they then never end."""
    jumps, names = [edges], None
    while True:
        last = jumps[-1]
        double, n = _written(last.alias("a").join(last.alias("b"), F.col("a.ancestor") == F.col("b.name")).select("a.name", "b.ancestor"), "jumps")
        if not n:
            discard(double)
            return jumps, None
        if len(jumps) >= 6:  # most chains have ended by then
            names = edges.select("name").distinct().count() if names is None else names
            if 1 << len(jumps) > names:
                return jumps, double
        jumps.append(double)


def _edges(nodes: DataFrame, name: str, parent: str) -> DataFrame:
    return materialize(nodes.select(F.col(name).alias("name"), F.col(parent).alias("ancestor")).filter("name IS NOT NULL AND ancestor IS NOT NULL"), "edges")


def endless(nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name) of the nodes whose parent chain runs into a cycle."""
    _, cyclic = _jumps(_edges(nodes, name, parent))
    return cyclic.select("name").distinct() if cyclic is not None else nodes.select(F.col(name).alias("name")).limit(0)


def lineage(spark: SparkSession, nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name, ancestor, depth) along the parent chain, for chains of any length.

    Pointers are doubled: ancestors up to distance 2k are those up to k, and those up to k of the ancestor at k. A chain of
    n parents takes log2(n) joins, each written before the next. A cycle is an error that names nodes which run into it.
    """
    jumps, cyclic = _jumps(_edges(nodes, name, parent))
    if cyclic is not None:
        raise CyclicLineage(f"parent chains never end: {sorted(r[0] for r in cyclic.select('name').distinct().limit(10).collect())}")
    walk = jumps[0].withColumn("depth", F.lit(1))
    for k, jump in enumerate(jumps):
        further = jump.alias("j").join(walk.alias("w"), F.col("j.ancestor") == F.col("w.name")).select("j.name", "w.ancestor", (F.col("w.depth") + (1 << k)).alias("depth"))
        done, walk = walk, materialize(walk.unionByName(further), "lineage")
        discard(done, jump if k else None)
    discard(jumps[0])
    return walk
