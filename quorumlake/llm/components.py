"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quorumlake.runtime import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    Each step is a minimum per node (partial aggregates first) and a join by node whose large side adaptive
    execution can split, so a hub may hold any share of the edges. Edges and labels never go to the driver;
    each step ends in a table of the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(now.distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        discard(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, to a root: no star is left to shrink."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    many = ends.groupBy("node").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
    return not many.filter("`from` > 1 OR `from` > 0 AND `to` > 0").limit(1).count()
