"""Bootstrap intervals: a weight table joined with per-cluster sums.

Gathering resampled clusters and adding up equals weighting each cluster by how often it is drawn. So rows are first
summed per cluster; the draws (replicates x clusters) are made where they are needed, by hashing replicate and draw,
or from a driver's random stream for parity with a reference run. Draws meet the sums in a shuffle: the planner can't tell
how many rows an explode makes, takes their table for a small one and would send it through the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.operators.ordering import numbered
from quorumlake.runtime import parallelism

DRAWS = 1 << 16  # of a replicate that are made in one piece


def draw(rep: Column, k: Column, n: Column) -> Column:
    """The cluster of draw k in a replicate: 32 hashed bits modulo n. The same in any engine with MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", rep.cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long"), n)


def ordinals(per: DataFrame, name: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The clusters, one a row, numbered in the order of comparisons and names in ``_at``; and for each comparison the number
    of its clusters and the first of their numbers. Sorted by ranges: no task sees all clusters of a comparison."""
    rows = numbered(per, *by, F.col(name).asc_nulls_last(), name="_at", start=0)
    groups = rows.groupBy(*by).agg(F.count("*").alias("_clusters"), F.min("_at").alias("_first"))
    return rows.filter(reduce(and_, [F.col(c).isNotNull() for c in [*by, name]])), groups


def hash_draws(groups: DataFrame, reps: int) -> DataFrame:
    """(rep, _at): a row for each draw of each replicate, as many as the comparison has clusters."""
    start, step = F.lit(0).cast("long"), F.lit(DRAWS).cast("long")
    pieces = groups.filter("_clusters > 0").select("_clusters", "_first", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    pieces = pieces.withColumn("_from", F.explode(F.sequence(start, F.col("_clusters") - 1, step)))
    pieces = pieces.repartition(parallelism(groups.sparkSession), "_first", "rep", "_from")  # pieces are drawn side by side, not in the task of their group
    draws = pieces.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("_clusters")) - 1)))
    return draws.select("rep", (F.col("_first") + draw(F.col("rep"), F.col("_k"), F.col("_clusters"))).alias("_at"))


def drawn(groups: DataFrame, reps: int, rows: DataFrame) -> DataFrame:
    """The rows of the drawn clusters with their replicate, once a draw."""
    return hash_draws(groups, reps).join(rows.hint("shuffle_hash"), "_at")  # a task holds its share of the clusters, draws pass by


def numpy_weights(spark: SparkSession, n: int, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(rep, ordinal, w) of ``default_rng(seed).integers(0, n, (reps, n))``, made on the driver: reps x n numbers."""
    import numpy as np

    drawn = np.random.default_rng(seed).integers(0, n, (reps, n))
    weights = [(r, int(o), int(c)) for r in range(reps) for o, c in zip(*np.unique(drawn[r], return_counts=True), strict=True)]
    return spark.createDataFrame(weights, "rep int, ordinal long, w long")


def stream_weights(spark: SparkSession, n: int, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(rep, ordinal, w) of ``random.Random(seed)`` choosing n of n rows, replicate by replicate."""
    import random
    from collections import Counter

    rng = random.Random(seed)
    rows = [(r, o, c) for r in range(reps) for o, c in Counter([rng.randrange(n) for _ in range(n)]).items()]
    return spark.createDataFrame(rows, "rep int, ordinal long, w long")


def replicates(df: DataFrame, cluster: str, sums: dict[str, Column], reps: int, by: list[str], weights: DataFrame | None = None) -> DataFrame:
    """(by, rep, and the weighted sums) for each replicate. ``sums`` are indicator or value columns of rows."""
    per = df.groupBy(*by, cluster).agg(*[F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(k) for k, c in sums.items()])
    rows, groups = ordinals(per, cluster, by)
    if weights is None:
        return drawn(groups, reps, rows).groupBy(*by, "rep").agg(*[F.sum(k).alias(k) for k in sums])
    rows = (rows.join(groups, by) if by else rows.crossJoin(groups)).withColumn("ordinal", F.col("_at") - F.col("_first"))
    joined = weights.join(rows, [*[c for c in by if c in weights.columns], "ordinal"])
    return joined.groupBy(*by, "rep").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in sums])


def replicates_by_cell(per: DataFrame, cluster: str, cell: str, sums: list[str], reps: int) -> DataFrame:
    """(rep, cell, weighted sums) where ``per`` has one row per cluster and cell: whole clusters are drawn, cells keep apart."""
    rows, groups = ordinals(per.select(cluster).distinct(), cluster, [])
    return drawn(groups, reps, per.join(rows, cluster)).groupBy("rep", cell).agg(*[F.sum(k).alias(k) for k in sums])


def interval(stats: DataFrame, value: Column, by: list[str], reps: int, least_valid: float = 0.9, level: float = 0.95) -> DataFrame:
    """Percentile interval with linear quantiles; null unless enough replicates have a value."""
    tail = (1 - level) / 2
    v = stats.select(*by, value.alias("_v")).groupBy(*by) if by else stats.select(value.alias("_v")).groupBy()
    out = v.agg(F.count("_v").alias("valid"), F.percentile("_v", tail).alias("low"), F.percentile("_v", 1 - tail).alias("high"))
    keep = F.col("valid") >= least_valid * reps
    return out.withColumns({"low": F.when(keep, F.col("low")), "high": F.when(keep, F.col("high"))})


def order_interval(stats: DataFrame, value: Column, by: list[str], reps: int, level: float = 0.95) -> DataFrame:
    """Interval of order statistics, without interpolation, over the replicates that have a value."""
    v = stats.select(*by, value.alias("_v")).filter("_v IS NOT NULL").groupBy(*by) if by else stats.select(value.alias("_v")).filter("_v IS NOT NULL").groupBy()
    out = v.agg(F.array_sort(F.collect_list("_v")).alias("_s"))  # reps values a group: bounded
    tail = (1 - level) / 2
    low = F.floor(F.size("_s") * tail).cast("int")
    return out.select(*by, F.size("_s").cast("long").alias("valid"), F.get("_s", low).alias("low"), F.get("_s", F.size("_s") - low - 1).alias("high"))


def masks(conditions: dict[str, Column]) -> dict[str, Column]:
    return {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in conditions.items()}


def combined(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
