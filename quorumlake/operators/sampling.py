"""Deterministic samples by hash order, the same on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quorumlake.operators.ordering import numbered
from quorumlake.runtime import free_name, materialize


def hash_order(key: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def per_cell(df: DataFrame, cells: list[str], key: str, n: int, seed: str = "0") -> DataFrame:
    """The n rows of each cell that come first in hash order. Spark keeps the n best rows of a cell in each task before
    it shuffles them (group limit on row numbers)."""
    w = W.partitionBy(*cells).orderBy(hash_order(F.col(key), seed))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def by_stratum(df: DataFrame, stratum: str, census: list[str], cluster: str, n: int, seed: str = "0") -> DataFrame:
    """All clusters of census strata and n clusters of each other one; clusters stay whole."""
    clusters = df.select(stratum, cluster).distinct()
    whole = clusters.filter(F.col(stratum).isin(census))
    drawn = per_cell(clusters.filter(~F.col(stratum).isin(census)), [stratum], cluster, n, seed)
    return df.join(whole.unionByName(drawn), [stratum, cluster], "left_semi")


def quotas(df: DataFrame, strata: list[tuple[str, Column, int]], spread: list[str], key: str, seed: str = "0") -> DataFrame:
    """Strata filled in order, without replacement, each spread evenly over cells.

    One scan of ``df``, whatever the number of strata: no more keys are ever taken than all quotas together, so of the rows of
    a cell that meet the same conditions, those of so many first keys in hash order are enough. Each task keeps no more of them
    either. The strata are then filled from this table, whose size follows the quotas and cells, not ``df``.
    """
    total = sum(n for _, _, n in strata)
    met, first = free_name("_met", df), free_name("_first", df)
    marks = F.concat(*[F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0") for _, c, _ in strata])
    alike = W.partitionBy(*spread, met).orderBy(hash_order(F.col(key), seed))
    ranked = df.withColumn(met, marks).filter(F.col(met).contains("1")).withColumn(first, F.dense_rank().over(alike))
    left = candidates = materialize(ranked.filter(F.col(first) <= total).drop(first), "candidates")
    taken = None
    for k, (name, _, n) in enumerate(strata):
        cell = W.partitionBy(*spread).orderBy(hash_order(F.col(key), seed))
        place = left.filter(F.substring(met, k + 1, 1) == "1").withColumn("_rank", F.row_number().over(cell))
        got = materialize(place.orderBy("_rank", hash_order(F.col(key), seed)).limit(n).drop("_rank", met).withColumn("stratum", F.lit(name)), "stratum")
        taken = got if taken is None else taken.unionByName(got)
        left = candidates.join(taken.select(key), key, "left_anti")
    return taken


def outside(df: DataFrame, taken: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """The n rows that come first in hash order among those whose key isn't taken; each task keeps n rows."""
    rest = df.join(taken.select(key).distinct(), key, "left_anti")
    return rest.orderBy(hash_order(F.col(key), seed)).limit(n)


def shuffled(df: DataFrame, key: str, seed: str = "0", prefix: str = "L") -> DataFrame:
    """Rows with ids in shuffled order (``L001`` and on); numbers go by ranges of the order, so any number of rows will do."""
    ids = numbered(df, hash_order(F.col(key), seed), key, name=(n := free_name("_n", df)))
    return ids.withColumn("sample_id", F.format_string(f"{prefix}%03d", F.col(n))).drop(n)


def wrong_label(label: Column, labels: list[str], key: Column, seed: str = "0") -> Column:
    """Another label than the given one, chosen by hash."""
    rest = F.array_except(F.array(*map(F.lit, labels)), F.array(label))
    return F.element_at(rest, (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.size(rest).cast("long")) + 1).cast("int"))
