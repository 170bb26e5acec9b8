"""Comparisons under one changed factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.functions.stats import share
from quorumlake.functions.taxonomy import DIRECTIONAL, POSITION


class AmbiguousPairs(ValueError):
    """A key has several rows at one level of the factor."""


def require_unique(df: DataFrame, keys: list[str]) -> None:
    if bad := df.groupBy(keys).count().filter("count > 1").limit(3).collect():
        raise AmbiguousPairs(f"several rows for {bad}")


def pairs(df: DataFrame, factor: str, a, b, keys: list[str], values: list[str]) -> DataFrame:  # noqa: ANN001
    """Rows at the two levels of a factor side by side, with suffixes _a and _b; null keys meet null keys.

    One pass: rows of both levels are grouped by key, so the table is read and shuffled once, not joined with itself.
    Keys with several rows at one level are for ``require_unique``.
    """
    two = df.filter(F.col(factor).isin(a, b))
    at = lambda level, v: F.min(F.when(F.col(factor) == level, F.struct(v)))[v]
    has = lambda level: F.max(F.col(factor) == level)
    out = two.groupBy(keys).agg(has(a).alias("_in_a"), has(b).alias("_in_b"), *[at(level, v).alias(f"{v}_{s}") for v in values for level, s in ((a, "a"), (b, "b"))])
    return out.filter("_in_a AND _in_b").drop("_in_a", "_in_b")


def unmatched(df: DataFrame, factor: str, a, b, keys: list[str]) -> DataFrame:  # noqa: ANN001
    """How many keys stand at one level only."""
    sides = df.filter(F.col(factor).isin(a, b)).groupBy(keys).agg(F.max(F.col(factor) == a).alias("in_a"), F.max(F.col(factor) == b).alias("in_b"))
    return sides.agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("both"))


def disagreement_kind(a: Column, b: Column) -> Column:
    """Null where the outcomes agree."""
    flip = a.isin(DIRECTIONAL) & b.isin(DIRECTIONAL)
    return F.when(a == b, None).when(flip, "direction_flip").when(a.isin(POSITION) != b.isin(POSITION), "position_vs_nonposition").otherwise("nonposition_relabel")


def transition_kind(a: Column, b: Column) -> Column:
    """How an outcome changes from a to b; the first case that holds."""
    da, db = a.isin(DIRECTIONAL), b.isin(DIRECTIONAL)
    return F.when(a == b, "same").when(da & db, "direction_flip").when(da, "loses_direction").when(db, "gains_direction").when(a.isin(POSITION) != b.isin(POSITION), "position_change").otherwise("relabel")


def divergence(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group of pairs: equal texts, first differing character of the others, length difference, equal finish."""
    same = F.col("text_a") == F.col("text_b")
    return df.groupBy(by).agg(F.count("*").alias("n"), share(same).alias("exact_share"), F.median(F.when(~same, F.col("prefix"))).alias("median_prefix"), F.avg(F.abs(F.col("n_chars_a") - F.col("n_chars_b"))).alias("mean_length_gap"), share(F.col("finish_reason_a") == F.col("finish_reason_b")).alias("finish_agree"))


def starting_with(df: DataFrame, start: str) -> list[str]:
    """Names of the columns that begin like this, in their order."""
    return [c for c in df.columns if c.startswith(start)]


def one_of(df: DataFrame, tuples: DataFrame, on: list[str], name: str) -> DataFrame:
    """``df`` with a flag: whether its key stands among the tuples."""
    return df.join(tuples.select(on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
