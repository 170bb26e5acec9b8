"""Small relational steps with their guards: lookups, sides side by side, first values, sides filled in."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.runtime import broadcast_if_small


class NotConstant(ValueError):
    """A column has several values within a group."""


def looked_up(df: DataFrame, table: DataFrame, on: str, value: str, name: str | None = None) -> DataFrame:
    """``df`` with the value that ``table`` has for its key, null where it has none. A key that ``table`` has twice is an error."""
    if twice := table.groupBy(on).count().filter("count > 1").limit(3).collect():
        raise NotConstant(f"several values for {[r[0] for r in twice]}")
    small = table.select(F.col(on).alias("_on"), F.col(value).alias("_value"))
    return df.join(broadcast_if_small(small, 100), df[on].eqNullSafe(F.col("_on")), "left").drop("_on").withColumnRenamed("_value", name or value)


def mapped(key: Column, labels: dict[str, str], otherwise: Column | None = None) -> Column:
    """A label for each key; others get ``otherwise``, or null."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(table, key)
    return F.when(key.isNotNull(), found if otherwise is None else F.coalesce(found, otherwise))


def first_values(df: DataFrame, by: list[str], values: list[str], constant: bool = True) -> DataFrame:
    """One row a group with the values that are not null in it. If they are to be ``constant``, a group with several is an error."""
    if constant:
        many = df.groupBy(by).agg(*[F.count_distinct(v).alias(f"_{v}") for v in values]).filter(" OR ".join(f"_{v} > 1" for v in values))
        if bad := many.limit(3).collect():
            raise NotConstant(f"several values in {[tuple(r[b] for b in by) for r in bad]}")
    return df.groupBy(by).agg(*[F.min(v).alias(v) for v in values])


def joined_on(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of both tables with equal keys (null equals null), their other columns with suffixes. Keys that stand twice meet each time."""
    left = a.toDF(*[c if c in on else c + suffixes[0] for c in a.columns])
    right = b.toDF(*[f"_key_{c}" if c in on else c + suffixes[1] for c in b.columns])
    met = left.join(right, reduce(and_, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in on]), how)
    return met.drop(*[f"_key_{k}" for k in on])


def resuffixed(df: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Columns that end in one of the suffixes get the other one."""
    new = {c: c.removesuffix(old) + to for c in df.columns for old, to in suffixes.items() if c.endswith(old)}
    return df.withColumnsRenamed(new)


def filled(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of either table by key, each value from ``a`` where it has one, else from ``b``; columns of both."""
    rest = [*[c for c in a.columns if c not in on], *[c for c in b.columns if c not in a.columns]]
    left, right = a.toDF(*[f"_a_{c}" for c in a.columns]), b.toDF(*[f"_b_{c}" for c in b.columns])
    met = left.join(right, reduce(and_, [left[f"_a_{k}"].eqNullSafe(right[f"_b_{k}"]) for k in on]), "full")
    both = lambda c: F.coalesce(*[F.col(f"_{s}_{c}") for s, t in (("a", a), ("b", b)) if c in t.columns]).alias(c)
    return met.select(*[both(c) for c in [*on, *rest]])


def top_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in order; each task keeps n."""
    return df.orderBy(*order).limit(n)


def lineage_rows(frame: DataFrame, by: list[str], evaluators: dict[str, str], key: str = "cache_key", evaluator: str = "evaluator", outcome: str = "outcome", position: str = "is_position") -> DataFrame:
    """One row a model: responses, errors, empty and cut-off ones, and for each evaluator the number scored, the position rate and
    the most frequent outcome, of ties the first by name. Responses are counted once, however many evaluators have scored them."""
    once = lambda c: F.count_distinct(F.when(c, F.col(key)))
    whole = frame.filter(F.col(evaluator).isin(list(evaluators))).groupBy(by)
    per = []
    for name, short in evaluators.items():
        own = F.col(evaluator) == name
        per += [F.count_if(own).alias(f"{short}_n_scored"), F.avg(F.when(own, F.col(position).cast("int"))).alias(f"{short}_position_rate"), F.mode(F.when(own, F.col(outcome)), True).alias(f"{short}_top_outcome")]
    flags = [once(F.col(c)).alias(n) for n, c in (("errors", "failed"), ("empty_text", "empty"), ("truncated_n", "truncated"))]
    return whole.agg(F.count_distinct(key).alias("n_generations"), *flags, *per)
