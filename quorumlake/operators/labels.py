"""Human label sheets: problems, adjudication queue, resolution, consensus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# What a label sheet may hold.
RELATIONS = ["supports", "opposes", "mixed_or_conditional", "neutral_or_no_position", "unclear"]
DIRECTIONS = ["supports", "opposes"]


class UnresolvedLabels(ValueError):
    """A disagreement has no valid adjudication."""


def committed(relation: Column) -> Column:
    return relation.isin(DIRECTIONS).cast("int")


def problems(sheet: DataFrame, modes: list[str]) -> DataFrame:
    """(rule, sample_id, detail) of every violation: empty or unknown labels, confidence, repeated ids."""
    cases = F.array_compact(F.array(
        F.when(F.col("relation") == "", F.struct(F.lit("relation_missing").alias("rule"), F.lit("").alias("detail"))),
        F.when((F.col("relation") != "") & ~F.col("relation").isin(RELATIONS), F.struct(F.lit("relation_unknown").alias("rule"), F.col("relation").alias("detail"))),
        F.when(~F.col("mode").isin(modes), F.struct(F.lit("mode_unknown").alias("rule"), F.col("mode").alias("detail"))),
        F.when(~F.col("confidence_1to3").isin("1", "2", "3"), F.struct(F.lit("confidence_invalid").alias("rule"), F.col("confidence_1to3").alias("detail"))),
    ))
    rows = sheet.select("sample_id", F.explode(cases).alias("p")).select("p.rule", "sample_id", "p.detail")
    twice = sheet.groupBy("sample_id").count().filter("count > 1").select(F.lit("sample_id_repeated").alias("rule"), "sample_id", F.col("count").cast("string").alias("detail"))
    return rows.unionByName(twice)


def changed(frozen: DataFrame, done: DataFrame, columns: list[str]) -> DataFrame:
    """Samples whose frozen columns differ in the completed sheet, or that one side lacks."""
    a, b = frozen.select("sample_id", F.struct(*columns).alias("x")), done.select("sample_id", F.struct(*columns).alias("y"))
    return a.join(b, "sample_id", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("sample_id")


def queue(a: DataFrame, c: DataFrame) -> DataFrame:
    """Samples on which two annotators differ, with both labels."""
    both = a.select("sample_id", F.col("relation").alias("relation_a"), F.col("mode").alias("mode_a")).join(c.select("sample_id", F.col("relation").alias("relation_c"), F.col("mode").alias("mode_c")), "sample_id")
    differs = (F.col("relation_a") != F.col("relation_c")) | (F.col("mode_a") != F.col("mode_c"))
    return both.filter(differs).withColumn("commitment_differs", committed(F.col("relation_a")) != committed(F.col("relation_c")))


def queue_problems(expected: DataFrame, done: DataFrame) -> DataFrame:
    """(sample_id, rule) of rows of an adjudicated queue that are missing, repeated, not asked for, or changed in the
    annotators' columns, or whose label is blank though the annotators differ, or unknown."""
    kept = ["relation_a", "relation_c", "mode_a", "mode_c"]
    one = done.groupBy("sample_id").agg(F.count("*").alias("_n"), F.min(F.struct(*kept)).alias("_now"), F.min("relation_adjudicated").alias("_label"))
    both = expected.select("sample_id", F.struct(*kept).alias("_then")).join(one, "sample_id", "full")
    label = F.trim(F.coalesce("_label", F.lit("")))
    rules = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), F.lit("missing")), F.when(F.col("_then").isNull(), F.lit("not_asked_for")), F.when(F.col("_n") > 1, F.lit("repeated")),
        F.when(F.col("_then").isNotNull() & F.col("_now").isNotNull() & (F.col("_then") != F.col("_now")), F.lit("changed")),
        F.when(F.col("_n").isNotNull() & (label == "") & (F.col("_now.relation_a") != F.col("_now.relation_c")), F.lit("blank")),
        F.when((label != "") & ~label.isin(RELATIONS), F.lit("unknown")),
    ))
    return both.select("sample_id", F.explode(rules).alias("rule"))


def resolved(adjudicated: Column, a: Column, c: Column) -> Column:
    """The adjudicated label; a blank one stands for the label that both gave, and is null (an error) where they differ."""
    return F.coalesce(F.nullif(F.trim(adjudicated), F.lit("")), F.when(a == c, a))


def consensus(a: DataFrame, c: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final labels with provenance; ``decisions``: sample_id, relation, mode of adjudicated samples."""
    both = a.select("sample_id", F.col("relation").alias("ra"), F.col("mode").alias("ma")).join(c.select("sample_id", F.col("relation").alias("rc"), F.col("mode").alias("mc")), "sample_id")
    joined = both.join(decisions.select("sample_id", F.col("relation").alias("rd"), F.col("mode").alias("md")), "sample_id", "left")
    agreed = (F.col("ra") == F.col("rc")) & (F.col("ma") == F.col("mc"))
    return joined.select("sample_id", F.coalesce("rd", F.when(agreed, F.col("ra"))).alias("relation"), F.coalesce("md", F.when(agreed, F.col("ma"))).alias("mode"), F.when(F.col("rd").isNotNull(), "researcher_adjudicated").when(agreed, "human_A_C_agreed").alias("provenance"))


def require_resolved(final: DataFrame) -> None:
    if bad := final.filter("relation IS NULL").limit(3).collect():
        raise UnresolvedLabels(f"no label for {bad}")


def followed(final: Column, a: Column, c: Column) -> Column:
    """Whose label a decision follows."""
    return F.when(final == a, "A").when(final == c, "C").otherwise("third")


def routed(key: DataFrame, sheets: dict[str, DataFrame], source: str, on: str, values: list[str]) -> DataFrame:
    """Each keyed row with the labels of the sheet that its source names; one join, as sheets are told apart by a column."""
    tagged = [sheet.select(F.lit(name).alias(source), on, *values) for name, sheet in sheets.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return key.join(both, [source, on], "left")


def require_routed(rows: DataFrame, values: list[str]) -> None:
    missing = rows.filter(reduce(lambda a, b: a | b, (F.col(v).isNull() for v in values)))
    if bad := missing.limit(3).collect():
        raise ValueError(f"rows without a label: {bad}")
