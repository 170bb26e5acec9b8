"""Comparisons of evaluators, prompts and subsets, and the readings that are drawn from their intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.functions.stats import count_if, mcnemar, ratio, share
from quorumlake.functions.taxonomy import DIRECTIONAL, POSITION
from quorumlake.operators.direction import direction_index


def side_by_side(df: DataFrame, column: str, levels: list[str], keys: list[str], value: str) -> DataFrame:
    """One row per key with the value at each level; one aggregation, no self-join."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(column) == x, F.col(value))).alias(x) for x in levels])


def paired_error_tests(wide: DataFrame, base: str, others: list[str], truth: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """For each error and pair of evaluators: rates, errors that the other one fixes or adds, exact p.

    Over-reading counts where the truth has no direction, reversal where it has one, and any error (labels collapsed to
    four) everywhere. ``wide`` has one column of outcomes per evaluator; all pairs and errors come from one aggregation.
    """
    rows = wide.filter(F.col(truth).isNotNull())
    four = lambda x: F.when(x.isin(POSITION), x).otherwise("neutral_or_no_position")
    stated, directional = F.col(truth).isin(DIRECTIONAL), lambda x: F.col(x).isin(DIRECTIONAL)
    tests = {
        "overread": (~stated, directional),
        "reversal": (stated, lambda x: directional(x) & (F.col(x) != F.col(truth))),
        "any_error": (F.lit(True), lambda x: four(F.col(x)) != F.col(truth)),
    }
    sums, cells = [], []
    for o in others:
        for k, (within, wrong) in tests.items():
            i, a, b = len(cells), wrong(base), wrong(o)
            sums += [count_if(c).alias(f"{v}{i}") for v, c in (("n", within), ("a", within & a), ("b", within & b), ("f", within & a & ~b), ("w", within & ~a & b))]
            cells.append(F.struct(F.lit(f"{base}/{o}").alias("pair"), F.lit(k).alias("test"), *[F.col(f"{v}{i}").alias(v) for v in "nabfw"]))
    t = rows.groupBy(*by).agg(*sums).select(*by, F.explode(F.array(*cells)).alias("t")).select(*by, "t.*")
    rate = lambda v: ratio(F.col(v), F.col("n"))
    return t.select(*by, "pair", "test", "n", rate("a").alias("rate_base"), rate("b").alias("rate_other"), (rate("b") - rate("a")).alias("difference"), F.col("f").alias("fixed"), F.col("w").alias("broken"), mcnemar(F.col("f"), F.col("w")).alias("p_value"))


def pair_support(tests: DataFrame, by: list[str] = [], alpha: float = 0.05, slack: float = 0.05) -> DataFrame:  # noqa: B006
    """A pair is supported if over-reading falls significantly and reversals rise by no more than ``slack``."""
    at = lambda k, c: F.max(F.when(F.col("test") == k, F.col(c)))
    falls = (at("overread", "p_value") < alpha) & (at("overread", "difference") < 0)
    return tests.groupBy(*by, "pair").agg((falls & (at("reversal", "difference") <= slack)).alias("supported"))


def contested_overread(df: DataFrame, by: list[str], outcome: str, consensus: str, labels: list[str], directional: list[str]) -> DataFrame:
    """Over-reading where the consensus has no direction, split by whether any annotator saw one."""
    seen = F.size(F.filter(F.array_distinct(F.array(*labels)), lambda x: x.isin(directional))) > 0
    base = df.filter(F.col(consensus).isNotNull() & ~F.col(consensus).isin(DIRECTIONAL))
    read = F.col(outcome).isin(DIRECTIONAL)
    return base.groupBy(*by).agg(
        count_if(seen).alias("contested_n"), count_if(seen & read).alias("contested_k"), count_if(~seen).alias("plain_n"), count_if(~seen & read).alias("plain_k"),
        share(F.when(seen, read)).alias("contested_rate"), share(F.when(~seen, read)).alias("plain_rate"),
    )


def determinism(pairs: DataFrame, by: list[str], least_prefix: int = 200) -> DataFrame:
    """Two runs of one request: equal texts and outcomes, flips of direction, long common prefixes."""
    a, b = F.col("outcome_a"), F.col("outcome_b")
    same = F.col("text_a") == F.col("text_b")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), share(same).alias("same_text"), share(a == b).alias("same_outcome"), count_if(a.isin(DIRECTIONAL) & b.isin(DIRECTIONAL) & (a != b)).alias("flips"),
        share(F.col("prefix") >= least_prefix).alias("long_prefix"), F.median("prefix").alias("median_prefix"),
    )


def cut_effect(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How often the outcome changes with the length of the text, and where the shorter text starts the longer one."""
    starts = F.when(F.length("text_a") <= F.length("text_b"), F.startswith("text_b", "text_a")).otherwise(F.startswith("text_a", "text_b"))
    d = pairs.withColumns({"_starts": starts, "_changed": F.col("outcome_a") != F.col("outcome_b")})
    return d.groupBy(*by).agg(F.count("*").alias("n_pairs"), count_if(F.col("_starts")).alias("n_prefix"), count_if(F.col("_changed")).alias("n_changed"), share(F.col("_changed")).alias("changed_share"), count_if(F.col("_changed") & F.col("_starts")).alias("n_changed_prefix"))


def selection_check(df: DataFrame, by: list[str], prompts: list[str], sf_prompt: str = "stance_first") -> DataFrame:
    """Per released prompt: stance-first direction on the item and polarity pairs that it commits, and on the rest.

    The pairs' membership is a flag from one aggregation per pair, not a join of the frame with itself.
    """
    flags = [F.max((F.col("prompt") == p) & F.col("is_directional")).alias(f"_p{i}") for i, p in enumerate(prompts)]
    per = df.groupBy(*by, "item_id", "polarity", "item_lean").agg(F.min(F.when(F.col("prompt") == sf_prompt, F.col("outcome"))).alias("sf"), *flags).filter("sf IS NOT NULL")
    long = per.select(*by, "item_lean", "sf", F.explode(F.array(*[F.struct(F.lit(p).alias("prompt"), F.coalesce(f"_p{i}", F.lit(False)).alias("c")) for i, p in enumerate(prompts)])).alias("e")).select(*by, "item_lean", "sf", "e.*")
    o, lean, c = F.col("sf"), F.col("item_lean"), F.col("c")
    out = long.groupBy(*by, "prompt").agg(count_if(c).alias("in_n"), count_if(~c).alias("rest_n"), direction_index(o, lean, c).alias("d_in"), direction_index(o, lean, ~c).alias("d_rest"))
    return out.filter("in_n > 0").withColumn("difference", F.col("d_in") - F.col("d_rest"))


def questions(cells: DataFrame, keys: list[str], specs: list[tuple[str, dict[str, str], dict[str, str]]], values: list[str]) -> DataFrame:
    """Differences b - a between named cells: (question, a, b) per row. Cells are one aggregated row each.

    Each question is a conditional aggregate, so the cells are read once however many questions there are.
    """
    is_ = lambda at: reduce(lambda x, y: x & y, (F.col(k) == at[k] for k in keys))
    rows = [F.struct(F.lit(q).alias("question"), *[(F.max(F.when(is_(b), F.col(v))) - F.max(F.when(is_(a), F.col(v)))).alias(f"d_{v}") for v in values]) for q, a, b in specs]
    return cells.agg(F.array(*rows).alias("q")).select(F.explode("q").alias("q")).select("q.*")


def paired_prompts(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Position under prompt b less that under prompt a, per key, for all pairs and those complete on both sides."""
    at = lambda p, c: F.max(F.when(F.col("prompt") == p, F.col(c).cast("int")))
    got = df.filter(F.col("prompt").isin(a, b)).groupBy(*keys).agg(at(a, "is_position").alias("a"), at(b, "is_position").alias("b"), at(a, "response_complete").alias("ca"), at(b, "response_complete").alias("cb"))
    got = got.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("difference", F.col("b") - F.col("a"))
    scopes = F.array_compact(F.array(F.lit("all"), F.when((F.col("ca") == 1) & (F.col("cb") == 1), "both_completed")))
    return got.select(*keys, F.explode(scopes).alias("scope"), "difference")


def subsets(df: DataFrame, members: dict[str, Column]) -> DataFrame:
    """Each row once per subset that it belongs to; subsets may overlap."""
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in members.items()]))))


def by_weight(df: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight says, numbered from 1."""
    return df.withColumn("_copies", weight.cast("int")).filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value_a, value_b) of every cell that differs, null-safe; rows on one side only count as nulls."""
    long = lambda d, v: d.unpivot(key, columns, "column", v)
    both = long(a.select(key, *[F.col(c).cast("string") for c in columns]), "value_a").join(long(b.select(key, *[F.col(c).cast("string") for c in columns]), "value_b"), [key, "column"], "full")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def set_algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the difference, the intersection and the other difference of two key sets, in one aggregation."""
    sides = a.select(key, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(b.select(key, F.lit(False).alias("a"), F.lit(True).alias("b")))
    per = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(count_if(F.col("a") & ~F.col("b")).alias("only_a"), count_if(F.col("a") & F.col("b")).alias("in_both"), count_if(~F.col("a") & F.col("b")).alias("only_b"))


def recovered_links(rows: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """Rows with the columns that the digest's known prompt carries; rows without one keep nulls and say so."""
    return rows.join(known.dropDuplicates([digest]).withColumn("_known", F.lit(True)), digest, "left").withColumn("matched", F.col("_known").isNotNull()).drop("_known")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def magnitude_reading(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "not_estimable").when(low > 0, "larger").when(high < 0, "attenuated").otherwise("no_change")


def shift_reading(delta: tuple[Column, Column], did: tuple[Column, Column]) -> Column:
    """A change remains if the difference in differences confirms it too."""
    changed, specific = excludes_zero(*delta), excludes_zero(*did)
    return F.when(changed & specific, "remains").when(changed, "not_larger_than_explicit").otherwise("not_detected")
