"""Tables as they are printed: counts, rates and intervals in words and two digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.functions.stats import half_even, half_up, ratio, signed, wilson


def two(x: Column) -> Column:
    """Two digits, half up; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.2f", half_up(x).cast("double")))


def counts(k: Column, n: Column) -> Column:
    return F.format_string("%d/%d", k, n)


def bracket(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), two(low), F.lit(", "), two(high), F.lit("]")))


def p_text(p: Column) -> Column:
    """Three digits below 0.01, else two."""
    return F.when(p < 0.01, F.format_string("%.3f", p)).otherwise(two(p))


def audit_table(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Judged against human commitment from counts yes, no, over, under: rates with counts, accuracy, kappa, errors with intervals."""
    yes, no, over, under = (F.col(c).cast("double") for c in ("yes", "no", "over", "under"))
    n = yes + no + over + under
    chance = ratio((yes + over) * (yes + under) + (no + under) * (no + over), n * n)
    rate = lambda k: F.concat(two(ratio(k, n)), F.lit(" ("), k.cast("long").cast("string"), F.lit(")"))
    error = lambda k, m: F.concat(counts(k.cast("long"), m.cast("long")), F.lit(" "), F.coalesce(bracket(*wilson(k, m)), F.lit("[]")))
    return metrics.select(
        *by, n.cast("long").alias("n"), rate(yes + under).alias("human_commit"), rate(yes + over).alias("judged_commit"), two(ratio(yes + no, n)).alias("accuracy"),
        two(F.when(chance < 1, (ratio(yes + no, n) - chance) / (1 - chance))).alias("kappa"), error(over, no + over).alias("overread"), error(under, yes + under).alias("underread"),
    )


def pole_table(contrasts: DataFrame, effect: DataFrame | None = None) -> DataFrame:
    """Contrasts of poles: counts of both, signed difference, interval, p value; and the asymmetries of ``effect`` with their bootstrap intervals."""
    out = contrasts.select("quantity", counts(F.col("k1"), F.col("n1")).alias("left"), counts(F.col("k2"), F.col("n2")).alias("right"), signed(F.col("difference")).alias("difference"), bracket(F.col("low"), F.col("high")).alias("interval"), p_text(F.col("p_value")).alias("p_value"))
    if effect is None:
        return out
    none = F.lit("")
    more = effect.select("quantity", none.alias("left"), none.alias("right"), signed(F.col("estimate")).alias("difference"), F.concat(F.lit("bootstrap "), bracket(F.col("low"), F.col("high"))).alias("interval"), none.alias("p_value"))
    return out.unionByName(more)


def design_table(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """Strata of a two-phase design: units in the population, units sampled, weight; a stratum without sample has none."""
    n = population.groupBy(stratum).agg(F.count("*").alias("population")).join(sample.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("sampled")), F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return n.select(stratum, "population", F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"), half_even(ratio(F.col("population"), F.col("sampled")), 2).alias("weight"))


def estimate_table(estimates: DataFrame, name: str, value: str) -> DataFrame:
    """Signed estimates with intervals; what has none yet is 'pending'."""
    pending = lambda c: F.coalesce(c, F.lit("pending"))
    return estimates.select(name, pending(signed(F.col(value))).alias("estimate"), pending(bracket(F.col("low"), F.col("high"))).alias("interval"))


def commitment_table(model: DataFrame, by: list[str], prompts: int = 5) -> DataFrame:
    """Commitment rates by pole: mean number of commitments over the number of prompts, and the share that never commits, to three digits."""
    return model.select(*by, F.col("pairs").cast("long").alias("pairs"), half_even(F.col("mean_k") / prompts, 3).alias("commit_rate"), half_even(F.col("never_share"), 3).alias("never_share"))
