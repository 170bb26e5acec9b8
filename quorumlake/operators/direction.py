"""Direction of stances, commitment, and their gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quorumlake.functions.stats import count_if, ratio, share
from quorumlake.functions.taxonomy import DIRECTIONAL, POSITION
from quorumlake.operators.frame import left_aligned, pole


def direction_index(outcome: Column, lean: Column, given: Column | None = None) -> Column:
    """Aggregate: agreement rate among directional rows on left-leaning items, less that on right-leaning ones."""
    use = outcome.isin(DIRECTIONAL)
    use = use if given is None else use & given
    rate = lambda side: ratio(count_if(use & (lean == side) & (outcome == "agreement")), count_if(use & (lean == side)))
    return rate("left") - rate("right")


def direction_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """All direction measures of a group in one aggregation."""
    o, lean, use = F.col("outcome"), F.col("item_lean"), F.col("outcome").isin(DIRECTIONAL)
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.col("truncated")).alias("truncated_share"),
        share(F.col("is_position")).alias("position_rate"),
        count_if(use).alias("directional_n"),
        count_if(use & (lean == "left")).alias("left_n"),
        count_if(use & (lean == "right")).alias("right_n"),
        count_if(use & (o == "agreement")).alias("agree_n"),
        count_if(left_aligned(o, lean)).alias("aligned_n"),
        count_if((lean == "left") & (o == "agreement")).alias("agree_left"),
        count_if((lean == "right") & (o == "agreement")).alias("agree_right"),
    )
    left, right = ratio(F.col("agree_left"), F.col("left_n")), ratio(F.col("agree_right"), F.col("right_n"))
    return out.select(
        *by, "n", "truncated_share", "position_rate", "directional_n", "left_n", "right_n",
        ratio(F.col("agree_n"), F.col("directional_n")).alias("agreement_share"),
        ratio(F.col("aligned_n"), F.col("directional_n")).alias("left_aligned_share"),
        left.alias("agree_rate_left"), right.alias("agree_rate_right"), ((left + right) / 2).alias("acquiescence"), (left - right).alias("direction_index"),
    )


def units(df: DataFrame, judge: str, sf_prompt: str = "stance_first") -> DataFrame:
    """One row per free-form response of ``judge``: committed or not, with the stance-first outcome of its item and polarity."""
    own = df.filter(F.col("evaluator") == judge)
    first = own.filter(F.col("prompt") == sf_prompt).groupBy("stage", "item_id", "polarity").agg(F.min("outcome").alias("sf_outcome"))
    free = own.filter(F.col("prompt") != sf_prompt).withColumn("committed", F.col("is_directional").cast("int"))
    return free.join(first, ["stage", "item_id", "polarity"]).withColumn("sf_pole", pole(F.col("sf_outcome"), F.col("item_lean")))


def selection_gap(u: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Stance-first direction of units where the model commits, less that where it doesn't."""
    c, o = F.col("committed") == 1, F.col("sf_outcome")
    out = u.groupBy(*by).agg(
        F.count("*").alias("n"), count_if(c).alias("committed_n"),
        count_if(c & o.isin(DIRECTIONAL)).alias("directional_committed"), count_if(~c & o.isin(DIRECTIONAL)).alias("directional_rest"),
        direction_index(o, F.col("item_lean"), c).alias("d_committed"), direction_index(o, F.col("item_lean"), ~c).alias("d_rest"),
    )
    return out.withColumns({"gap": F.col("d_committed") - F.col("d_rest"), "estimable": (F.col("directional_committed") >= least) & (F.col("directional_rest") >= least)})


def decomposition(u: DataFrame, by: list[str]) -> DataFrame:
    """Direction of all stance-first answers, of committed ones, and of the free-form answers themselves."""
    lean, c = F.col("item_lean"), F.col("committed") == 1
    return u.groupBy(*by).agg(
        F.count("*").alias("n"), share(c).alias("commit_rate"), direction_index(F.col("sf_outcome"), lean).alias("d_sf_all"),
        direction_index(F.col("sf_outcome"), lean, c).alias("d_sf_committed"), direction_index(F.col("outcome"), lean).alias("d_ff_committed"),
        share(F.when(c & F.col("sf_outcome").isin(DIRECTIONAL), F.col("sf_outcome") == F.col("outcome"))).alias("same_direction"),
    )


def item_model(u: DataFrame, by: list[str]) -> DataFrame:
    """Commitments per item and polarity, averaged by pole of the stance-first answer."""
    per = u.groupBy(*by, "item_id", "polarity").agg(F.sum("committed").alias("k"), F.count("*").alias("n"), F.min("sf_pole").alias("sf_pole"))
    return per.groupBy(*by, "sf_pole").agg(F.count("*").alias("pairs"), F.avg("k").alias("mean_k"), share(F.col("k") == 0).alias("never_share"), F.sum("n").alias("units"))


def stage_contrasts(df: DataFrame, by: list[str]) -> DataFrame:
    """Differences of direction measures from each stage to the next one."""
    m = direction_metrics(df, [*by, "stage"])
    order = W.partitionBy(*by).orderBy("stage")
    names = ["position_rate", "agreement_share", "direction_index"]
    m = m.withColumn("from_stage", F.lag("stage").over(order)).withColumns({f"d_{n}": F.col(n) - F.lag(n).over(order) for n in names})
    return m.filter("from_stage IS NOT NULL").select(*by, "from_stage", F.col("stage").alias("to_stage"), *[f"d_{n}" for n in names])


def consistency(df: DataFrame, by: list[str]) -> DataFrame:
    """Item and prompt pairs with a directional answer in both polarities: consistent, or the same answer to both."""
    wide = df.groupBy(*by, "item_id", "prompt").pivot("polarity", ["orig", "inv"]).agg(F.min("outcome"))
    both = F.col("orig").isin(DIRECTIONAL) & F.col("inv").isin(DIRECTIONAL)
    return wide.filter(both).groupBy(*by).agg(F.count("*").alias("pairs"), share(F.col("orig") != F.col("inv")).alias("consistent"), share((F.col("orig") == "agreement") & (F.col("inv") == "agreement")).alias("agrees_with_both"), share((F.col("orig") == "disagreement") & (F.col("inv") == "disagreement")).alias("disagrees_with_both"))


def cut_view(df: DataFrame, cut_outcome: str, by: list[str], length: str = "output_tokens", limit: int = 200) -> DataFrame:
    """Measures of whole responses and of what they say within ``limit`` tokens (``cut_outcome``), and how labels change.

    Both views are aggregations of the same rows, so nothing is joined.
    """
    short = df.withColumn("outcome", F.col(cut_outcome)).withColumns({"truncated": F.col("truncated") | (F.col(length) > limit), "is_position": F.col("outcome").isin(POSITION)})
    both = df.withColumn("_view", F.lit("whole")).unionByName(short.withColumn("_view", F.lit("cut")))
    wide = direction_metrics(both, [*by, "_view"]).groupBy(*by)
    at = lambda view, c: F.max(F.when(F.col("_view") == view, F.col(c)))
    out = wide.agg(F.max("n").alias("n"), *[at(v, c).alias(f"{c}_{v}") for c in ("truncated_share", "position_rate", "direction_index") for v in ("cut", "whole")])
    a, b = F.col("outcome"), F.col(cut_outcome)
    changed = df.groupBy(*by).agg(share(a != b).alias("label_changed_share"), share(a.isin(DIRECTIONAL) & b.isin(DIRECTIONAL) & (a != b)).alias("direction_flip_share"))
    return out.join(changed, by)
