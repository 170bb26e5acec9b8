"""Agreement of two raters. Inputs have one row per rated unit; results are one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.functions.stats import count_if, ratio, share, wilson
from quorumlake.functions.taxonomy import DIRECTIONAL


def confusion(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """One row per label of ``a``, a column per label of ``b``, zeros filled."""
    return df.groupBy(F.col(a).alias("label")).pivot(b, labels).agg(F.count(F.lit(1))).na.fill(0)


def _marginals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group and label: how often each rater gave it, and both."""
    each = F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))
    long = counts.select(*by, F.explode(each).alias("e"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"))
    sums = long.groupBy(*by, F.col("e.label").alias("label")).agg(F.sum("e.na").alias("na"), F.sum("e.nb").alias("nb"), F.sum(F.when(F.col("e.na") > 0, F.col("same"))).alias("both"))
    return sums.withColumn("both", F.coalesce("both", F.lit(0)))


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """n, accuracy, Cohen's kappa, macro-F1 over all labels, and over the labels of ``b`` only.

    Rows with a null rating are left out. Kappa is null where chance agreement is 1. Everything follows from the
    confusion counts, so the rows are aggregated once.
    """
    counts = confusion(df.na.drop(subset=[a, b]), a, b, by)
    m = _marginals(counts, by)
    f1 = F.coalesce(ratio(2 * F.col("both"), F.col("na") + F.col("nb")), F.lit(0.0))
    out = m.groupBy(*by).agg(
        F.sum("na").alias("n"),
        F.sum("both").alias("same"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"),
        F.avg(f1).alias("macro_f1"),
        F.avg(F.when(F.col("nb") > 0, f1)).alias("macro_f1_reference"),
    )
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.col("products") < F.col("n").cast("double") * F.col("n"), (po - pe) / (1 - pe))
    return out.select(*by, "n", po.alias("accuracy"), kappa.alias("kappa"), "macro_f1", "macro_f1_reference")


def label_f1(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    m = _marginals(confusion(df.na.drop(subset=[a, b]), a, b, by), by)
    return m.select(*by, "label", F.coalesce(ratio(2 * F.col("both"), F.col("na") + F.col("nb")), F.lit(0.0)).alias("f1"))


def reading_errors(pred: Column, truth: Column) -> dict[str, Column]:
    """Conditions: a stance read where there is none, missed where there is one, or reversed."""
    p, t = pred.isin(DIRECTIONAL), truth.isin(DIRECTIONAL)
    return {"overread": p & ~t, "underread": ~p & t, "reversed": p & t & (pred != truth), "both": p & t, "stated": t, "unstated": ~t}


def evaluator_metrics(df: DataFrame, by: list[str], pred: str = "outcome", truth: str = "human") -> DataFrame:
    """Error counts, rates and Wilson intervals per group over the rows with a human label."""
    e = reading_errors(F.col(pred), F.col(truth))
    out = df.filter(F.col(truth).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), share(F.col(pred) == F.col(truth)).alias("accuracy"), *[count_if(c).alias(f"{k}_k") for k, c in e.items()])
    for name, base in (("overread", "unstated_k"), ("underread", "stated_k"), ("reversed", "both_k")):
        low, high = wilson(F.col(f"{name}_k"), F.col(base))
        out = out.withColumns({f"{name}_rate": ratio(F.col(f"{name}_k"), F.col(base)), f"{name}_low": low, f"{name}_high": high})
    return out


def commitment_metrics(df: DataFrame, judged: str, human: str, by: list[str]) -> DataFrame:
    """Agreement of two 0/1 readings: accuracy, positive and negative agreement, over- and under-reading."""
    j, h = F.col(judged) == 1, F.col(human) == 1
    out = df.groupBy(*by).agg(F.count("*").alias("n"), count_if(j & h).alias("yes"), count_if(~j & ~h).alias("no"), count_if(j & ~h).alias("over"), count_if(~j & h).alias("under"))
    return out.withColumns({
        "accuracy": ratio(F.col("yes") + F.col("no"), F.col("n")),
        "positive_agreement": ratio(2 * F.col("yes"), 2 * F.col("yes") + F.col("over") + F.col("under")),
        "negative_agreement": ratio(2 * F.col("no"), 2 * F.col("no") + F.col("over") + F.col("under")),
        "overread_rate": ratio(F.col("over"), F.col("no") + F.col("over")),
        "underread_rate": ratio(F.col("under"), F.col("yes") + F.col("under")),
    })


def threshold_sweep(df: DataFrame, a: str, b: str, confidence: str, levels: list[float]) -> DataFrame:
    """Rows kept, accuracy and macro-F1 (over all labels of either side) at each least confidence, levels without rows too.

    A row is counted once by the highest level that it reaches; the counts, not the rows, are then repeated at each
    level up to it, so a sweep costs one aggregation of the rows whatever the number of levels.
    """
    reached = F.array_max(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col(confidence)))
    counts = df.na.drop(subset=[a, b]).withColumn("_top", reached).filter("_top IS NOT NULL").groupBy("_top", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    each = counts.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("_top")))).groupBy("threshold", "a", "b").agg(F.sum("n").alias("n"))
    m = _marginals(each, ["threshold"])
    f1 = F.coalesce(ratio(2 * F.col("both"), F.col("na") + F.col("nb")), F.lit(0.0))
    found = m.groupBy("threshold").agg(F.sum("na").alias("retained"), F.sum("both").alias("same"), F.avg(f1).alias("macro_f1"))
    grid = df.sparkSession.createDataFrame([(x,) for x in levels], "threshold double")
    out = grid.join(found, "threshold", "left").na.fill(0, ["retained"])
    return out.select("threshold", "retained", ratio(F.col("same"), F.col("retained")).alias("accuracy"), "macro_f1")
