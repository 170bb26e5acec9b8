"""The long analysis frame and rates over full groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quorumlake.functions.stats import share
from quorumlake.functions.text import is_blank, render_arm, template_parts
from quorumlake.functions.taxonomy import DIRECTIONAL, NON_POSITION, POSITION

SCOPES = ["all", "completed_only", "truncated_only"]


class BrokenReference(ValueError):
    """Rows refer to records that don't exist."""


def require_known(evaluations: DataFrame, records: DataFrame, on: str = "cache_key") -> None:
    if bad := evaluations.join(records.select(on), on, "left_anti").limit(3).collect():
        raise BrokenReference(f"evaluations without a record: {bad}")


def build(records: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row per record and evaluation, with flags. An equi-join by key; dangling rows are for ``require_known``."""
    return flags(records.join(evaluations, "cache_key"))


FRAME_COLUMNS = {
    "cache_key": "cache_key", "item_id": "request.item_id", "variant_id": "request.variant_id", "template_id": "request.template_id", "model_id": "request.model_id",
    "model_revision": "request.model_revision", "backend": "request.backend", "precision": "request.precision", "seed": "request.decoding.seed",
    "temperature": "request.decoding.temperature", "rendered_prompt_hash": "request.rendered_prompt_hash", "finish_reason": "finish_reason",
    "input_tokens": "input_tokens", "output_tokens": "output_tokens", "latency_seconds": "latency_seconds", "gpu_physical_index": "gpu.physical_index",
    "gpu_power_limit_w": "gpu.power_limit_w", "error": "error", "evaluator_id": "evaluator_id", "evaluator_version": "evaluator_version", "outcome": "outcome",
    "native_label": "native_label", "confidence": "confidence",
}


def project(generations: DataFrame, evaluations: DataFrame, text: bool = False) -> DataFrame:
    """The whole frame of two stores: nested records flattened, one row per evaluation, three completeness columns, and the
    response itself if asked for. Only the columns in use are read from the stores."""
    rows = generations.join(evaluations.withColumnRenamed("generation_cache_key", "cache_key"), "cache_key")
    cut = F.col("finish_reason") == "length"
    out = [F.col(path).alias(name) for name, path in FRAME_COLUMNS.items()]
    out += [cut.alias("truncated"), (F.col("finish_reason") == "stop").alias("response_complete"), F.when(cut, F.col("outcome").isin(POSITION)).alias("stance_observed_before_truncation")]
    return rows.select(*out, *([F.col("raw_text")] if text else []))


def generation_mechanics(generations: DataFrame, mark: str, limit: int = 200) -> DataFrame:
    """Per record: arm, prompt and polarity, and how the generation ended."""
    prompt, polarity = template_parts(F.col("request.template_id"))
    empty, stopped = F.coalesce(is_blank(F.col("raw_text")), F.lit(True)), F.col("finish_reason") == "stop"
    return generations.select(
        "cache_key", "output_tokens", render_arm(F.col("request.rendered_text"), mark).alias("render"), prompt.alias("prompt"), polarity.alias("polarity"), empty.alias("empty"),
        (stopped & (F.col("output_tokens") <= 1)).alias("immediate_eos"), (stopped & ~empty).alias("completed"),
        (stopped & ~empty & (F.col("output_tokens") <= limit)).alias("completed_within"), (F.col("finish_reason") == "length").alias("truncated"), F.col("error").isNotNull().alias("failed"),
    )


def mechanics_rates(marked: DataFrame, by: list[str]) -> DataFrame:
    rates = {"empty_rate": "empty", "immediate_eos_rate": "immediate_eos", "completed_within_rate": "completed_within", "completed_rate": "completed", "truncated_rate": "truncated"}
    quartiles = [F.percentile("output_tokens", q).alias(f"output_tokens_p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), *[share(F.col(c)).alias(k) for k, c in rates.items()], *quartiles)


def completeness_of(response_complete: Column) -> Column:
    """Two levels: whatever isn't complete, failed generations too, counts as truncated."""
    return F.when(response_complete, "completed").otherwise("truncated")


def flags(df: DataFrame) -> DataFrame:
    """Completeness and position flags; a failed generation is neither truncated nor complete."""
    df = df.withColumns({"truncated": F.col("finish_reason") == "length", "response_complete": F.col("finish_reason") == "stop", "is_position": F.col("outcome").isin(POSITION), "is_directional": F.col("outcome").isin(DIRECTIONAL)})
    return df.withColumns({"stance_before_cut": F.when(F.col("truncated"), F.col("is_position")), "left_aligned": left_aligned(F.col("outcome"), F.col("item_lean"))})


def left_aligned(outcome: Column, lean: Column) -> Column:
    return ((outcome == "agreement") & (lean == "left")) | ((outcome == "disagreement") & (lean == "right"))


def pole(outcome: Column, lean: Column) -> Column:
    side = (outcome == "agreement").eqNullSafe(lean == "left")
    return F.when(~outcome.isin(DIRECTIONAL), "non_directional").when(side, "left_pole").otherwise("right_pole")


def polarity_lean(lean: Column, polarity: Column) -> Column:
    return F.when(polarity == "orig", lean).when(lean == "left", "right").otherwise("left")


def completeness(truncated_a: Column, truncated_b: Column) -> Column:
    return F.when(~truncated_a & ~truncated_b, "both_complete").when(truncated_a & truncated_b, "both_truncated").otherwise("mixed")


def outcome_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Count and share of each outcome among all rows of its group; null groups are groups."""
    counts = df.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))  # over one row a group and outcome
    return counts.withColumn("total", total).withColumn("rate", F.col("n") / F.col("total"))


def by_completeness(df: DataFrame, by: list[str]) -> DataFrame:
    """``outcome_rate`` for all, completed and truncated rows in one aggregation over exploded scopes."""
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("response_complete"), "completed_only"), F.when(F.col("truncated"), "truncated_only")))
    return outcome_rate(df.withColumn("scope", F.explode(scopes)), ["scope", *by])


def mechanics(df: DataFrame, by: list[str], length: str = "n_chars") -> DataFrame:
    """Shares of cut, failed and blank responses, and exact quantiles of their length."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.col("finish_reason") == "length").alias("truncated_share"),
        share(F.col("finish_reason") == "error").alias("error_share"),
        F.median(F.col(length)).alias("median_length"),
        F.percentile(length, 0.9).alias("p90_length"),
    )


def unmapped(df: DataFrame) -> DataFrame:
    """Outcomes outside the taxonomy, with their counts."""
    return df.filter(~F.col("outcome").isin(POSITION + NON_POSITION) | F.col("outcome").isNull()).groupBy("outcome").agg(F.count("*").alias("n"))


def uncovered(df: DataFrame, key: str = "cache_key") -> DataFrame:
    """Evaluators and how many records they miss."""
    n = df.agg(F.count_distinct(key).alias("records"))
    return df.groupBy("evaluator").agg(F.count_distinct(key).alias("covered")).crossJoin(F.broadcast(n)).withColumn("missing", F.col("records") - F.col("covered"))
