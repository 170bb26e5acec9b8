"""The study's tables, projected from the driver's tables by integer arithmetic, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quorumlake.operators import frame as fr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a, b: int):  # noqa: ANN001, ANN202
    return F.floor(F.col(a) / b).cast("long")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    d = d.select(
        "*", F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), (F.col("doc_id") % 23 + 23 * _div("doc_id", 828)).alias("item_ord"),
        F.when(_div("doc_id", 23) % 2 == 0, "orig").otherwise("inv").alias("polarity"), (_div("doc_id", 46) % 6).alias("prompt_no"),
        F.concat(F.lit("s"), (_div("doc_id", 276) % 3 + 1).cast("string")).alias("stage"),
        F.when(F.col("doc_id") % 97 == 0, "error").when(F.col("n_chars") >= 2000, "length").otherwise("stop").alias("finish_reason"),
    )
    own = F.when(F.col("item_ord") % 2 == 0, "left").otherwise("right")
    return d.withColumns({"item_id": F.concat(F.lit("it"), F.lpad(F.col("item_ord").cast("string"), 5, "0")), "prompt": F.when(F.col("prompt_no") == 0, "stance_first").otherwise(F.concat(F.lit("free_"), F.col("prompt_no").cast("string"))), "item_lean": fr.polarity_lean(own, F.col("polarity"))})


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three evaluators' outcomes of each response."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    b1, b2 = (F.col("n_chars") + 31 * F.col("doc_id")) % 20, (F.col("n_chars") + 17 * F.col("doc_id")) % 20
    b3 = F.when(F.col("doc_id") % 5 == 0, b2).otherwise(b1)
    long = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f"e{i}").alias("evaluator"), b.alias("b")) for i, b in enumerate((b1, b2, b3), 1)])).alias("e")).select("doc_id", "e.*")
    b = F.col("b")
    outcome = F.when(F.col("doc_id") % 97 == 0, "generation_error").when(b < 7, "agreement").when(b < 12, "disagreement").when(b < 15, "mixed_or_conditional").when(b < 18, "neutral_or_no_position").when(b == 18, "refusal").otherwise("malformed")
    return long.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), "evaluator", outcome.alias("outcome"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.build(records(spark, sf_dir), evaluations(spark, sf_dir))


def humans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators' labels of the labelled documents."""
    lab = table(spark, sf_dir, "labels")
    a = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supports").when((F.col("quality") == 0) & (F.col("toxic") == 1), "opposes").when(F.col("quality") == 1, "mixed_or_conditional").otherwise("neutral_or_no_position")
    c = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, "opposes").otherwise("neutral_or_no_position")).otherwise(a)
    return lab.select("doc_id", a.alias("relation_a"), c.alias("relation_c"), F.when(F.col("toxic") == 1, "claim").otherwise("essay").alias("mode_a"), F.when((F.col("toxic") == 1) | (F.col("doc_id") % 6 == 0), "claim").otherwise("essay").alias("mode_c"))


def human_outcome(relation: str):  # noqa: ANN201
    c = F.col(relation)
    return F.when(c == "supports", "agreement").when(c == "opposes", "disagreement").otherwise(c)


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rows with annotator A's label as an outcome."""
    h = humans(spark, sf_dir).select("doc_id", human_outcome("relation_a").alias("human"), "relation_c")
    return frame(spark, sf_dir).join(h, "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "response": F.lead("text").over(w)})
    return nxt.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


SQL_FRAME = """
g AS (SELECT doc_id, n_chars, lang, source, sha256(CAST(doc_id AS VARCHAR)) AS cache_key, doc_id % 23 + 23 * (doc_id // 828) AS item_ord,
  CASE WHEN (doc_id // 23) % 2 = 0 THEN 'orig' ELSE 'inv' END AS polarity, (doc_id // 46) % 6 AS prompt_no, 's' || CAST((doc_id // 276) % 3 + 1 AS VARCHAR) AS stage,
  CASE WHEN doc_id % 97 = 0 THEN 'error' WHEN n_chars >= 2000 THEN 'length' ELSE 'stop' END AS finish_reason FROM documents),
r AS (SELECT *, 'it' || lpad(CAST(item_ord AS VARCHAR), 5, '0') AS item_id, CASE WHEN prompt_no = 0 THEN 'stance_first' ELSE 'free_' || CAST(prompt_no AS VARCHAR) END AS prompt,
  CASE WHEN (item_ord % 2 = 0) = (polarity = 'orig') THEN 'left' ELSE 'right' END AS item_lean FROM g),
o AS (SELECT r.*, e.evaluator, CASE WHEN e.evaluator = 'e1' OR (e.evaluator = 'e3' AND doc_id % 5 <> 0) THEN (n_chars + 31 * doc_id) % 20 ELSE (n_chars + 17 * doc_id) % 20 END AS b
  FROM r CROSS JOIN (SELECT unnest(['e1', 'e2', 'e3']) AS evaluator) e),
q AS (SELECT *, CASE WHEN finish_reason = 'error' THEN 'generation_error' WHEN b < 7 THEN 'agreement' WHEN b < 12 THEN 'disagreement' WHEN b < 15 THEN 'mixed_or_conditional'
  WHEN b < 18 THEN 'neutral_or_no_position' WHEN b = 18 THEN 'refusal' ELSE 'malformed' END AS outcome FROM o),
f AS (SELECT *, finish_reason = 'length' AS truncated, finish_reason = 'stop' AS response_complete, outcome IN ('agreement', 'disagreement', 'mixed_or_conditional') AS is_position,
  outcome IN ('agreement', 'disagreement') AS is_directional,
  (outcome = 'agreement' AND item_lean = 'left') OR (outcome = 'disagreement' AND item_lean = 'right') AS left_aligned FROM q)"""

SQL_HUMANS = """
h AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supports' WHEN quality = 0 AND toxic = 1 THEN 'opposes' WHEN quality = 1 THEN 'mixed_or_conditional' ELSE 'neutral_or_no_position' END AS relation_a, toxic FROM labels),
hc AS (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 'opposes' WHEN doc_id % 4 = 0 THEN 'neutral_or_no_position' ELSE relation_a END AS relation_c, CASE WHEN toxic = 1 THEN 'claim' ELSE 'essay' END AS mode_a,
  CASE WHEN toxic = 1 OR doc_id % 6 = 0 THEN 'claim' ELSE 'essay' END AS mode_c FROM h),
hf AS (SELECT f.*, relation_c, CASE relation_a WHEN 'supports' THEN 'agreement' WHEN 'opposes' THEN 'disagreement' ELSE relation_a END AS human FROM f JOIN hc USING (doc_id))"""
