"""A corpus pipeline: five stages, each an operator whose decisions take effect on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.llm.decontamination import contaminated
from quorumlake.llm.jaccard import other_key, row_key, similar_sets
from quorumlake.llm.language import UNDETERMINED, fit, predict
from quorumlake.llm.lines import drop_boilerplate
from quorumlake.llm.packing import pack, tokenized
from quorumlake.runtime import broadcast_if_small, discard, free_name, materialize

LEAST_SCORE = 0.5


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labels teach, predicted with a score of 0.5 or more.

    Null and empty texts and texts without a letter are in no language and go; repeated rows are judged alike. An empty
    table, or one without labels, gives an empty one.
    """
    pred, score = free_name("lang_pred", docs), free_name("lang_score", docs)
    out = predict(docs, fit(docs, F.lit(True)), pred=pred, score=score)
    return out.filter((F.col(pred) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut each source's boilerplate lines; a document left without a line that isn't blank goes.

    Null texts and texts that lose no line stay as they are; repeated rows are pages of their own.
    """
    out = drop_boilerplate(docs)
    dropped = F.col(out.columns[-1])
    return _with_length(out.filter((dropped == 0) | (F.trim("text") != "")).select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by 0.8 of five-word shingles: that of the smallest doc_id, null ids last.

    Rows are told apart by id and text, so another text under a repeated id is judged for itself; of rows that agree in
    both one stays. Texts without words, null ones too, are in no group and stay. An empty table stays empty.
    """
    found = materialize(similar_sets(docs, 80, 100, 5).filter("component IS NOT NULL"), "groups")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "rk", "rq")
    best = found.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("many")).filter("many > 1")
    own = (F.col("rk") == F.col("best.rk")) & (F.col("rq") == F.col("best.rq"))
    rows = found.join(best, "component").select("rk", "rq", own.alias("stays"))
    rows = materialize(rows.groupBy("rk", "rq").agg(F.first("stays").alias("stays"), F.count("*").alias("many")).filter("many > 1 OR NOT stays"), "rows")
    discard(found)
    rk, rq, stays = (free_name(n, docs) for n in ("rk", "rq", "stays"))
    keyed = docs.withColumns({rk: row_key(), rq: other_key()})
    named = keyed.join(broadcast_if_small(rows.select(F.col("rk").alias(rk), F.col("rq").alias(rq), F.col("stays").alias(stays)), 40), [rk, rq], "left")
    once = named.filter(F.col(stays)).dropDuplicates([rk, rq])  # few: rows with equal id and text
    return named.filter(F.col(stays).isNull()).unionByName(once).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text leaks a benchmark item; another text under the same doc_id is judged for itself.

    Null and empty texts leak nothing; rows that agree in id and text go together.
    """
    rk = free_name("rk", docs)
    keyed = docs.withColumn(rk, F.concat_ws(":", row_key().cast("string"), other_key().cast("string")))
    found = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=rk)
    found = materialize(found.select(F.col("doc_id").alias(rk)).distinct(), "leaks")
    return keyed.join(broadcast_if_small(found, 60), rk, "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens; one row per piece. Null and empty texts are one token long; repeated rows are packed each."""
    return pack(tokenized(docs))[0]


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", packing)]
ORACLE_SQL = None  # language ID, latent search and packing can't be written in SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = materialize(stage(spark, docs, sf_dir), "stage")
        discard(docs)  # a later stage reads the last table only
        docs = out
    return docs
