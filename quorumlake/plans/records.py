"""Queries on stores that are written and read back, and on what is derived from their records, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.functions import stats as st, text as tx
from quorumlake.functions.taxonomy import PAIR_OUTCOMES, PROMPT_PREFIXES, RULES
from quorumlake.operators import direction as di, frame as fr, labels as lb, paired as pa, scorers as sc
from quorumlake.plans import projection as pj
from quorumlake.plans.registry import F_, H_, _wil, query, rounded
from quorumlake.runtime import broadcast_if_small, scratch_dir
from quorumlake.sources import stores
from quorumlake.sources.schemas import EVALUATION, GENERATION

MARK = "<|user|>"


def _path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A generation record per document, nested as in the store."""
    r = pj.records(spark, sf).join(pj.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    failed = F.col("finish_reason") == "error"
    rendered = F.concat(F.when(F.col("doc_id") % 2 == 0, MARK).otherwise(""), F.lit("Q"), (F.col("doc_id") % 23).cast("string"))
    decoding = F.struct(F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p"), F.lit(600).alias("max_new_tokens"), (F.col("doc_id") % 4).cast("int").alias("seed"))
    request = F.struct(
        F.sha2(rendered, 256).alias("rendered_prompt_hash"), rendered.alias("rendered_text"), F.concat(F.lit("m-"), "stage").alias("model_id"), F.lit("r1").alias("model_revision"), F.lit("r1").alias("tokenizer_revision"),
        F.when(F.col("doc_id") % 3 == 0, "local").otherwise("served").alias("backend"), F.lit("bf16").alias("precision"), decoding.alias("decoding"), F.col("item_id"), F.concat_ws("::", "item_id", "polarity").alias("variant_id"),
        F.concat_ws("__", "prompt", "polarity").alias("template_id"),
    )
    gpu = F.struct((F.col("doc_id") % 2).cast("int").alias("physical_index"), F.lit("u").alias("uuid"), F.lit("d").alias("driver_version"), F.lit(250.0).alias("power_limit_w"))
    return r.select(
        "cache_key", request.alias("request"), F.when(failed, "").otherwise(F.col("text")).alias("raw_text"), "finish_reason", (F.col("n_chars") % 50).cast("int").alias("input_tokens"),
        F.floor(F.col("n_chars") / 5).cast("int").alias("output_tokens"), (F.col("n_chars") / 4).alias("latency_seconds"), F.when(F.col("doc_id") % 3 == 0, gpu).alias("gpu"), F.when(failed, "timeout").alias("error"),
        F.col("doc_id").cast("double").alias("timestamp"), F.lit(8).alias("batch_size"),
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("evaluator")
    return pj.evaluations(spark, sf).select(F.col("cache_key").alias("generation_cache_key"), e.alias("evaluator_id"), F.lit("1").alias("evaluator_version"), "outcome", F.when(e != "e1", 0.5).alias("confidence"), F.when(e == "e2", F.upper("outcome")).alias("native_label"), F.lit(None).cast("string").alias("notes"))


def _generation_store(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    stores.append_exclusive(_records(spark, sf), path, GENERATION, ["cache_key"])
    return stores.generations(spark, path)


def _evaluation_store(spark: SparkSession, sf: str, ids: list[str] | None = None) -> DataFrame:
    path = _path(spark)
    stores.append_idempotent(_results(spark, sf), path)
    return stores.evaluations(spark, path, ids)


_G = F_ + """,
gen AS (SELECT r.*, CASE WHEN finish_reason = 'error' THEN '' ELSE d.text END AS raw_text, CASE WHEN r.doc_id % 2 = 0 THEN '<|user|>' ELSE '' END || 'Q' || CAST(r.doc_id % 23 AS VARCHAR) AS rendered_text,
  CAST(r.n_chars % 50 AS BIGINT) AS input_tokens, CAST(r.n_chars // 5 AS BIGINT) AS output_tokens FROM r JOIN documents d USING (doc_id)),
ends AS (SELECT *, CASE WHEN contains(rendered_text, '<|user|>') THEN 'native' ELSE 'raw' END AS render, raw_text IS NULL OR NOT regexp_matches(raw_text, '\\S') AS empty FROM gen)"""


@query("""SELECT g.cache_key, item_id, item_id || '::' || polarity AS variant_id, prompt || '__' || polarity AS template_id, 'm-' || stage AS model_id, 'r1' AS model_revision, CASE WHEN g.doc_id % 3 = 0 THEN 'local' ELSE 'served' END AS backend, 'bf16' AS precision,
  CAST(g.doc_id % 4 AS BIGINT) AS seed, 0.0::DOUBLE AS temperature, sha256(rendered_text) AS rendered_prompt_hash, g.finish_reason, input_tokens, output_tokens, g.n_chars / 4 AS latency_seconds, CASE WHEN g.doc_id % 3 = 0 THEN CAST(g.doc_id % 2 AS BIGINT) END AS gpu_physical_index,
  CASE WHEN g.doc_id % 3 = 0 THEN 250.0::DOUBLE END AS gpu_power_limit_w, CASE WHEN g.finish_reason = 'error' THEN 'timeout' END AS error, q.evaluator AS evaluator_id, '1' AS evaluator_version, q.outcome, CASE WHEN q.evaluator = 'e2' THEN upper(q.outcome) END AS native_label,
  CASE WHEN q.evaluator <> 'e1' THEN 0.5::DOUBLE END AS confidence, g.finish_reason = 'length' AS truncated, g.finish_reason = 'stop' AS response_complete, CASE WHEN g.finish_reason = 'length' THEN q.outcome IN ('agreement', 'disagreement', 'mixed_or_conditional') END AS stance_observed_before_truncation
  FROM gen g JOIN (SELECT cache_key, evaluator, outcome FROM q) q ON q.cache_key = g.cache_key""", _G)
def generation_frame(spark, sf):
    """All 26 columns, from stores that were written and read back."""
    return rounded(fr.project(_generation_store(spark, sf), _evaluation_store(spark, sf)))


@query("SELECT g.cache_key, q.evaluator AS evaluator_id, sha256(coalesce(g.raw_text, 'none')) AS text_digest FROM gen g JOIN (SELECT cache_key, evaluator FROM q) q ON q.cache_key = g.cache_key", _G)
def frame_with_text(spark, sf):
    found = fr.project(_generation_store(spark, sf), _evaluation_store(spark, sf), text=True)
    return found.select("cache_key", "evaluator_id", F.sha2(F.coalesce("raw_text", F.lit("none")), 256).alias("text_digest"))


@query("""SELECT render, prompt, polarity, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE finish_reason = 'error') AS BIGINT) AS errors, round(avg(CAST(empty AS INT)), 6) AS empty_rate, round(avg(CAST(finish_reason = 'stop' AND output_tokens <= 1 AS INT)), 6) AS immediate_eos_rate,
  round(avg(CAST(finish_reason = 'stop' AND NOT empty AND output_tokens <= 200 AS INT)), 6) AS completed_within_rate, round(avg(CAST(finish_reason = 'stop' AND NOT empty AS INT)), 6) AS completed_rate, round(avg(CAST(finish_reason = 'length' AS INT)), 6) AS truncated_rate,
  round(quantile_cont(output_tokens, 0.25), 6) AS output_tokens_p25, round(quantile_cont(output_tokens, 0.5), 6) AS output_tokens_p50, round(quantile_cont(output_tokens, 0.75), 6) AS output_tokens_p75 FROM ends GROUP BY render, prompt, polarity""", _G)
def generation_ends(spark, sf):
    return rounded(fr.mechanics_rates(fr.generation_mechanics(_generation_store(spark, sf), MARK), ["render", "prompt", "polarity"]))


@query("SELECT evaluator AS evaluator_id, cache_key AS generation_cache_key, outcome, native_label FROM (SELECT evaluator, cache_key, outcome, CAST(NULL AS VARCHAR) AS native_label FROM q WHERE evaluator IN ('e1', 'e3'))", F_)
def evaluations_by_id(spark, sf):
    return _evaluation_store(spark, sf, ["e1", "e3"]).select("evaluator_id", "generation_cache_key", "outcome", "native_label")


@query("SELECT CAST(count(*) AS BIGINT) AS first, CAST(0 AS BIGINT) AS again, CAST(count(*) AS BIGINT) AS stored, true AS refused FROM r", F_)
def guarded_appends(spark, sf):
    """What an idempotent append adds at first and again, and whether an exclusive one of known keys is refused."""
    path, rows = _path(spark), _results(spark, sf).filter("evaluator_id = 'e1'")
    first, again = stores.append_idempotent(rows, path), stores.append_idempotent(rows, path)
    try:
        stores.append_exclusive(rows, path, EVALUATION, stores.EVALUATION_KEY)
        refused = False
    except stores.DuplicateKeys:
        refused = True
    return stores.evaluations(spark, path).agg(F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"), F.count("*").alias("stored"), F.lit(refused).alias("refused"))


@query("SELECT evaluator AS evaluator_id, CAST(count(*) AS BIGINT) AS n FROM q WHERE evaluator <> 'e3' GROUP BY 1", F_)
def store_union(spark, sf):
    return stores.summary(stores.union(_evaluation_store(spark, sf, ["e1"]), _evaluation_store(spark, sf, ["e2"])))


@query("SELECT cache_key, sha256(CASE WHEN doc_id % 4 = 0 THEN 'answer ' || CAST(doc_id AS VARCHAR) ELSE coalesce(raw_text, 'none') END) AS text_digest FROM gen", _G)
def answer_texts(spark, sf):
    """A view over the store whose texts are replaced by derived answers where there are any."""
    d = pj.table(spark, sf, "documents").filter("doc_id % 4 = 0")
    answers = d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("answer_text"))
    return stores.answer_view(_generation_store(spark, sf), answers).select("cache_key", F.sha2(F.coalesce("raw_text", F.lit("none")), 256).alias("text_digest"))


def _csv(rows: DataFrame) -> str:
    path = _path(rows.sparkSession)
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN doc_id % 3 = 0 THEN 'NA' WHEN doc_id % 3 = 1 THEN '' ELSE 'supports' END AS relation, 'two' || chr(10) || 'lines, \"' || lang || '\"' AS notes FROM documents WHERE lang IS NOT NULL")
def label_sheet(spark, sf):
    """Cells over several lines, quotes, blanks and the text NA come back as they are."""
    d = pj.table(spark, sf, "documents").filter("lang IS NOT NULL")
    relation = F.when(F.col("doc_id") % 3 == 0, "NA").when(F.col("doc_id") % 3 == 1, "").otherwise("supports")
    path = _csv(d.select(F.col("doc_id").cast("string").alias("sample_id"), relation.alias("relation"), F.concat(F.lit('two\nlines, "'), "lang", F.lit('"')).alias("notes")))
    return stores.labels_csv(spark, path, "sample_id string, relation string, notes string")


@query("SELECT p_name AS statement, CAST(p_partkey AS VARCHAR) AS item FROM part WHERE p_partkey % 5 <> 0")
def item_bank_rows(spark, sf):
    p = pj.table(spark, sf, "part")
    path = _csv(p.select(F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("statement"), F.when(F.col("p_partkey") % 5 == 0, "na").otherwise("tax").alias("topic_label_human")))
    return stores.item_bank(spark, path).select("statement", "item")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'native' ELSE 'raw' END AS arm, CASE WHEN finish_reason = 'stop' THEN 'completed' ELSE 'truncated' END AS completeness, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS flag,
  lang AS prefix, 'recon_' || lang AS variant, 'det+zs:' || source AS evaluator FROM r WHERE lang IS NOT NULL AND source IS NOT NULL""", F_)
def names_cleaned(spark, sf):
    r = pj.records(spark, sf).filter("lang IS NOT NULL AND source IS NOT NULL")
    flag = F.element_at(F.array(*map(F.lit, ("True", "false", "1", "maybe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rendered = F.concat(F.when(F.col("doc_id") % 2 == 0, MARK).otherwise(""), "source")
    return r.select(
        "doc_id", tx.render_arm(rendered, MARK).alias("arm"), fr.completeness_of(F.col("finish_reason") == "stop").alias("completeness"), tx.true_false(flag).cast("long").alias("flag"), tx.without_start(F.concat(F.lit("set_released_"), "lang"), "set_released_").alias("prefix"),
        tx.without_seed(F.concat(F.lit("recon_"), "lang", F.lit("_seed"), (F.col("doc_id") % 7).cast("string"))).alias("variant"), tx.replaced(F.concat(F.lit("rules_v1+zeroshot:"), "source"), {"rules_v1": "det", "zeroshot": "zs"}).alias("evaluator"),
    )


_SAID = [
    "I cannot help with that", "That goes against our guidelines", "As an AI language model, I do not say", "I can't answer this", "I don't have a personal opinion", "On the one hand yes, on the other hand no", "While it is so, however it is not", "Both sides have merit",
    "It is hard to say", "There's no simple answer", "This is a contested issue", "Yes, indeed", "I agree with this statement", "No way", "I strongly disagree", "We disagree with this statement", "I disagree with this proposition", "Nothing of note",
]
_said_sql = "(VALUES " + ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(_SAID)) + ") v(i, said)"
_cases = " ".join(f"WHEN {' OR '.join(f'regexp_matches(said, {chr(39)}(?is){p.replace(chr(39), chr(39) * 2)}{chr(39)})' for p in patterns)} THEN '{outcome}'" for outcome, patterns in RULES.items())


@query(f"SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'generation_error' {_cases} ELSE 'neutral_or_no_position' END AS outcome FROM documents JOIN {_said_sql} ON doc_id % {len(_SAID)} = i")
def rule_pack(spark, sf):
    """The fixed pattern packs on sentences that meet them."""
    d = pj.table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return d.select("doc_id", tx.rule_outcome(F.concat(F.lit(" "), said, F.lit("\n")), F.when(F.col("doc_id") % 97 == 0, "error").otherwise("stop")).alias("outcome"))


def _pair_model():  # noqa: ANN202
    def model(premises: list[str], hypotheses: list[str]) -> list[dict[str, float]]:
        shares = [0.7, 0.2, 0.1]
        return [{label: shares[(k - len(p) - len(h)) % 3] for k, label in enumerate(PAIR_OUTCOMES)} for p, h in zip(premises, hypotheses, strict=True)]

    return model


@query("""SELECT sha256(CAST(doc_id AS VARCHAR)) AS generation_cache_key, ['agreement', 'disagreement', 'neutral_or_no_position'][k + 1] AS outcome, 0.7::DOUBLE AS confidence, ['entailment', 'contradiction', 'neutral'][k + 1] AS native_label,
  ['{"entailment": 0.7, "contradiction": 0.2, "neutral": 0.1}', '{"entailment": 0.1, "contradiction": 0.7, "neutral": 0.2}', '{"entailment": 0.2, "contradiction": 0.1, "neutral": 0.7}'][k + 1] AS notes
  FROM (SELECT doc_id, (length(source) + length(lang)) % 3 AS k FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""")
def pair_scores(spark, sf):
    d = pj.table(spark, sf, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    rows = d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.col("source").alias("raw_text"), F.col("lang").alias("statement"))
    return sc.PairScorer("pair", "1", _pair_model, PAIR_OUTCOMES).score(rows).select("generation_cache_key", "outcome", "confidence", "native_label", "notes")


_ASK = "Statement: {q}\nAnswer: {y}\nWhat does the answer do?"


@query("SELECT request_key, CAST(count(*) AS BIGINT) AS responses FROM (SELECT sha256('Statement: ' || lang || chr(10) || 'Answer: ' || source || chr(10) || 'What does the answer do?') AS request_key FROM r WHERE finish_reason <> 'error' AND source IS NOT NULL AND regexp_matches(source, '\\S')) WHERE request_key IS NOT NULL GROUP BY 1", F_)
def judge_prompts(spark, sf):
    """Requests to a judge, and how many responses share each."""
    r = pj.records(spark, sf).select("cache_key", F.when(F.col("finish_reason") == "error", "timeout").alias("error"), F.col("source").alias("raw_text"), F.col("lang").alias("statement"))
    return sc.judge_requests(r, _ASK).filter("request_key IS NOT NULL").groupBy("request_key").agg(F.count("*").alias("responses"))


_prefixes_sql = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PROMPT_PREFIXES.items()) + ") p(name, prefix)"


@query(f"SELECT item_id AS item, name, trim(replace(prefix, '{{model_str}}', 'm') || ' ' || item_text) AS rendered FROM (SELECT item_id, left(text, 40) AS item_text FROM benchmark) CROSS JOIN {_prefixes_sql}")
def prompt_conditions(spark, sf):
    """Each statement under the ten conditions."""
    b = pj.table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.left("text", F.lit(40)).alias("statement"))
    conditions = spark.createDataFrame(list(PROMPT_PREFIXES.items()), "name string, prefix string")
    prefix = F.replace(F.col("prefix"), F.lit("{model_str}"), F.lit("m"))
    return b.crossJoin(broadcast_if_small(conditions, 200)).select("item", "name", tx.joined_prompt(prefix, F.lit(" "), F.col("statement")).alias("rendered"))


@query("SELECT doc_id, source_of, CASE WHEN source_of = 'audit' THEN relation_a ELSE relation_c END AS relation FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'audit' ELSE 'later' END AS source_of, relation_a, relation_c FROM hc)", H_)
def routed_labels(spark, sf):
    h = pj.humans(spark, sf)
    key = h.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "audit").otherwise("later").alias("source_of"))
    sheets = {"audit": h.select("doc_id", F.col("relation_a").alias("relation")), "later": h.select("doc_id", F.col("relation_c").alias("relation"))}
    return lb.routed(key, sheets, "source_of", "doc_id", ["relation"]).select("doc_id", "source_of", "relation")


@query("""SELECT DISTINCT item_id, polarity, coalesce(k, false) AS chosen FROM r LEFT JOIN (SELECT DISTINCT item_id, polarity, true AS k FROM r WHERE doc_id % 11 = 0) USING (item_id, polarity)""", F_)
def tuple_membership(spark, sf):
    r = pj.records(spark, sf)
    return pa.one_of(r.select("item_id", "polarity").distinct(), r.filter("doc_id % 11 = 0"), ["item_id", "polarity"], "chosen").select("item_id", "polarity", "chosen")


_INDEX = "round(count(*) FILTER (WHERE {d} AND item_lean = 'left' AND {o} = 'agreement') / nullif(count(*) FILTER (WHERE {d} AND item_lean = 'left'), 0) - count(*) FILTER (WHERE {d} AND item_lean = 'right' AND {o} = 'agreement') / nullif(count(*) FILTER (WHERE {d} AND item_lean = 'right'), 0), 6)"
_DIR = "{0} IN ('agreement', 'disagreement')"


@query(""", c AS (SELECT a.*, b.outcome AS early, a.n_chars // 5 AS tokens FROM f a JOIN f b ON a.cache_key = b.cache_key AND a.evaluator = 'e1' AND b.evaluator = 'e2')
SELECT stage, prompt, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(truncated OR tokens > 200 AS INT)), 6) AS truncated_share_cut, round(avg(CAST(truncated AS INT)), 6) AS truncated_share_whole, round(avg(CAST(early IN ('agreement', 'disagreement', 'mixed_or_conditional') AS INT)), 6) AS position_rate_cut,
  round(avg(CAST(is_position AS INT)), 6) AS position_rate_whole, """ + _INDEX.format(o="early", d=_DIR.format("early")) + " AS direction_index_cut, " + _INDEX.format(o="outcome", d=_DIR.format("outcome")) + """ AS direction_index_whole,
  round(avg(CAST(outcome <> early AS INT)), 6) AS label_changed_share, round(avg(CAST(outcome <> early AND is_directional AND early IN ('agreement', 'disagreement') AS INT)), 6) AS direction_flip_share FROM c GROUP BY stage, prompt""", F_)
def cut_view_table(spark, sf):
    """Whole responses against their first 200 tokens; a second evaluator's outcome stands in for the cut text's."""
    f = pj.frame(spark, sf)
    early = f.filter("evaluator = 'e2'").select("cache_key", F.col("outcome").alias("early"))
    rows = f.filter("evaluator = 'e1'").join(early, "cache_key").withColumn("output_tokens", F.floor(F.col("n_chars") / 5))
    return rounded(di.cut_view(rows, "early", ["stage", "prompt"]))


@query("SELECT evaluator, max(shown) FILTER (WHERE stage = 's1') AS s1, max(shown) FILTER (WHERE stage = 's2') AS s2, max(shown) FILTER (WHERE stage = 's3') AS s3 FROM (SELECT evaluator, stage, printf('%d/%d [%.2f, %.2f]', k, n, CAST(round(CAST(l AS DECIMAL(20, 10)), 2) AS DOUBLE), CAST(round(CAST(h AS DECIMAL(20, 10)), 2) AS DOUBLE)) AS shown FROM (SELECT evaluator, stage, k, n, " + _wil("k", "n")[0] + " AS l, " + _wil("k", "n")[1] + " AS h FROM (SELECT evaluator, stage, CAST(count(*) FILTER (WHERE is_directional) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL))) GROUP BY evaluator", F_)
def paper_rates(spark, sf):
    """A table as printed: evaluators by stages, counts with intervals."""
    k = pj.frame(spark, sf).groupBy("evaluator", "stage").agg(st.count_if(F.col("is_directional")).alias("k"), F.count("*").alias("n"))
    shown = k.select("evaluator", "stage", st.rate_text(F.col("k"), F.col("n")).alias("shown"))
    return shown.groupBy("evaluator").pivot("stage", ["s1", "s2", "s3"]).agg(F.max("shown"))
