"""All queries and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.functions import stats as st, text as tx
from quorumlake.functions.taxonomy import DIRECTIONAL, POSITION
from quorumlake.operators import agreement as ag, direction as di, frame as fr, labels as lb, paired as pa, resample as rs, sampling as sa, series as se
from quorumlake.plans import projection as pj
from quorumlake.runtime import broadcast_if_small
from quorumlake.sources import stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REPS = 200
F_, H_ = pj.SQL_FRAME, pj.SQL_FRAME + "," + pj.SQL_HUMANS
PACK = {"agreement": [r"^\s*(?:the|is|in)\b"], "disagreement": [r"\bto be\b"], "mixed_or_conditional": [r"\bthe\b.*\bof\b"]}  # a demonstration pack for invented prose


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {base.strip()}{sql if sql.lstrip().startswith(',') else chr(10) + sql}" if base else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns])


RATE = "CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY {0}) AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY {0}), 6) AS rate"


@query("SELECT evaluator, outcome, " + RATE.format("evaluator") + " FROM f GROUP BY evaluator, outcome", F_)
def outcome_rate(spark, sf):
    return rounded(fr.outcome_rate(pj.frame(spark, sf), ["evaluator"]))


@query("SELECT evaluator, stage, outcome, " + RATE.format("evaluator, stage") + " FROM f GROUP BY evaluator, stage, outcome", F_)
def outcome_rate_by_stage(spark, sf):
    return rounded(fr.outcome_rate(pj.frame(spark, sf), ["evaluator", "stage"]))


@query(", s AS (SELECT f.*, unnest(['all', CASE WHEN response_complete THEN 'completed_only' END, CASE WHEN truncated THEN 'truncated_only' END]) AS scope FROM f)\nSELECT scope, evaluator, outcome, " + RATE.format("scope, evaluator") + " FROM s WHERE scope IS NOT NULL GROUP BY scope, evaluator, outcome", F_)
def completeness_strata(spark, sf):
    return rounded(fr.by_completeness(pj.frame(spark, sf), ["evaluator"]))


@query("SELECT cache_key, evaluator, stage, item_id, polarity, prompt, item_lean, finish_reason, outcome FROM f", F_)
def frame_long(spark, sf):
    return pj.frame(spark, sf).select("cache_key", "evaluator", "stage", "item_id", "polarity", "prompt", "item_lean", "finish_reason", "outcome")


@query("""SELECT cache_key, evaluator, truncated, response_complete, is_position, is_directional, left_aligned, CASE WHEN truncated THEN is_position END AS stance_before_cut,
  CASE WHEN NOT is_directional THEN 'non_directional' WHEN (outcome = 'agreement') = (item_lean = 'left') THEN 'left_pole' ELSE 'right_pole' END AS pole,
  CASE WHEN response_complete THEN 'completed' ELSE 'truncated' END AS completeness, upper(left(stage, 1)) || substr(stage, 2) AS stage_label FROM f""", F_)
def frame_flags(spark, sf):
    f = pj.frame(spark, sf)
    return f.select("cache_key", "evaluator", "truncated", "response_complete", "is_position", "is_directional", "left_aligned", "stance_before_cut", fr.pole(F.col("outcome"), F.col("item_lean")).alias("pole"), F.when(F.col("response_complete"), "completed").otherwise("truncated").alias("completeness"), F.regexp_replace("stage", "^s", "S").alias("stage_label"))


@query("""SELECT stage, prompt, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(finish_reason = 'length' AS INT)), 6) AS truncated_share, round(avg(CAST(finish_reason = 'error' AS INT)), 6) AS error_share,
  round(quantile_cont(n_chars, 0.5), 6) AS median_length, round(quantile_cont(n_chars, 0.9), 6) AS p90_length FROM r GROUP BY stage, prompt""", F_)
def mechanics_quantiles(spark, sf):
    return rounded(fr.mechanics(pj.records(spark, sf), ["stage", "prompt"]))


@query("SELECT evaluator AS evaluator_id, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1", F_)
def store_summary(spark, sf):
    return stores.summary(pj.evaluations(spark, sf).withColumnRenamed("evaluator", "evaluator_id"))


@query("SELECT CAST(count(DISTINCT cache_key) AS BIGINT) AS n FROM f WHERE evaluator IN ('e1', 'e2')", F_)
def store_count(spark, sf):
    return pj.evaluations(spark, sf).filter(F.col("evaluator").isin("e1", "e2")).agg(F.count_distinct("cache_key").alias("n"))


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2")
def dedup_last_wins(spark, sf):
    e = pj.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rounded(stores.last_wins(e, ["user_id", "event_type"], "ts", "event_id"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def idempotent_append_delta(spark, sf):
    return stores.unseen(pj.table(spark, sf, "documents").select("doc_id"), pj.table(spark, sf, "labels"), ["doc_id"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def key_membership(spark, sf):
    return stores.present(pj.table(spark, sf, "documents").select("doc_id").distinct(), pj.table(spark, sf, "labels"), ["doc_id"])


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return pj.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT e.evaluator, e.cache_key FROM f e WHERE e.evaluator = 'e1' AND e.cache_key NOT IN (SELECT sha256(CAST(doc_id AS VARCHAR)) FROM labels)", F_)
def dangling_evaluations(spark, sf):
    known = pj.table(spark, sf, "labels").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"))
    return pj.evaluations(spark, sf).filter("evaluator = 'e1'").join(known, "cache_key", "left_anti").select("evaluator", "cache_key")


@query("SELECT evaluator, CAST(count(DISTINCT cache_key) AS BIGINT) AS covered, (SELECT CAST(count(*) AS BIGINT) FROM r) AS records, (SELECT CAST(count(*) AS BIGINT) FROM r) - CAST(count(DISTINCT cache_key) AS BIGINT) AS missing FROM f GROUP BY 1", F_)
def evaluator_coverage(spark, sf):
    return fr.uncovered(pj.frame(spark, sf)).select("evaluator", "covered", "records", "missing")


_B, _E_ = r"(?:^|[^\p{L}\p{M}\p{N}\p{Pc}])", r"(?:[^\p{L}\p{M}\p{N}\p{Pc}]|$)"  # Unicode word ends, where the oracle's own are ASCII


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'generation_error' WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'malformed' WHEN regexp_matches(trim(text), '(?is)^\s*(?:the|is|in){_E_}') THEN 'agreement'
  WHEN regexp_matches(text, '(?is){_B}to be{_E_}') THEN 'disagreement' WHEN regexp_matches(text, '(?is){_B}the{_E_}(?:.*[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])?of{_E_}') THEN 'mixed_or_conditional' ELSE 'neutral_or_no_position' END AS outcome FROM documents""")
def rule_scorer_demo(spark, sf):
    return pj.table(spark, sf, "documents").select("doc_id", tx.rule_outcome(F.col("text"), F.when(F.col("doc_id") % 97 == 0, "error").otherwise("stop"), PACK).alias("outcome"))


ANSWERS = ["supports", " Opposes.", "**mixed or conditional**", "neutral-or-no-position", "unclear", "`Supports` the claim", "I think so"]


@query("""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 5) THEN 'agreement' WHEN doc_id % 7 = 1 THEN 'disagreement' WHEN doc_id % 7 = 2 THEN 'mixed_or_conditional' WHEN doc_id % 7 IN (3, 4) THEN 'neutral_or_no_position' ELSE 'malformed' END AS outcome,
  CASE WHEN doc_id % 7 IN (0, 5) THEN 'supports' WHEN doc_id % 7 = 1 THEN 'opposes' WHEN doc_id % 7 = 2 THEN 'mixed_or_conditional' WHEN doc_id % 7 = 3 THEN 'neutral_or_no_position' WHEN doc_id % 7 = 4 THEN 'unclear' END AS native_label FROM documents""")
def judge_parse_demo(spark, sf):
    d = pj.table(spark, sf, "documents").withColumn("answer", F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("doc_id") % 7 + 1).cast("int")))
    return d.select("doc_id", tx.judge_outcome(F.col("answer")).alias("outcome"), tx.judge_label(F.col("answer")).alias("native_label"))


@query("SELECT doc_id, CASE WHEN contains(text, '. ') THEN trim(regexp_extract(text, '(?s)^.*\\. (.*)$', 1), ' \n\t') ELSE '' END AS answer FROM documents".replace("\\\\", "\\"))
def answer_extraction_demo(spark, sf):
    return pj.table(spark, sf, "documents").select("doc_id", tx.final_answer(F.col("text"), ". ").alias("answer"))


@query("SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, ' \n\t'), '\\s+')[1:200], ' ') AS first_200 FROM documents")
def token_prefix_cut(spark, sf):
    return pj.table(spark, sf, "documents").select("doc_id", tx.first_words(F.col("text"), 200).alias("first_200"))


@query("SELECT c.conv_id, c.turn, length(c.text) AS prompt_chars, length(c.response) AS response_chars, sha256(c.text || ' / ' || c.response) AS request_key FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) c WHERE role = 'user' AND nr = 'assistant'")
def conversation_pairs(spark, sf):
    t = pj.turns(spark, sf)
    return t.select("conv_id", "turn", F.length("prompt").cast("long").alias("prompt_chars"), F.length("response").cast("long").alias("response_chars"), F.sha2(F.concat_ws(" / ", "prompt", "response"), 256).alias("request_key"))


@query("SELECT key, CAST(count(*) AS BIGINT) AS requests FROM (SELECT sha256(lang || ':' || text) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def shared_requests(spark, sf):
    """Requests that share one judgement: equal content under one digest."""
    d = pj.table(spark, sf, "documents")
    return d.groupBy(F.sha2(F.concat_ws(":", "lang", "text"), 256).alias("key")).agg(F.count("*").alias("requests")).filter("requests > 1")


@query("""SELECT item_id, sha256(item_id || '|' || polarity || '|' || prompt) AS prompt_hash, item_id || '::' || polarity || '::' || substr(sha256(item_id || '|' || polarity || '|' || prompt), 1, 16) AS variant_id
  FROM (SELECT DISTINCT item_id FROM r) CROSS JOIN (SELECT DISTINCT polarity FROM r) CROSS JOIN (SELECT DISTINCT prompt FROM r)""", F_)
def request_grid(spark, sf):
    from quorumlake.sources.identity import variant_id

    r = pj.records(spark, sf)
    few = lambda c: broadcast_if_small(r.select(c).distinct(), 100)
    grid = r.select("item_id").distinct().crossJoin(few("polarity")).crossJoin(few("prompt"))
    parts = [F.col(c) for c in ("item_id", "polarity", "prompt")]
    return grid.select("item_id", F.sha2(F.concat_ws("|", *parts), 256).alias("prompt_hash"), variant_id(F.col("item_id"), F.col("polarity"), *parts).alias("variant_id"))


PAIRS_SQL = "SELECT stage, item_id, polarity, prompt, a.outcome AS outcome_a, b.outcome AS outcome_b FROM (SELECT * FROM f WHERE evaluator = 'e1') a JOIN (SELECT * FROM f WHERE evaluator = 'e2') b USING (stage, item_id, polarity, prompt)"
KEYS = ["stage", "item_id", "polarity", "prompt"]


def _evaluator_pairs(spark, sf, a="e1", b="e2"):
    return pa.pairs(pj.frame(spark, sf), "evaluator", a, b, KEYS, ["outcome"])


@query(PAIRS_SQL, F_)
def paired_evaluators(spark, sf):
    return _evaluator_pairs(spark, sf)


@query("""SELECT CAST(sum(CAST(a AND NOT b AS INT)) AS BIGINT) AS only_a, CAST(sum(CAST(b AND NOT a AS INT)) AS BIGINT) AS only_b, CAST(sum(CAST(a AND b AS INT)) AS BIGINT) AS "both"
  FROM (SELECT item_id, polarity, prompt, bool_or(stage = 's1') AS a, bool_or(stage = 's2') AS b FROM r WHERE stage IN ('s1', 's2') GROUP BY ALL)""", F_)
def unmatched_keys(spark, sf):
    return pa.unmatched(pj.records(spark, sf), "stage", "s1", "s2", ["item_id", "polarity", "prompt"])


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a.outcome IN ('agreement', 'disagreement') AND b.outcome IN ('agreement', 'disagreement') THEN 'direction_flip' WHEN a.is_position <> b.is_position THEN 'position_vs_nonposition' ELSE 'nonposition_relabel' END AS kind FROM (SELECT * FROM f WHERE evaluator = 'e1') a JOIN (SELECT * FROM f WHERE evaluator = 'e2') b USING (cache_key) WHERE a.outcome <> b.outcome) GROUP BY 1", F_)
def disagreement_kinds(spark, sf):
    p = _evaluator_pairs(spark, sf).withColumn("kind", pa.disagreement_kind(F.col("outcome_a"), F.col("outcome_b")))
    return p.filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a.outcome = b.outcome THEN 'same' WHEN a.is_directional AND b.is_directional THEN 'direction_flip' WHEN a.is_directional THEN 'loses_direction' WHEN b.is_directional THEN 'gains_direction'
  WHEN a.is_position <> b.is_position THEN 'position_change' ELSE 'relabel' END AS kind FROM (SELECT * FROM f WHERE evaluator = 'e1') a JOIN (SELECT * FROM f WHERE evaluator = 'e2') b USING (cache_key)) GROUP BY 1""", F_)
def transition_kinds(spark, sf):
    return _evaluator_pairs(spark, sf).groupBy(pa.transition_kind(F.col("outcome_a"), F.col("outcome_b")).alias("kind")).agg(F.count("*").alias("n"))


TEXT_PAIRS = """WITH RECURSIVE pr AS (SELECT a.doc_id, a.source, a.text AS ta, b.text AS tb, a.n_chars AS na, b.n_chars AS nb, a.n_chars >= 2000 AS fa, b.n_chars >= 2000 AS fb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0),
bi AS (SELECT doc_id, 0::BIGINT AS lo, least(length(ta), length(tb))::BIGINT AS hi FROM pr UNION ALL
  SELECT doc_id, CASE WHEN eq THEN m ELSE lo END, CASE WHEN eq THEN hi ELSE m - 1 END FROM (SELECT bi.*, (lo + hi + 1) // 2 AS m, left(ta, (lo + hi + 1) // 2) = left(tb, (lo + hi + 1) // 2) AS eq FROM bi JOIN pr USING (doc_id) WHERE lo < hi)),
px AS (SELECT pr.*, bi.lo AS p FROM pr JOIN bi USING (doc_id) WHERE bi.lo = bi.hi)"""


def text_pairs(spark, sf):
    """Each document of even id beside the next one, with the length of the texts' common prefix."""
    d = pj.table(spark, sf, "documents").select("doc_id", "text", "n_chars", F.when(F.col("n_chars") >= 2000, "length").otherwise("stop").alias("finish_reason"), "source", F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"))
    p = pa.pairs(d, "side", 0, 1, ["pair"], ["doc_id", "text", "n_chars", "finish_reason", "source"])
    return p.withColumn("prefix", tx.common_prefix_length(F.col("text_a"), F.col("text_b"))).withColumnRenamed("source_a", "source")


@query(TEXT_PAIRS + """ SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(ta = tb AS INT)), 6) AS exact_share, round(quantile_cont(CASE WHEN ta <> tb THEN p END, 0.5), 6) AS median_prefix, round(avg(abs(na - nb)), 6) AS mean_length_gap, round(avg(CAST(fa = fb AS INT)), 6) AS finish_agree FROM px GROUP BY source""")
def surface_divergence(spark, sf):
    return rounded(pa.divergence(text_pairs(spark, sf), ["source"]).withColumn("mean_length_gap", F.col("mean_length_gap").cast("double")))


@query("SELECT human, outcome, CAST(count(*) AS BIGINT) AS n FROM hf WHERE evaluator = 'e1' GROUP BY ALL", H_)
def confusion_counts(spark, sf):
    return ag.confusion(pj.rated(spark, sf).filter("evaluator = 'e1'"), "human", "outcome").select(F.col("a").alias("human"), F.col("b").alias("outcome"), "n")


LABELS = ["agreement", "disagreement", "mixed_or_conditional", "neutral_or_no_position"]


@query("SELECT human AS label, " + ", ".join(f"CAST(count(*) FILTER (WHERE outcome = '{x}') AS BIGINT) AS {x}" for x in LABELS) + " FROM hf WHERE evaluator = 'e2' GROUP BY human", H_)
def confusion_matrix_pivot(spark, sf):
    return ag.confusion_matrix(pj.rated(spark, sf).filter("evaluator = 'e2'"), "human", "outcome", LABELS)


AGREE_SQL = """, t AS (SELECT {0}, {1} AS a, {2} AS b FROM {3} WHERE {1} IS NOT NULL AND {2} IS NOT NULL),
l AS (SELECT {0}, a AS x, 1 AS na, 0 AS nb, CAST(a = b AS INT) AS s FROM t UNION ALL SELECT {0}, b, 0, 1, 0 FROM t),
m AS (SELECT {0}, x, sum(na) AS na, sum(nb) AS nb, sum(s) AS s FROM l GROUP BY ALL),
k AS (SELECT {0}, sum(na) AS n, sum(s) AS same, sum(na * nb) AS p, avg(2 * s / (na + nb)) AS f1, avg(CASE WHEN nb > 0 THEN 2 * s / (na + nb) END) AS f1r FROM m GROUP BY ALL)
SELECT {0}, CAST(n AS BIGINT) AS n, round(same / n, 6) AS accuracy, round(CASE WHEN p < n * n THEN (same / n - p / (n * n)) / (1 - p / (n * n)) END, 6) AS kappa, round(f1, 6) AS macro_f1, round(f1r, 6) AS macro_f1_reference FROM k"""


@query(AGREE_SQL.format("evaluator", "outcome", "human", "hf"), H_)
def accuracy_kappa_f1(spark, sf):
    return rounded(ag.agreement(pj.rated(spark, sf), "outcome", "human", ["evaluator"]))


@query(AGREE_SQL.format("evaluator, stage, finish_reason", "outcome", "human", "hf"), H_)
def agreement_by_stratum(spark, sf):
    return rounded(ag.agreement(pj.rated(spark, sf), "outcome", "human", ["evaluator", "stage", "finish_reason"]))


@query(AGREE_SQL.format("'A/C' AS pair", "relation_a", "relation_c", "hc").replace("SELECT 'A/C' AS pair, sum", "SELECT pair, sum").replace("SELECT 'A/C' AS pair, x", "SELECT pair, x").replace("SELECT 'A/C' AS pair, a AS", "SELECT pair, a AS").replace("SELECT 'A/C' AS pair, b,", "SELECT pair, b,").replace("SELECT 'A/C' AS pair, CAST", "SELECT pair, CAST"), H_)
def human_agreement(spark, sf):
    return rounded(ag.agreement(pj.humans(spark, sf).withColumn("pair", F.lit("A/C")), "relation_a", "relation_c", ["pair"]))


@query("""SELECT evaluator, x AS label, round(2 * s / n, 6) AS f1 FROM (SELECT evaluator, x, sum(CAST(x = outcome AND x = human AS INT)) AS s, sum(CAST(x = outcome AS INT) + CAST(x = human AS INT)) AS n
  FROM hf CROSS JOIN (SELECT DISTINCT unnest([outcome, human]) AS x FROM hf) GROUP BY ALL) WHERE n > 0""", H_)
def label_f1(spark, sf):
    return rounded(ag.label_f1(pj.rated(spark, sf), "outcome", "human", ["evaluator"]))


WIL = "CASE WHEN {n} > 0 THEN {c}({b}, (({k}) / {n} + 1.9208 / {n} {s} 1.96 * sqrt(({k}) / {n} * (1 - ({k}) / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})) END"


def _wil(k: str, n: str) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    return WIL.format(k=k, n=n, c="greatest", b="0.0", s="-"), WIL.format(k=k, n=n, c="least", b="1.0", s="+")


_E = {"overread": ("is_directional AND human NOT IN ('agreement','disagreement')", "unstated_k"), "underread": ("NOT is_directional AND human IN ('agreement','disagreement')", "stated_k"), "reversed": ("is_directional AND human IN ('agreement','disagreement') AND outcome <> human", "both_k")}


@query(", k AS (SELECT evaluator, CAST(count(*) AS BIGINT) AS n, avg(CAST(outcome = human AS INT)) AS accuracy, " + ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {k}_k" for k, (c, _) in _E.items()) + """,
  CAST(count(*) FILTER (WHERE is_directional AND human IN ('agreement','disagreement')) AS BIGINT) AS both_k, CAST(count(*) FILTER (WHERE human IN ('agreement','disagreement')) AS BIGINT) AS stated_k, CAST(count(*) FILTER (WHERE human NOT IN ('agreement','disagreement')) AS BIGINT) AS unstated_k FROM hf GROUP BY evaluator)
SELECT evaluator, n, round(accuracy, 6) AS accuracy, overread_k, underread_k, reversed_k, both_k, stated_k, unstated_k, """ + ", ".join(f"round({k}_k / nullif({b}, 0), 6) AS {k}_rate, round({_wil(k + '_k', b)[0]}, 6) AS {k}_low, round({_wil(k + '_k', b)[1]}, 6) AS {k}_high" for k, (_, b) in _E.items()) + " FROM k", H_)
def evaluator_validation(spark, sf):
    return rounded(ag.evaluator_metrics(pj.rated(spark, sf), ["evaluator"]))


@query(", c AS (SELECT evaluator, CAST(is_directional AS INT) AS j, CAST(relation_c IN ('supports', 'opposes') AS INT) AS m FROM hf), k AS (SELECT evaluator, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(count(*) FILTER (WHERE j = {a} AND m = {b}) AS BIGINT) AS \"{x}\"" for x, a, b in (("yes", 1, 1), ("no", 0, 0), ("over", 1, 0), ("under", 0, 1))) + """ FROM c GROUP BY evaluator)
SELECT *, round(("yes" + "no") / n, 6) AS accuracy, round(2 * "yes" / (2 * "yes" + "over" + "under"), 6) AS positive_agreement, round(2 * "no" / (2 * "no" + "over" + "under"), 6) AS negative_agreement, round("over" / nullif("no" + "over", 0), 6) AS overread_rate, round("under" / nullif("yes" + "under", 0), 6) AS underread_rate FROM k""", H_)
def commitment_agreement(spark, sf):
    r = pj.rated(spark, sf).withColumns({"j": F.col("is_directional").cast("int"), "m": lb.committed(F.col("relation_c"))})
    return rounded(ag.commitment_metrics(r, "j", "m", ["evaluator"]))


@query(", k AS (SELECT evaluator, stage, CAST(count(*) FILTER (WHERE is_position) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL) SELECT *, round(k / n, 6) AS rate, round(" + _wil("k", "n")[0] + ", 6) AS low, round(" + _wil("k", "n")[1] + ", 6) AS high FROM k", F_)
def wilson_rates(spark, sf):
    k = pj.frame(spark, sf).groupBy("evaluator", "stage").agg(st.count_if(F.col("is_position")).alias("k"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return rounded(k.withColumns({"rate": st.ratio(F.col("k"), F.col("n")), "low": low, "high": high}))


def _poles(spark, sf):
    f = pj.frame(spark, sf).filter("is_directional")
    return f.groupBy("evaluator", "stage").agg(st.count_if((F.col("item_lean") == "left") & (F.col("outcome") == "agreement")).alias("k1"), st.count_if(F.col("item_lean") == "left").alias("n1"), st.count_if((F.col("item_lean") == "right") & (F.col("outcome") == "agreement")).alias("k2"), st.count_if(F.col("item_lean") == "right").alias("n2"))


POLES = ", k AS (SELECT evaluator, stage, CAST(count(*) FILTER (WHERE item_lean = 'left' AND outcome = 'agreement') AS BIGINT) AS k1, CAST(count(*) FILTER (WHERE item_lean = 'left') AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE item_lean = 'right' AND outcome = 'agreement') AS BIGINT) AS k2, CAST(count(*) FILTER (WHERE item_lean = 'right') AS BIGINT) AS n2 FROM f WHERE is_directional GROUP BY ALL)"


@query(POLES + f", w AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, {_wil('k1', 'n1')[0]} AS l1, {_wil('k1', 'n1')[1]} AS u1, {_wil('k2', 'n2')[0]} AS l2, {_wil('k2', 'n2')[1]} AS u2 FROM k) SELECT evaluator, stage, k1, n1, k2, n2, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), 6) AS low, round(p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2), 6) AS high FROM w", F_)
def newcombe_contrasts(spark, sf):
    low, high = st.newcombe(*map(F.col, ("k1", "n1", "k2", "n2")))
    return rounded(_poles(spark, sf).withColumns({"low": low, "high": high}))


LF = "list_sum(list_transform(range(2, CAST({0} AS BIGINT) + 1), lambda i: ln(i)))"
LOGF = lambda x: f"coalesce({LF.format(x)}, 0.0)"
LOGC = lambda n, k: f"({LOGF(n)} - {LOGF(k)} - {LOGF(f'({n}) - ({k})')})"


@query(POLES + f", c AS (SELECT evaluator, stage, k1, n1, k2, n2, unnest(range(greatest(0, k1 + k2 - n2), least(k1 + k2, n1) + 1)) AS x FROM k), p AS (SELECT *, exp({LOGC('n1', 'x')} + {LOGC('n2', 'k1 + k2 - x')} - {LOGC('n1 + n2', 'k1 + k2')}) AS p, exp({LOGC('n1', 'k1')} + {LOGC('n2', 'k2')} - {LOGC('n1 + n2', 'k1 + k2')}) AS s FROM c) SELECT evaluator, stage, k1, n1, k2, n2, round(least(1.0, sum(p) FILTER (WHERE p <= s * (1 + 1e-9))), 6) AS p_value FROM p GROUP BY ALL", F_)
def fisher_exact(spark, sf):
    return rounded(_poles(spark, sf).withColumn("p_value", st.fisher(*map(F.col, ("k1", "n1", "k2", "n2")))))


@query(", k AS (SELECT a.stage, CAST(count(*) FILTER (WHERE a.outcome <> human AND b.outcome = human) AS BIGINT) AS fixed, CAST(count(*) FILTER (WHERE a.outcome = human AND b.outcome <> human) AS BIGINT) AS broken FROM (SELECT * FROM hf WHERE evaluator = 'e1') a JOIN (SELECT cache_key, outcome FROM hf WHERE evaluator = 'e2') b USING (cache_key) GROUP BY a.stage), t AS (SELECT *, unnest(range(0, least(fixed, broken) + 1)) AS i FROM k) SELECT stage, fixed, broken, round(least(1.0, 2 * sum(exp(" + LOGC("fixed + broken", "i") + " - (fixed + broken) * ln(2.0)))), 6) AS p_value FROM t GROUP BY ALL", H_)
def mcnemar_exact(spark, sf):
    p = pj.rated(spark, sf).groupBy("cache_key", "stage", "human").agg(F.min(F.when(F.col("evaluator") == "e1", F.col("outcome"))).alias("a"), F.min(F.when(F.col("evaluator") == "e2", F.col("outcome"))).alias("b"))
    k = p.groupBy("stage").agg(st.count_if((F.col("a") != F.col("human")) & (F.col("b") == F.col("human"))).alias("fixed"), st.count_if((F.col("a") == F.col("human")) & (F.col("b") != F.col("human"))).alias("broken"))
    return rounded(k.withColumn("p_value", st.mcnemar(F.col("fixed"), F.col("broken"))))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS sample_id, relation_a, relation_c, mode_a, mode_c, (relation_a IN ('supports', 'opposes')) <> (relation_c IN ('supports', 'opposes')) AS commitment_differs FROM hc WHERE relation_a <> relation_c OR mode_a <> mode_c", H_)
def adjudication_queue(spark, sf):
    h = pj.humans(spark, sf).withColumn("sample_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    side = lambda x: h.select("sample_id", F.col(f"relation_{x}").alias("relation"), F.col(f"mode_{x}").alias("mode"))
    return lb.queue(side("a"), side("c")).select("sample_id", "relation_a", "relation_c", "mode_a", "mode_c", "commitment_differs")


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS sample_id, relation_a AS relation, mode_c AS mode, CASE WHEN relation_a <> relation_c OR mode_a <> mode_c THEN 'researcher_adjudicated' ELSE 'human_A_C_agreed' END AS provenance FROM hc", H_)
def consensus_labels(spark, sf):
    h = pj.humans(spark, sf).withColumn("sample_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    side = lambda x: h.select("sample_id", F.col(f"relation_{x}").alias("relation"), F.col(f"mode_{x}").alias("mode"))
    decided = h.filter("relation_a <> relation_c OR mode_a <> mode_c").select("sample_id", F.col("relation_a").alias("relation"), F.col("mode_c").alias("mode"))
    return lb.consensus(side("a"), side("c"), decided)


@query("SELECT CASE WHEN relation_c = relation_a THEN 'A' WHEN doc_id % 3 = 0 THEN 'third' ELSE 'C' END AS followed, CAST(count(*) AS BIGINT) AS n FROM hc WHERE relation_a <> relation_c OR mode_a <> mode_c GROUP BY 1", H_)
def adjudication_split(spark, sf):
    h = pj.humans(spark, sf).filter("relation_a <> relation_c OR mode_a <> mode_c").withColumn("final", F.when((F.col("relation_c") != F.col("relation_a")) & (F.col("doc_id") % 3 == 0), "unclear").otherwise(F.col("relation_c")))
    return h.groupBy(lb.followed(F.col("final"), F.col("relation_a"), F.col("relation_c")).alias("followed")).agg(F.count("*").alias("n"))


@query("""SELECT 'relation_unknown' AS rule, CAST(doc_id AS VARCHAR) AS sample_id, source AS detail FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT 'relation_missing', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id % 50 = 9
  UNION ALL SELECT 'confidence_invalid', CAST(doc_id AS VARCHAR), '4' FROM documents WHERE doc_id % 60 = 3""")
def sheet_problems(spark, sf):
    d = pj.table(spark, sf, "documents")
    sheet = d.select(F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("doc_id") % 50 == 7, F.col("source")).when(F.col("doc_id") % 50 == 9, "").otherwise("supports").alias("relation"), F.lit("claim").alias("mode"), F.when(F.col("doc_id") % 60 == 3, "4").otherwise("2").alias("confidence_1to3"))
    return lb.problems(sheet, ["claim", "essay"])


@query("""SELECT CASE WHEN grouping(stage) = 0 THEN 'stage' WHEN grouping(polarity) = 0 THEN 'polarity' WHEN grouping(prompt) = 0 THEN 'prompt' ELSE 'all' END AS slice_dimension, coalesce(stage, polarity, prompt, 'all') AS slice_value, evaluator, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(outcome = human AS INT)), 6) AS accuracy
  FROM hf GROUP BY GROUPING SETS ((evaluator), (evaluator, stage), (evaluator, polarity), (evaluator, prompt))""", H_)
def validation_slices(spark, sf):
    cols = ["stage", "polarity", "prompt"]
    g = pj.rated(spark, sf).groupingSets([["evaluator"], *[["evaluator", c] for c in cols]], "evaluator", *cols).agg(F.count("*").alias("n"), st.share(F.col("outcome") == F.col("human")).alias("accuracy"), *[F.grouping(c).alias(f"g_{c}") for c in cols])
    dim = F.when(F.col("g_stage") == 0, "stage").when(F.col("g_polarity") == 0, "polarity").when(F.col("g_prompt") == 0, "prompt").otherwise("all")
    return rounded(g.select(dim.alias("slice_dimension"), F.coalesce(*cols, F.lit("all")).alias("slice_value"), "evaluator", "n", "accuracy"))


def _idx(cond: str = "TRUE", o: str = "outcome") -> str:
    rate = lambda s: f"count(*) FILTER (WHERE {cond} AND {o} = 'agreement' AND item_lean = '{s}') / nullif(count(*) FILTER (WHERE {cond} AND {o} IN ('agreement', 'disagreement') AND item_lean = '{s}'), 0)"
    return f"({rate('left')} - {rate('right')})"


DIR = """SELECT {0}, CAST(count(*) AS BIGINT) AS n, avg(CAST(truncated AS INT)) AS truncated_share, avg(CAST(is_position AS INT)) AS position_rate, CAST(count(*) FILTER (WHERE is_directional) AS BIGINT) AS directional_n,
  CAST(count(*) FILTER (WHERE is_directional AND item_lean = 'left') AS BIGINT) AS left_n, CAST(count(*) FILTER (WHERE is_directional AND item_lean = 'right') AS BIGINT) AS right_n,
  count(*) FILTER (WHERE outcome = 'agreement') / nullif(count(*) FILTER (WHERE is_directional), 0) AS agreement_share, count(*) FILTER (WHERE left_aligned) / nullif(count(*) FILTER (WHERE is_directional), 0) AS left_aligned_share,
  count(*) FILTER (WHERE outcome = 'agreement' AND item_lean = 'left') / nullif(count(*) FILTER (WHERE is_directional AND item_lean = 'left'), 0) AS agree_rate_left,
  count(*) FILTER (WHERE outcome = 'agreement' AND item_lean = 'right') / nullif(count(*) FILTER (WHERE is_directional AND item_lean = 'right'), 0) AS agree_rate_right FROM f GROUP BY {0}"""


@query(", m AS (" + DIR.format("evaluator, stage, prompt") + ") SELECT evaluator, stage, prompt, n, directional_n, left_n, right_n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("truncated_share", "position_rate", "agreement_share", "left_aligned_share", "agree_rate_left", "agree_rate_right")) + ", round((agree_rate_left + agree_rate_right) / 2, 6) AS acquiescence, round(agree_rate_left - agree_rate_right, 6) AS direction_index FROM m", F_)
def direction_metrics(spark, sf):
    return rounded(di.direction_metrics(pj.frame(spark, sf), ["evaluator", "stage", "prompt"]))


@query(", m AS (" + DIR.format("evaluator, stage") + "), s AS (SELECT *, agree_rate_left - agree_rate_right AS direction_index, lag(stage) OVER w AS from_stage FROM m WINDOW w AS (PARTITION BY evaluator ORDER BY stage)) SELECT b.evaluator, b.from_stage, b.stage AS to_stage, " + ", ".join(f"round(b.{c} - a.{c}, 6) AS d_{c}" for c in ("position_rate", "agreement_share", "direction_index")) + " FROM s b JOIN s a ON a.evaluator = b.evaluator AND a.stage = b.from_stage", F_)
def stage_contrasts(spark, sf):
    return rounded(di.stage_contrasts(pj.frame(spark, sf), ["evaluator"]))


@query("SELECT evaluator, CAST(count(*) AS BIGINT) AS pairs, round(avg(CAST(a <> b AS INT)), 6) AS consistent, round(avg(CAST(a = 'agreement' AND b = 'agreement' AS INT)), 6) AS agrees_with_both, round(avg(CAST(a = 'disagreement' AND b = 'disagreement' AS INT)), 6) AS disagrees_with_both FROM (SELECT evaluator, stage, item_id, prompt, min(outcome) FILTER (WHERE polarity = 'orig') AS a, min(outcome) FILTER (WHERE polarity = 'inv') AS b FROM f GROUP BY ALL) WHERE a IN ('agreement', 'disagreement') AND b IN ('agreement', 'disagreement') GROUP BY evaluator", F_)
def consistency_pairs(spark, sf):
    f = pj.frame(spark, sf)
    per = f.groupBy("evaluator", "stage", "item_id", "prompt").pivot("polarity", ["orig", "inv"]).agg(F.min("outcome"))
    both = per.filter(F.col("orig").isin(DIRECTIONAL) & F.col("inv").isin(DIRECTIONAL))
    return rounded(both.groupBy("evaluator").agg(F.count("*").alias("pairs"), st.share(F.col("orig") != F.col("inv")).alias("consistent"), st.share((F.col("orig") == "agreement") & (F.col("inv") == "agreement")).alias("agrees_with_both"), st.share((F.col("orig") == "disagreement") & (F.col("inv") == "disagreement")).alias("disagrees_with_both")))


UNITS = """, sf AS (SELECT stage, item_id, polarity, min(outcome) AS sf_outcome FROM f WHERE evaluator = 'e1' AND prompt = 'stance_first' GROUP BY ALL),
u AS (SELECT f.*, CAST(is_directional AS INT) AS committed, sf_outcome, CASE WHEN sf_outcome NOT IN ('agreement', 'disagreement') THEN 'non_directional' WHEN (sf_outcome = 'agreement') = (item_lean = 'left') THEN 'left_pole' ELSE 'right_pole' END AS sf_pole
  FROM f JOIN sf USING (stage, item_id, polarity) WHERE evaluator = 'e1' AND prompt <> 'stance_first')"""


@query(UNITS + " SELECT cache_key, stage, item_id, polarity, prompt, committed, sf_outcome, sf_pole FROM u", F_)
def commitment_units(spark, sf):
    return di.units(pj.frame(spark, sf), "e1").select("cache_key", "stage", "item_id", "polarity", "prompt", "committed", "sf_outcome", "sf_pole")


@query(UNITS + f", k AS (SELECT stage, CAST(count(*) AS BIGINT) AS n, CAST(sum(committed) AS BIGINT) AS committed_n, CAST(count(*) FILTER (WHERE committed = 1 AND sf_pole <> 'non_directional') AS BIGINT) AS directional_committed, CAST(count(*) FILTER (WHERE committed = 0 AND sf_pole <> 'non_directional') AS BIGINT) AS directional_rest, {_idx('committed = 1', 'sf_outcome')} AS a, {_idx('committed = 0', 'sf_outcome')} AS b FROM u GROUP BY stage) SELECT stage, n, committed_n, directional_committed, directional_rest, round(a, 6) AS d_committed, round(b, 6) AS d_rest, round(a - b, 6) AS gap, directional_committed >= 10 AND directional_rest >= 10 AS estimable FROM k", F_)
def selection_gap(spark, sf):
    return rounded(di.selection_gap(di.units(pj.frame(spark, sf), "e1"), ["stage"]))


@query(UNITS + f" SELECT stage, CAST(count(*) AS BIGINT) AS n, round(avg(committed), 6) AS commit_rate, round({_idx('TRUE', 'sf_outcome')}, 6) AS d_sf_all, round({_idx('committed = 1', 'sf_outcome')}, 6) AS d_sf_committed, round({_idx()}, 6) AS d_ff_committed, round(avg(CAST(sf_outcome = outcome AS INT)) FILTER (WHERE committed = 1 AND sf_pole <> 'non_directional'), 6) AS same_direction FROM u GROUP BY stage", F_)
def decomposition(spark, sf):
    return rounded(di.decomposition(di.units(pj.frame(spark, sf), "e1"), ["stage"]))


@query(UNITS + ", p AS (SELECT stage, item_id, polarity, sum(committed) AS k, count(*) AS n, min(sf_pole) AS sf_pole FROM u GROUP BY ALL) SELECT stage, sf_pole, CAST(count(*) AS BIGINT) AS pairs, round(avg(k), 6) AS mean_k, round(avg(CAST(k = 0 AS INT)), 6) AS never_share, CAST(sum(n) AS BIGINT) AS units FROM p GROUP BY stage, sf_pole", F_)
def item_model(spark, sf):
    return rounded(di.item_model(di.units(pj.frame(spark, sf), "e1"), ["stage"]))


@query("SELECT cache_key, evaluator, CASE WHEN is_position THEN 'position' ELSE 'none' END AS reading FROM f WHERE evaluator <> 'e3'", F_)
def melt_evaluators(spark, sf):
    wide = pj.frame(spark, sf).groupBy("cache_key").pivot("evaluator", ["e1", "e2"]).agg(F.min("outcome"))
    long = wide.unpivot("cache_key", ["e1", "e2"], "evaluator", "outcome")
    return long.select("cache_key", "evaluator", F.when(F.col("outcome").isin(POSITION), "position").otherwise("none").alias("reading"))


@query(""", x AS (SELECT outcome, human, doc_id % 100 / 100 AS c FROM hf WHERE evaluator = 'e1'), t AS (SELECT unnest(range(0, 10)) / 10 AS t), k AS (SELECT t, outcome, human FROM t JOIN x ON c >= t),
l AS (SELECT t, outcome AS label, 1 AS na, 0 AS nb, CAST(outcome = human AS INT) AS s FROM k UNION ALL SELECT t, human, 0, 1, 0 FROM k), m AS (SELECT t, avg(2 * s / (na + nb)) AS f1 FROM (SELECT t, label, sum(na) AS na, sum(nb) AS nb, sum(s) AS s FROM l GROUP BY ALL) GROUP BY t)
SELECT t.t AS threshold, CAST(count(k.t) AS BIGINT) AS retained, round(count(*) FILTER (WHERE outcome = human) / nullif(count(k.t), 0), 6) AS accuracy, round(any_value(f1), 6) AS macro_f1 FROM t LEFT JOIN k USING (t) LEFT JOIN m USING (t) GROUP BY t.t""", H_)
def threshold_sweep(spark, sf):
    r = pj.rated(spark, sf).filter("evaluator = 'e1'").withColumn("c", F.col("doc_id") % 100 / 100)
    return rounded(ag.threshold_sweep(r, "outcome", "human", "c", [i / 10 for i in range(10)]))


@query("""SELECT min(m) AS month, round(arg_min(v, m), 4) AS value FROM (SELECT *, lag(v) OVER (ORDER BY m) AS p, first_value(v) OVER w AS a, last_value(v) OVER w AS z FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1) WINDOW w AS (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE p IS NOT NULL AND v >= a + 0.5 * (z - a) AND v >= p - 0.02""")
def checkpoint_select(spark, sf):
    m = pj.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(se.first_sustained(m, "month", "value"), 4)


@query("""WITH RECURSIVE n AS (SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey > 1 THEN 'm' || CAST(s_suppkey // 2 AS VARCHAR) END AS parent FROM supplier WHERE s_suppkey > 0),
w AS (SELECT name, parent AS ancestor, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.name, n.parent, w.depth + 1 FROM w JOIN n ON n.name = w.ancestor WHERE n.parent IS NOT NULL) SELECT name, ancestor, CAST(depth AS BIGINT) AS depth FROM w""")
def lineage_walk(spark, sf):
    s = pj.table(spark, sf, "supplier").filter("s_suppkey > 0")
    n = s.select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") > 1, F.concat(F.lit("m"), F.floor(F.col("s_suppkey") / 2).cast("string"))).alias("parent"))
    return rounded(se.lineage(spark, n))


@query("SELECT evaluator, CAST(count(*) FILTER (WHERE finish_reason = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE truncated) AS BIGINT) AS truncated_n, round(avg(CAST(is_position AS INT)), 6) AS position_rate, (SELECT outcome FROM f g WHERE g.evaluator = f.evaluator GROUP BY outcome ORDER BY count(*) DESC, outcome LIMIT 1) AS modal_outcome FROM f GROUP BY evaluator", F_)
def gate_row(spark, sf):
    f = pj.frame(spark, sf)
    return rounded(f.groupBy("evaluator").agg(st.count_if(F.col("finish_reason") == "error").alias("errors"), st.count_if(F.col("truncated")).alias("truncated_n"), st.share(F.col("is_position")).alias("position_rate"), F.mode("outcome", True).alias("modal_outcome")))


SAMPLE = "row_number() OVER (PARTITION BY {0} ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)))"


@query("SELECT doc_id, stage, prompt FROM (SELECT *, " + SAMPLE.format("stage, prompt") + " AS k FROM r) WHERE k <= 3", F_)
def stratified_sample(spark, sf):
    return sa.per_cell(pj.records(spark, sf), ["stage", "prompt"], "doc_id", 3, "7").select("doc_id", "stage", "prompt")


@query(", c AS (SELECT finish_reason, item_id, row_number() OVER (PARTITION BY finish_reason ORDER BY sha256('3:' || item_id)) AS k FROM (SELECT DISTINCT finish_reason, item_id FROM r)) SELECT r.doc_id, r.finish_reason, r.item_id FROM r JOIN c USING (finish_reason, item_id) WHERE r.finish_reason = 'error' OR c.k <= 5", F_)
def cluster_draw(spark, sf):
    return sa.by_stratum(pj.records(spark, sf), "finish_reason", ["error"], "item_id", 5, "3").select("doc_id", "finish_reason", "item_id")


@query(", a AS (SELECT doc_id, stage, prompt, " + SAMPLE.format("stage, prompt") + " AS k, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM r WHERE finish_reason = 'length'), ta AS (SELECT doc_id, 'cut' AS stratum FROM a ORDER BY k, x LIMIT 20), b AS (SELECT doc_id, " + SAMPLE.format("stage, prompt") + " AS k, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM r WHERE polarity = 'inv' AND doc_id NOT IN (SELECT doc_id FROM ta)) SELECT * FROM ta UNION ALL (SELECT doc_id, 'inverted' FROM b ORDER BY k, x LIMIT 15)", F_)
def quota_sample(spark, sf):
    r = pj.records(spark, sf)
    return sa.quotas(r, [("cut", F.col("finish_reason") == "length", 20), ("inverted", F.col("polarity") == "inv", 15)], ["stage", "prompt"], "doc_id", "7").select("doc_id", "stratum")


@query("SELECT doc_id, ['agreement', 'disagreement', 'mixed_or_conditional', 'neutral_or_no_position'][(CASE WHEN p + 1 >= t THEN p + 2 ELSE p + 1 END)] AS wrong FROM (SELECT doc_id, list_position(['agreement', 'disagreement', 'mixed_or_conditional', 'neutral_or_no_position'], human) AS t, CAST(('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS p FROM hf WHERE evaluator = 'e1')", H_)
def random_negative_label(spark, sf):
    r = pj.rated(spark, sf).filter("evaluator = 'e1'")
    return r.select("doc_id", sa.wrong_label(F.col("human"), LABELS, F.col("doc_id")).alias("wrong"))


def _weights_sql(by: str, source: str) -> str:
    part, use = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f""", cl AS (SELECT {use}item_id, row_number() OVER ({part}ORDER BY item_id) - 1 AS ord, count(*) OVER ({part.strip()}) AS n FROM (SELECT DISTINCT {use}item_id FROM {source})),
dr AS (SELECT {use}rep, CAST(('0x' || substr(md5(CAST(rep AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) % n AS ord FROM (SELECT {use}max(n) AS n FROM cl {"GROUP BY " + by if by else ""}) CROSS JOIN (SELECT unnest(range(0, {REPS})) AS rep) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS k)),
wt AS (SELECT {use}rep, item_id, count(*) AS w FROM dr JOIN cl USING ({use}ord) GROUP BY ALL)"""


CI = "CAST(count(v) AS BIGINT) AS valid, round(CASE WHEN count(v) >= 0.9 * {0} THEN quantile_cont(v, 0.025) END, 6) AS low, round(CASE WHEN count(v) >= 0.9 * {0} THEN quantile_cont(v, 0.975) END, 6) AS high".format(REPS)


@query(_weights_sql("stage", "f") + ", s AS (SELECT stage, item_id, sum(CAST(is_position AS INT)) AS k, count(*) AS n FROM f WHERE evaluator = 'e1' GROUP BY ALL), v AS (SELECT stage, rep, sum(w * k) / nullif(sum(w * n), 0) AS v FROM wt JOIN s USING (stage, item_id) GROUP BY ALL) SELECT stage, " + CI + " FROM v GROUP BY stage", F_)
def cluster_boot_ci(spark, sf):
    f = pj.frame(spark, sf).filter("evaluator = 'e1'")
    s = rs.replicates(f, "item_id", {"k": F.col("is_position").cast("int"), "n": F.lit(1)}, REPS, ["stage"])
    return rounded(rs.interval(s, st.ratio(F.col("k"), F.col("n")), ["stage"], REPS))


@query(_weights_sql("", "f") + """, s AS (SELECT item_id, sum(CAST(evaluator = 'e1' AND is_position AS INT)) AS k1, sum(CAST(evaluator = 'e1' AS INT)) AS n1, sum(CAST(evaluator = 'e2' AND is_position AS INT)) AS k2, sum(CAST(evaluator = 'e2' AS INT)) AS n2 FROM f GROUP BY ALL), v AS (SELECT rep, sum(w * k1) / nullif(sum(w * n1), 0) - sum(w * k2) / nullif(sum(w * n2), 0) AS v FROM wt JOIN s USING (item_id) GROUP BY rep) SELECT """ + CI + " FROM v", F_)
def boot_diff_ci(spark, sf):
    f = pj.frame(spark, sf)
    on = lambda e: F.col("evaluator") == e
    sums = {"k1": (on("e1") & F.col("is_position")).cast("int"), "n1": on("e1").cast("int"), "k2": (on("e2") & F.col("is_position")).cast("int"), "n2": on("e2").cast("int")}
    s = rs.replicates(f, "item_id", sums, REPS, [])
    return rounded(rs.interval(s, st.ratio(F.col("k1"), F.col("n1")) - st.ratio(F.col("k2"), F.col("n2")), [], REPS))


_CELLS = [(e, s) for e in ("e1", "e2") for s in ("s1", "s2")]


@query(_weights_sql("", "f") + ", s AS (SELECT item_id, " + ", ".join(f"sum(CAST(evaluator = '{e}' AND stage = '{s}' AND is_position AS INT)) AS k{i}, sum(CAST(evaluator = '{e}' AND stage = '{s}' AS INT)) AS n{i}" for i, (e, s) in enumerate(_CELLS)) + " FROM f GROUP BY ALL), v AS (SELECT rep, " + " ".join(f"{x} sum(w * k{i}) / nullif(sum(w * n{i}), 0)" for x, i in (("", 1), ("-", 0), ("-", 3), ("+", 2))) + " AS v FROM wt JOIN s USING (item_id) GROUP BY rep) SELECT " + CI + " FROM v", F_)
def boot_did_ci(spark, sf):
    f = pj.frame(spark, sf)
    cell = lambda e, s: (F.col("evaluator") == e) & (F.col("stage") == s)
    sums = {}
    for i, (e, s) in enumerate(_CELLS):
        sums |= {f"k{i}": (cell(e, s) & F.col("is_position")).cast("int"), f"n{i}": cell(e, s).cast("int")}
    s = rs.replicates(f, "item_id", sums, REPS, [])
    r = [st.ratio(F.col(f"k{i}"), F.col(f"n{i}")) for i in range(4)]
    return rounded(rs.interval(s, (r[1] - r[0]) - (r[3] - r[2]), [], REPS))


@query(_weights_sql("stage", "f") + ", s AS (SELECT stage, item_id, sum(CAST(outcome = 'agreement' AS INT)) AS k, count(*) AS n FROM f WHERE evaluator = 'e2' GROUP BY ALL), v AS (SELECT stage, rep, sum(w * k) / nullif(sum(w * n), 0) AS v FROM wt JOIN s USING (stage, item_id) GROUP BY ALL), l AS (SELECT stage, list_sort(list(v)) AS s FROM v WHERE v IS NOT NULL GROUP BY stage) SELECT stage, CAST(len(s) AS BIGINT) AS valid, round(s[CAST(floor(len(s) * 0.025) AS BIGINT) + 1], 6) AS low, round(s[len(s) - CAST(floor(len(s) * 0.025) AS BIGINT)], 6) AS high FROM l", F_)
def boot_rate_ci(spark, sf):
    f = pj.frame(spark, sf).filter("evaluator = 'e2'")
    s = rs.replicates(f, "item_id", {"k": (F.col("outcome") == "agreement").cast("int"), "n": F.lit(1)}, REPS, ["stage"])
    return rounded(rs.order_interval(s, st.ratio(F.col("k"), F.col("n")), ["stage"], REPS))


@query(", p AS (SELECT finish_reason AS stratum, count(*) AS n_all FROM r GROUP BY 1), x AS (SELECT f.finish_reason AS stratum, count(*) AS n, " + ", ".join(f"sum(CAST({c} AS INT)) AS {k}" for k, c in {"al": "outcome = 'agreement' AND item_lean = 'left'", "dl": "is_directional AND item_lean = 'left'", "ar": "outcome = 'agreement' AND item_lean = 'right'", "dr": "is_directional AND item_lean = 'right'"}.items()) + " FROM f WHERE evaluator = 'e1' AND doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS sampled, round(CASE WHEN count(x.stratum) = count(*) THEN sum(n_all / n * al) / nullif(sum(n_all / n * dl), 0) - sum(n_all / n * ar) / nullif(sum(n_all / n * dr), 0) END, 6) AS weighted_index FROM p LEFT JOIN x USING (stratum)", F_)
def two_phase_gap(spark, sf):
    """Design-weighted direction index from the labelled responses: strata weigh by population over sample size."""
    population = pj.records(spark, sf).groupBy(F.col("finish_reason").alias("stratum")).agg(F.count("*").alias("n_all"))
    o, lean = F.col("outcome"), F.col("item_lean")
    sums = {"al": (o == "agreement") & (lean == "left"), "dl": F.col("is_directional") & (lean == "left"), "ar": (o == "agreement") & (lean == "right"), "dr": F.col("is_directional") & (lean == "right")}
    sample = pj.rated(spark, sf).filter("evaluator = 'e1'").groupBy(F.col("finish_reason").alias("stratum")).agg(F.count("*").alias("n"), *[st.count_if(c).alias(k) for k, c in sums.items()])
    w = F.col("n_all") / F.col("n")
    t = population.join(sample, "stratum", "left").agg(F.sum("n").alias("sampled"), F.count("n").alias("have"), F.count("*").alias("strata"), *[F.sum(w * F.col(k)).alias(k) for k in sums])
    return rounded(t.select("sampled", F.when(F.col("have") == F.col("strata"), st.ratio(F.col("al"), F.col("dl")) - st.ratio(F.col("ar"), F.col("dr"))).alias("weighted_index")))


@query("""SELECT evaluator, printf('%d/%d [%.2f, %.2f]', k, n, CAST(round(CAST(l AS DECIMAL(20, 10)), 2) AS DOUBLE), CAST(round(CAST(h AS DECIMAL(20, 10)), 2) AS DOUBLE)) AS shown FROM (SELECT evaluator, k, n, """ + _wil("k", "n")[0] + " AS l, " + _wil("k", "n")[1] + " AS h FROM (SELECT evaluator, CAST(count(*) FILTER (WHERE is_position) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1))", F_)
def display_rates(spark, sf):
    k = pj.frame(spark, sf).groupBy("evaluator").agg(st.count_if(F.col("is_position")).alias("k"), F.count("*").alias("n"))
    return k.select("evaluator", st.rate_text(F.col("k"), F.col("n")).alias("shown"))


@query("""SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n = 0 THEN 'none' WHEN c = n THEN 'confirmed' WHEN c > 0 THEN 'partial' ELSE 'none' END AS verdict FROM (SELECT evaluator, count(*) AS n, count(*) FILTER (WHERE pr > 0.7) AS c FROM (SELECT evaluator, stage, avg(CAST(is_position AS INT)) AS pr FROM f GROUP BY ALL) GROUP BY evaluator)) GROUP BY verdict""", F_)
def stage_decision(spark, sf):
    """All, some or none of an evaluator's stages pass."""
    per = pj.frame(spark, sf).groupBy("evaluator", "stage").agg(st.share(F.col("is_position")).alias("pr"))
    v = per.groupBy("evaluator").agg(F.count("*").alias("n"), F.count_if(F.col("pr") > 0.7).alias("c"))
    return v.groupBy(F.when(F.col("c") == F.col("n"), "confirmed").when(F.col("c") > 0, "partial").otherwise("none").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT source, min(n) AS n_min, round(avg(n), 6) AS n_mean, max(n) AS n_max, CAST(count(DISTINCT lang) AS BIGINT) AS langs FROM (SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL) GROUP BY source")
def scalar_spread(spark, sf):
    per = pj.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rounded(per.groupBy("source").agg(F.min("n").alias("n_min"), F.avg("n").alias("n_mean"), F.max("n").alias("n_max"), F.count_distinct("lang").alias("langs")))


@query("SELECT stage, outcome, round(sum(CAST(evaluator = 'e1' AS INT)) / sum(sum(CAST(evaluator = 'e1' AS INT))) OVER (PARTITION BY stage), 6) AS share FROM f WHERE evaluator = 'e1' GROUP BY stage, outcome", F_)
def stacked_shares(spark, sf):
    return rounded(fr.outcome_rate(pj.frame(spark, sf).filter("evaluator = 'e1'"), ["stage"]).select("stage", "outcome", F.col("rate").alias("share")))


@query("SELECT item_id, round(sum(CAST(truncated AS INT)) * 1.0 / count(*), 6) AS cut_share, CAST(max(CAST(finish_reason = 'error' AS INT)) AS BIGINT) AS any_error FROM r2 GROUP BY item_id", F_ + ", r2 AS (SELECT *, finish_reason = 'length' AS truncated FROM r)")
def any_in_cluster(spark, sf):
    r = pj.records(spark, sf)
    return rounded(r.groupBy("item_id").agg(st.share(F.col("finish_reason") == "length").alias("cut_share"), F.max((F.col("finish_reason") == "error").cast("long")).alias("any_error")))
