"""Queries on comparisons of evaluators, prompts and subsets, their intervals and readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import stats as st
from quorumlake.operators import contrasts as co, direction as di, frame as fr, labels as lb, paired as pa, resample as rs, sampling as sa
from quorumlake.plans import projection as pj
from quorumlake.plans.registry import CI, F_, H_, LOGC, REPS, TEXT_PAIRS, UNITS, _idx, _weights_sql, _wil, query, rounded, text_pairs

DIRS = "('agreement', 'disagreement')"
OUTCOME = "CASE WHEN {0} < 7 THEN 'agreement' WHEN {0} < 12 THEN 'disagreement' WHEN {0} < 15 THEN 'mixed_or_conditional' WHEN {0} < 18 THEN 'neutral_or_no_position' WHEN {0} = 18 THEN 'refusal' ELSE 'malformed' END"
FREE = [f"free_{i}" for i in range(1, 6)]


def _outcome_pairs(spark, sf):
    """Text pairs with the outcome that a length gives each side."""
    p = text_pairs(spark, sf)
    o = lambda c: F.when(c < 7, "agreement").when(c < 12, "disagreement").when(c < 15, "mixed_or_conditional").when(c < 18, "neutral_or_no_position").when(c == 18, "refusal").otherwise("malformed")
    return p.withColumns({f"outcome_{s}": o(F.col(f"n_chars_{s}") % 20) for s in "ab"})


_TP = TEXT_PAIRS + f", t AS (SELECT *, {OUTCOME.format('na % 20')} AS oa, {OUTCOME.format('nb % 20')} AS ob FROM px)"


@query(_TP + f" SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(ta = tb AS INT)), 6) AS same_text, round(avg(CAST(oa = ob AS INT)), 6) AS same_outcome, CAST(count(*) FILTER (WHERE oa IN {DIRS} AND ob IN {DIRS} AND oa <> ob) AS BIGINT) AS flips, round(avg(CAST(p >= 200 AS INT)), 6) AS long_prefix, round(quantile_cont(p, 0.5), 6) AS median_prefix FROM t GROUP BY source")
def determinism_table(spark, sf):
    return rounded(co.determinism(_outcome_pairs(spark, sf), ["source"]))


@query(_TP + ", x AS (SELECT *, CASE WHEN length(ta) <= length(tb) THEN starts_with(tb, ta) ELSE starts_with(ta, tb) END AS s, oa <> ob AS ch FROM t) SELECT source, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (WHERE s) AS BIGINT) AS n_prefix, CAST(count(*) FILTER (WHERE ch) AS BIGINT) AS n_changed, round(avg(CAST(ch AS INT)), 6) AS changed_share, CAST(count(*) FILTER (WHERE ch AND s) AS BIGINT) AS n_changed_prefix FROM x GROUP BY source")
def truncation_effect(spark, sf):
    return rounded(co.cut_effect(_outcome_pairs(spark, sf), ["source"]))


_WIDE = ", w AS (SELECT cache_key, stage, human, min(outcome) FILTER (WHERE evaluator = 'e1') AS e1, min(outcome) FILTER (WHERE evaluator = 'e2') AS e2, min(outcome) FILTER (WHERE evaluator = 'e3') AS e3 FROM hf GROUP BY ALL)"


def _four(c: str) -> str:
    return f"CASE WHEN {c} IN ('agreement', 'disagreement', 'mixed_or_conditional') THEN {c} ELSE 'neutral_or_no_position' END <> human"


def _tests_sql(stage: str) -> str:
    """All tests of e1 against each other evaluator as rows (pair, test, n, a, b, f, w)."""
    rows = []
    for o in ("e2", "e3"):
        for name, where, wrong in (("overread", f"human NOT IN {DIRS}", lambda x: f"{x} IN {DIRS}"), ("reversal", f"human IN {DIRS}", lambda x: f"{x} IN {DIRS} AND {x} <> human"), ("any_error", "TRUE", _four)):
            a, b = f"({wrong('e1')})", f"({wrong(o)})"
            rows.append(f"SELECT {stage}'e1/{o}' AS pair, '{name}' AS test, count(*) AS n, count(*) FILTER (WHERE {a}) AS a, count(*) FILTER (WHERE {b}) AS b, count(*) FILTER (WHERE {a} AND NOT {b}) AS f, count(*) FILTER (WHERE {b} AND NOT {a}) AS w FROM w WHERE {where} GROUP BY ALL")
    return ", ts AS (" + " UNION ALL ".join(rows) + "), tx AS (SELECT *, unnest(range(0, least(f, w) + 1)) AS i FROM ts), tp AS (SELECT " + stage + "pair, test, n, a, b, f, w, least(1.0, 2 * sum(exp(" + LOGC("f + w", "i") + " - (f + w) * ln(2.0)))) AS p FROM tx GROUP BY ALL)"


def _wide(spark, sf):
    return co.side_by_side(pj.rated(spark, sf), "evaluator", ["e1", "e2", "e3"], ["cache_key", "stage", "human"], "outcome")


@query(_WIDE + _tests_sql("stage, ") + " SELECT stage, pair, test, CAST(n AS BIGINT) AS n, round(a / n, 6) AS rate_base, round(b / n, 6) AS rate_other, round(b / n - a / n, 6) AS difference, CAST(f AS BIGINT) AS fixed, CAST(w AS BIGINT) AS broken, round(p, 6) AS p_value FROM tp", H_)
def paired_error_tests(spark, sf):
    return rounded(co.paired_error_tests(_wide(spark, sf), "e1", ["e2", "e3"], "human", ["stage"]))


@query(_WIDE + _tests_sql("") + " SELECT pair, max(p) FILTER (WHERE test = 'overread') < 0.05 AND max(b / n - a / n) FILTER (WHERE test = 'overread') < 0 AND max(b / n - a / n) FILTER (WHERE test = 'reversal') <= 0.05 AS supported FROM tp GROUP BY pair", H_)
def pair_support(spark, sf):
    return co.pair_support(co.paired_error_tests(_wide(spark, sf), "e1", ["e2", "e3"], "human"))


@query(f""", x AS (SELECT *, relation_c IN ('supports', 'opposes') AS c, outcome IN {DIRS} AS d FROM hf WHERE human NOT IN {DIRS}) SELECT evaluator, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS contested_n, CAST(count(*) FILTER (WHERE c AND d) AS BIGINT) AS contested_k, CAST(count(*) FILTER (WHERE NOT c) AS BIGINT) AS plain_n, CAST(count(*) FILTER (WHERE NOT c AND d) AS BIGINT) AS plain_k,
  round(avg(CAST(d AS INT)) FILTER (WHERE c), 6) AS contested_rate, round(avg(CAST(d AS INT)) FILTER (WHERE NOT c), 6) AS plain_rate FROM x GROUP BY evaluator""", H_)
def contested_overread(spark, sf):
    r = pj.rated(spark, sf).join(pj.humans(spark, sf).select("doc_id", "relation_a"), "doc_id")
    return rounded(co.contested_overread(r, ["evaluator"], "outcome", "human", ["relation_a", "relation_c"], lb.DIRECTIONS))


@query(f""", s AS (SELECT evaluator, stage, item_id, polarity, item_lean, outcome FROM f WHERE prompt = 'stance_first'), x AS (SELECT s.*, p.prompt, EXISTS (SELECT 1 FROM f WHERE f.evaluator = s.evaluator AND f.stage = s.stage AND f.item_id = s.item_id AND f.polarity = s.polarity AND f.prompt = p.prompt AND f.is_directional) AS c FROM s CROSS JOIN (SELECT unnest({FREE}) AS prompt) p),
k AS (SELECT evaluator, stage, prompt, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS in_n, CAST(count(*) FILTER (WHERE NOT c) AS BIGINT) AS rest_n, {_idx('c')} AS d1, {_idx('NOT c')} AS d2 FROM x GROUP BY ALL) SELECT evaluator, stage, prompt, in_n, rest_n, round(d1, 6) AS d_in, round(d2, 6) AS d_rest, round(d1 - d2, 6) AS difference FROM k WHERE in_n > 0""", F_)
def selection_check(spark, sf):
    return rounded(co.selection_check(pj.frame(spark, sf), ["evaluator", "stage"], FREE))


_SPECS = [(f"stage_{e}_{a}_{b}", {"evaluator": e, "stage": a}, {"evaluator": e, "stage": b}) for e in ("e1", "e2", "e3") for a, b in (("s1", "s2"), ("s2", "s3"))]
_SPECS += [(f"evaluator_{s}_e1_{e}", {"evaluator": "e1", "stage": s}, {"evaluator": e, "stage": s}) for s in ("s1", "s2", "s3") for e in ("e2", "e3")]


@query(f", c AS (SELECT evaluator, stage, avg(CAST(is_position AS INT)) AS pr, {_idx()} AS di FROM f GROUP BY ALL) " + " UNION ALL ".join(f"SELECT '{q}' AS question, round(b.pr - a.pr, 6) AS d_position_rate, round(b.di - a.di, 6) AS d_direction_index FROM (SELECT 1) LEFT JOIN c a ON a.evaluator = '{x['evaluator']}' AND a.stage = '{x['stage']}' LEFT JOIN c b ON b.evaluator = '{y['evaluator']}' AND b.stage = '{y['stage']}'" for q, x, y in _SPECS), F_)
def question_rows(spark, sf):
    cells = di.direction_metrics(pj.frame(spark, sf), ["evaluator", "stage"])
    return rounded(co.questions(cells, ["evaluator", "stage"], _SPECS, ["position_rate", "direction_index"]))


_PROMPTS = """, x AS (SELECT stage, evaluator, item_id, polarity, max(CAST(is_position AS INT)) FILTER (WHERE prompt = 'stance_first') AS a, max(CAST(is_position AS INT)) FILTER (WHERE prompt = 'free_1') AS b, max(CAST(response_complete AS INT)) FILTER (WHERE prompt = 'stance_first') AS ca, max(CAST(response_complete AS INT)) FILTER (WHERE prompt = 'free_1') AS cb FROM f GROUP BY ALL),
y AS (SELECT evaluator, stage, item_id, polarity, unnest(['all', CASE WHEN ca = 1 AND cb = 1 THEN 'both_completed' END]) AS scope, b - a AS difference FROM x WHERE a IS NOT NULL AND b IS NOT NULL), z AS (SELECT * FROM y WHERE scope IS NOT NULL)"""
_PAIR_KEYS = ["evaluator", "stage", "item_id", "polarity"]


@query(_PROMPTS + " SELECT evaluator, stage, scope, CAST(count(*) AS BIGINT) AS n, round(avg(difference), 6) AS mean_difference, CAST(count(*) FILTER (WHERE difference > 0) AS BIGINT) AS gains, CAST(count(*) FILTER (WHERE difference < 0) AS BIGINT) AS losses FROM z GROUP BY ALL", F_)
def stance_first_paired(spark, sf):
    d = co.paired_prompts(pj.frame(spark, sf), "stance_first", "free_1", _PAIR_KEYS)
    return rounded(d.groupBy("evaluator", "stage", "scope").agg(F.count("*").alias("n"), F.avg("difference").alias("mean_difference"), st.count_if(F.col("difference") > 0).alias("gains"), st.count_if(F.col("difference") < 0).alias("losses")))


ORDER_CI = "l AS (SELECT {0}list_sort(list(v)) AS s FROM v WHERE v IS NOT NULL {1}) SELECT {0}CAST(len(s) AS BIGINT) AS valid, round(s[CAST(floor(len(s) * 0.025) AS BIGINT) + 1], 6) AS low, round(s[len(s) - CAST(floor(len(s) * 0.025) AS BIGINT)], 6) AS high FROM l"


@query(_PROMPTS + ", zz AS (SELECT stage, item_id || '|' || polarity AS item_id, difference FROM z WHERE evaluator = 'e1' AND scope = 'all')" + _weights_sql("stage", "zz") + ", s AS (SELECT stage, item_id, sum(difference) AS k, count(*) AS n FROM zz GROUP BY ALL), v AS (SELECT stage, rep, sum(w * k) / nullif(sum(w * n), 0) AS v FROM wt JOIN s USING (stage, item_id) GROUP BY ALL), " + ORDER_CI.format("stage, ", "GROUP BY stage"), F_)
def boot_mean_ci(spark, sf):
    """Row bootstrap of the mean paired difference."""
    d = co.paired_prompts(pj.frame(spark, sf).filter("evaluator = 'e1'"), "stance_first", "free_1", _PAIR_KEYS).filter("scope = 'all'").withColumn("row", F.concat_ws("|", "item_id", "polarity"))
    s = rs.replicates(d, "row", {"k": F.col("difference"), "n": F.lit(1)}, REPS, ["stage"])
    return rounded(rs.order_interval(s, st.ratio(F.col("k"), F.col("n")), ["stage"], REPS))


@query(", e AS (SELECT stage, item_id, item_id AS cluster, CAST(a.outcome = b.outcome AS INT) AS same FROM (SELECT * FROM f WHERE evaluator = 'e1') a JOIN (SELECT cache_key, outcome FROM f WHERE evaluator = 'e2') b USING (cache_key))" + _weights_sql("stage", "e") + ", s AS (SELECT stage, item_id, sum(same) AS k, count(*) AS n FROM e GROUP BY ALL), v AS (SELECT stage, rep, sum(w * k) / nullif(sum(w * n), 0) AS v FROM wt JOIN s USING (stage, item_id) GROUP BY ALL), c AS (" + "SELECT stage, " + CI + " FROM v GROUP BY stage), ga AS (SELECT stage, CAST(count(*) AS BIGINT) AS n, avg(same) AS agreement FROM e GROUP BY stage) SELECT stage, n, round(agreement, 6) AS agreement, valid, low, high FROM ga JOIN c USING (stage)", F_)
def agreement_summary(spark, sf):
    w = co.side_by_side(pj.frame(spark, sf), "evaluator", ["e1", "e2"], ["cache_key", "stage", "item_id"], "outcome").withColumn("same", (F.col("e1") == F.col("e2")).cast("int"))
    s = rs.replicates(w, "item_id", {"k": F.col("same"), "n": F.lit(1)}, REPS, ["stage"])
    ci = rs.interval(s, st.ratio(F.col("k"), F.col("n")), ["stage"], REPS)
    return rounded(w.groupBy("stage").agg(F.count("*").alias("n"), F.avg("same").alias("agreement")).join(ci, "stage"))


_KEYED = UNITS + ", hm AS (SELECT doc_id, relation_c IN ('supports', 'opposes') AS h FROM hc), d AS (SELECT u.*, h, committed = 1 AS j, sf_pole = 'left_pole' AS l, sf_pole = 'right_pole' AS r FROM u JOIN hm USING (doc_id))"
_QUANTITIES = {"overread": ("j AND NOT h", "NOT h"), "underread": ("NOT j AND h", "h"), "human_commit": ("h", "TRUE"), "judged_commit": ("j", "TRUE")}


def _keyed(spark, sf):
    u = di.units(pj.frame(spark, sf), "e1").join(pj.humans(spark, sf).select("doc_id", lb.committed(F.col("relation_c")).alias("c_human")), "doc_id")
    return u.withColumns({"h": F.col("c_human") == 1, "j": F.col("committed") == 1, "l": F.col("sf_pole") == "left_pole", "r": F.col("sf_pole") == "right_pole"})


@query(_KEYED + ", k AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quantity, CAST(count(*) FILTER (WHERE {e} AND l) AS BIGINT) AS k1, CAST(count(*) FILTER (WHERE {b} AND l) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE {e} AND r) AS BIGINT) AS k2, CAST(count(*) FILTER (WHERE {b} AND r) AS BIGINT) AS n2 FROM d" for q, (e, b) in _QUANTITIES.items())
       + f"), w AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, {_wil('k1', 'n1')[0]} AS l1, {_wil('k1', 'n1')[1]} AS u1, {_wil('k2', 'n2')[0]} AS l2, {_wil('k2', 'n2')[1]} AS u2 FROM k), c AS (SELECT quantity, k1, n1, k2, n2, unnest(range(greatest(0, k1 + k2 - n2), least(k1 + k2, n1) + 1)) AS x FROM k), p AS (SELECT *, exp({LOGC('n1', 'x')} + {LOGC('n2', 'k1 + k2 - x')} - {LOGC('n1 + n2', 'k1 + k2')}) AS p, exp({LOGC('n1', 'k1')} + {LOGC('n2', 'k2')} - {LOGC('n1 + n2', 'k1 + k2')}) AS s FROM c), fe AS (SELECT quantity, least(1.0, sum(p) FILTER (WHERE p <= s * (1 + 1e-9))) AS pv FROM p GROUP BY 1)"
       + " SELECT quantity, k1, n1, k2, n2, round(p1 - p2, 6) AS difference, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), 6) AS low, round(p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2), 6) AS high, round(pv, 6) AS p_value FROM w JOIN fe USING (quantity)", H_)
def pole_contrasts(spark, sf):
    """Left- less right-pole errors and commitments, all quantities from one aggregation."""
    d, cond = _keyed(spark, sf), {"overread": (F.col("j") & ~F.col("h"), ~F.col("h")), "underread": (~F.col("j") & F.col("h"), F.col("h")), "human_commit": (F.col("h"), F.lit(True)), "judged_commit": (F.col("j"), F.lit(True))}
    sums = [st.count_if(c & F.col(side)).alias(f"{q}_{v}") for q, (e, b) in cond.items() for v, c, side in (("k1", e, "l"), ("n1", b, "l"), ("k2", e, "r"), ("n2", b, "r"))]
    k = d.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), *[F.col(f"{q}_{v}").alias(v) for v in ("k1", "n1", "k2", "n2")]) for q in cond])).alias("q")).select("q.*")
    n = [F.col(c) for c in ("k1", "n1", "k2", "n2")]
    low, high = st.newcombe(*n)
    return rounded(k.withColumns({"difference": st.ratio(n[0], n[1]) - st.ratio(n[2], n[3]), "low": low, "high": high, "p_value": st.fisher(*n)}))


_EFFECT = {"human_minus_judged_rate": "(h - j) / nullif(n, 0)", "human_asymmetry": "hl / nullif(nl, 0) - hr / nullif(nr, 0)", "judged_asymmetry": "jl / nullif(nl, 0) - jr / nullif(nr, 0)"}
_EFFECT["judged_minus_human_asymmetry"] = f"({_EFFECT['judged_asymmetry']}) - ({_EFFECT['human_asymmetry']})"
_MASKS = {"n": "TRUE", "h": "h", "j": "j", "nl": "l", "nr": "r", "hl": "h AND l", "hr": "h AND r", "jl": "j AND l", "jr": "j AND r"}


@query(_KEYED + ", ds AS (SELECT item_id, h, j, l, r FROM d)" + _weights_sql("", "ds") + ", s AS (SELECT item_id, " + ", ".join(f"sum(CAST(({m}) AS INT)) AS {k}" for k, m in _MASKS.items()) + " FROM ds GROUP BY item_id), t AS (SELECT rep, " + ", ".join(f"CAST(sum(w * {k}) AS DOUBLE) AS {k}" for k in _MASKS) + " FROM wt JOIN s USING (item_id) GROUP BY rep), a AS (SELECT " + ", ".join(f"CAST(sum({k}) AS DOUBLE) AS {k}" for k in _MASKS) + " FROM s), " +
       "v AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quantity, {x} AS v FROM t" for q, x in _EFFECT.items()) + "), e AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quantity, round({x}, 6) AS estimate FROM a" for q, x in _EFFECT.items()) + "), c AS (SELECT quantity, " + CI + " FROM v GROUP BY quantity) SELECT * FROM e JOIN c USING (quantity)", H_)
def measurement_effect(spark, sf):
    """Judged against human commitment, overall and by pole, with joint cluster-bootstrap intervals."""
    d = _keyed(spark, sf)
    masks = {k: F.expr(m) for k, m in _MASKS.items()}
    div = {q: F.expr(x) for q, x in _EFFECT.items()}
    long = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), x.cast("double").alias("v")) for q, x in div.items()])).alias("e")).select("e.*")
    ints = {k: c.cast("int") for k, c in rs.masks(masks).items()}
    whole = long(d.agg(*[F.sum(c).cast("double").alias(k) for k, c in ints.items()])).withColumnRenamed("v", "estimate")
    ci = rs.interval(long(rs.replicates(d, "item_id", ints, REPS, [])), F.col("v"), ["quantity"], REPS)
    return rounded(whole.join(ci, "quantity"))


@query(", z AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, doc_id % 100 / 100 AS c, CAST(outcome = human AS INT) AS same FROM hf WHERE evaluator = 'e1')" + _weights_sql("", "z") + ", v AS (SELECT t.t AS threshold, rep, sum(w * same) / nullif(sum(w), 0) AS v FROM wt JOIN z USING (item_id) CROSS JOIN (SELECT unnest([0.0, 0.5, 0.9]) AS t) t WHERE c >= t.t GROUP BY ALL), " + ORDER_CI.format("threshold, ", "GROUP BY threshold").replace("SELECT threshold, CAST(len", "SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(len"), H_)
def threshold_boot_ci(spark, sf):
    """Rows are resampled first and cut by confidence afterwards; a replicate left empty has no value."""
    r = pj.rated(spark, sf).filter("evaluator = 'e1'").select(F.col("doc_id").cast("string").alias("row"), (F.col("doc_id") % 100 / 100).alias("c"), (F.col("outcome") == F.col("human")).cast("int").alias("same"))
    at = [0.0, 0.5, 0.9]
    sums = {f"{k}{i}": F.when(F.col("c") >= t, v).otherwise(0) for i, t in enumerate(at) for k, v in (("k", F.col("same")), ("n", F.lit(1)))}
    s = rs.replicates(r, "row", sums, REPS, [])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), st.ratio(F.col(f"k{i}"), F.col(f"n{i}")).alias("v")) for i, t in enumerate(at)])).alias("e")).select("e.*")
    return rounded(rs.order_interval(long, F.col("v"), ["threshold"], REPS))


_HAJEK = {"al": "outcome = 'agreement' AND item_lean = 'left'", "dl": "is_directional AND item_lean = 'left'", "ar": "outcome = 'agreement' AND item_lean = 'right'", "dr": "is_directional AND item_lean = 'right'"}


@query(", x AS (SELECT item_id, finish_reason AS stratum, count(*) AS na, sum(CAST(sampled AS INT)) AS ns, " + ", ".join(f"sum(CAST(sampled AND {c} AS INT)) AS {k}" for k, c in _HAJEK.items()) + " FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS sampled FROM f WHERE evaluator = 'e1') GROUP BY ALL)" + _weights_sql("", "x") + ", t AS (SELECT rep, stratum, " + ", ".join(f"sum(w * {k}) AS {k}" for k in ("na", "ns", *_HAJEK)) + " FROM wt JOIN x USING (item_id) GROUP BY ALL), gt AS (SELECT * FROM t WHERE na > 0), v AS (SELECT rep, CASE WHEN min(ns) > 0 THEN sum(na / ns * al) / nullif(sum(na / ns * dl), 0) - sum(na / ns * ar) / nullif(sum(na / ns * dr), 0) END AS v FROM gt GROUP BY rep) SELECT " + CI + " FROM v", F_)
def two_phase_boot_ci(spark, sf):
    """Cluster draws; population and sample sizes of the strata are counted anew in each replicate."""
    lab = pj.table(spark, sf, "labels").select("doc_id").distinct().withColumn("sampled", F.lit(True))
    f = pj.frame(spark, sf).filter("evaluator = 'e1'").join(lab, "doc_id", "left").withColumns({"sampled": F.coalesce("sampled", F.lit(False)), "stratum": F.col("finish_reason")})
    per = f.groupBy("item_id", "stratum").agg(F.count("*").alias("na"), st.count_if(F.col("sampled")).alias("ns"), *[st.count_if(F.col("sampled") & F.expr(c)).alias(k) for k, c in _HAJEK.items()])
    cells = rs.replicates_by_cell(per, "item_id", "stratum", ["na", "ns", *_HAJEK], REPS)
    w = st.ratio(F.col("na"), F.col("ns"))
    t = cells.filter("na > 0").groupBy("rep").agg(F.min("ns").alias("least"), *[F.sum(w * F.col(k)).alias(k) for k in _HAJEK])
    v = F.when(F.col("least") > 0, st.ratio(F.col("al"), F.col("dl")) - st.ratio(F.col("ar"), F.col("dr")))
    return rounded(rs.interval(t, v, [], REPS))


_DELTA = ", s AS (SELECT item_id, " + ", ".join(f"sum(CAST(evaluator = '{e}' AND stage = '{s}' AND is_position AS INT)) AS k_{e}_{s}, sum(CAST(evaluator = '{e}' AND stage = '{s}' AS INT)) AS n_{e}_{s}" for e in ("e1", "e2", "e3") for s in ("s1", "s2")) + " FROM f GROUP BY item_id)"


def _rate(e: str, s: str) -> str:
    return f"sum(w * k_{e}_{s}) / nullif(sum(w * n_{e}_{s}), 0)"


@query(_weights_sql("", "f") + _DELTA + ", rr AS (SELECT rep, " + ", ".join(f"({_rate(e, 's2')}) - ({_rate(e, 's1')}) AS {e}" for e in ("e1", "e2", "e3")) + " FROM wt JOIN s USING (item_id) GROUP BY rep), v AS (SELECT 'e2' AS evaluator, e2 AS d, e2 - e1 AS dd FROM rr UNION ALL SELECT 'e3', e3, e3 - e1 FROM rr), qq AS (SELECT evaluator, quantile_cont(d, 0.025) AS dl, quantile_cont(d, 0.975) AS dh, quantile_cont(dd, 0.025) AS l2, quantile_cont(dd, 0.975) AS h2 FROM v GROUP BY 1) SELECT evaluator, round(dl, 6) AS low, round(dh, 6) AS high, CASE WHEN dl > 0 THEN 'larger' WHEN dh < 0 THEN 'attenuated' WHEN dl IS NULL THEN 'not_estimable' ELSE 'no_change' END AS magnitude, CASE WHEN (dl > 0 OR dh < 0) AND (l2 > 0 OR h2 < 0) THEN 'remains' WHEN dl > 0 OR dh < 0 THEN 'not_larger_than_explicit' ELSE 'not_detected' END AS shift, dl <= h2 AND l2 <= dh AS overlap FROM qq", F_)
def shift_readings(spark, sf):
    """Change of the position rate from stage to stage, against e1's change on the same draws, and how it reads."""
    es, ss = ("e1", "e2", "e3"), ("s1", "s2")
    sums = {}
    for e in es:
        for s in ss:
            here = (F.col("evaluator") == e) & (F.col("stage") == s)
            sums |= {f"k_{e}_{s}": (here & F.col("is_position")).cast("int"), f"n_{e}_{s}": here.cast("int")}
    r = rs.replicates(pj.frame(spark, sf), "item_id", sums, REPS, [])
    change = lambda e: st.ratio(F.col(f"k_{e}_s2"), F.col(f"n_{e}_s2")) - st.ratio(F.col(f"k_{e}_s1"), F.col(f"n_{e}_s1"))
    long = r.select(F.explode(F.array(*[F.struct(F.lit(e).alias("evaluator"), change(e).alias("d"), (change(e) - change("e1")).alias("dd")) for e in es[1:]])).alias("x")).select("x.*")
    a, b = rs.interval(long, F.col("d"), ["evaluator"], REPS), rs.interval(long, F.col("dd"), ["evaluator"], REPS)
    j = a.select("evaluator", "low", "high").join(b.select("evaluator", F.col("low").alias("l2"), F.col("high").alias("h2")), "evaluator")
    c = [F.col(x) for x in ("low", "high", "l2", "h2")]
    return rounded(j.select("evaluator", "low", "high", co.magnitude_reading(c[0], c[1]).alias("magnitude"), co.shift_reading((c[0], c[1]), (c[2], c[3])).alias("shift"), st.intervals_overlap(*c).alias("overlap")))


@query(", x AS (SELECT f.*, unnest(['all', CASE WHEN stage IN ('s1', 's2') THEN 'early' END, CASE WHEN stage = 's1' THEN 'first' END]) AS subset FROM f) SELECT subset, evaluator, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(is_position AS INT)), 6) AS position_rate FROM x WHERE subset IS NOT NULL GROUP BY ALL", F_)
def subset_sweep(spark, sf):
    s = co.subsets(pj.frame(spark, sf), {"all": F.lit(True), "early": F.col("stage").isin("s1", "s2"), "first": F.col("stage") == "s1"})
    return rounded(s.groupBy("subset", "evaluator").agg(F.count("*").alias("n"), st.share(F.col("is_position")).alias("position_rate")))


@query(", o2 AS (SELECT stage, outcome, CAST(round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY stage)) AS BIGINT) AS k FROM f WHERE evaluator = 'e1' GROUP BY stage, outcome) SELECT stage, outcome, CAST(unnest(range(1, k + 1)) AS BIGINT) AS copy FROM o2", F_)
def share_units(spark, sf):
    """A hundred units per stage, shared among the outcomes (rows of a dot grid)."""
    r = fr.outcome_rate(pj.frame(spark, sf).filter("evaluator = 'e1'"), ["stage"])
    return rounded(co.by_weight(r, F.round(100.0 * F.col("n") / F.col("total"))).select("stage", "outcome", "copy"))


@query(", x AS (SELECT evaluator, stage, polarity, avg(CAST(truncated AS INT)) AS t, avg(CAST(is_position AS INT)) AS p FROM f GROUP BY ALL) SELECT evaluator, stage, round(avg(t), 6) AS mean_truncated, round(avg(p), 6) AS mean_position, round(max(p) FILTER (WHERE polarity = 'orig') - max(p) FILTER (WHERE polarity = 'inv'), 6) AS polarity_gap FROM x GROUP BY ALL", F_)
def polarity_means(spark, sf):
    per = pj.frame(spark, sf).groupBy("evaluator", "stage", "polarity").agg(st.share(F.col("truncated")).alias("t"), st.share(F.col("is_position")).alias("p"))
    at = lambda x: F.max(F.when(F.col("polarity") == x, F.col("p")))
    return rounded(per.groupBy("evaluator", "stage").agg(F.avg("t").alias("mean_truncated"), F.avg("p").alias("mean_position"), (at("orig") - at("inv")).alias("polarity_gap")))


@query("SELECT doc_id, 'relation' AS \"column\", relation_a AS value_a, relation_c AS value_b FROM hc WHERE relation_a <> relation_c UNION ALL SELECT doc_id, 'mode', mode_a, mode_c FROM hc WHERE mode_a <> mode_c", H_)
def key_mismatches(spark, sf):
    h = pj.humans(spark, sf)
    side = lambda x: h.select("doc_id", F.col(f"relation_{x}").alias("relation"), F.col(f"mode_{x}").alias("mode"))
    return co.mismatches(side("a"), side("c"), "doc_id", ["relation", "mode"])


@query("SELECT CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS BIGINT) AS in_both, CAST(count(*) FILTER (WHERE d.doc_id IS NULL) AS BIGINT) AS only_b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def id_set_algebra(spark, sf):
    return co.set_algebra(pj.table(spark, sf, "documents"), pj.table(spark, sf, "labels"), "doc_id")


@query(", g2 AS (SELECT stage, sha256(item_id || '|' || polarity || '|' || prompt) AS h, item_id, prompt FROM r), kn AS (SELECT DISTINCT h, item_id FROM g2 WHERE prompt <> 'free_5') SELECT g2.h AS prompt_hash, g2.stage, kn.item_id, kn.h IS NOT NULL AS matched FROM g2 LEFT JOIN kn USING (h)", F_)
def hash_link_recovery(spark, sf):
    """Records without links find them again by the digest of their rendered prompt; one template is unknown."""
    r = pj.records(spark, sf).select("stage", "item_id", "prompt", F.sha2(F.concat_ws("|", "item_id", "polarity", "prompt"), 256).alias("prompt_hash"))
    known = r.filter("prompt <> 'free_5'").select("prompt_hash", "item_id")
    return co.recovered_links(r.select("prompt_hash", "stage"), known, "prompt_hash").select("prompt_hash", "stage", "item_id", "matched")


@query("SELECT doc_id, sha256(text) AS request_key, CASE WHEN length(text) % 3 = 0 THEN 'supports' WHEN length(text) % 3 = 1 THEN 'opposes' ELSE 'unclear' END AS native_label FROM documents")
def judge_back_join(spark, sf):
    """Equal requests are judged once; each response gets its request's judgement back by the digest."""
    d = pj.table(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("request_key"))
    judged = d.dropDuplicates(["request_key"]).select("request_key", F.element_at(F.array(F.lit("supports"), F.lit("opposes"), F.lit("unclear")), F.length("text") % 3 + 1).alias("native_label"))
    return d.select("doc_id", "request_key").join(judged, "request_key", "left").select("doc_id", "request_key", "native_label")


@query("SELECT stage, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE a.outcome = b.outcome) AS BIGINT) AS same FROM (SELECT * FROM f WHERE evaluator = 'e1') a JOIN (SELECT cache_key, outcome FROM f WHERE evaluator = 'e3') b USING (cache_key) GROUP BY stage", F_)
def overlap_check(spark, sf):
    """Outcomes of a full run against those of a validation run on the same responses."""
    f = pj.frame(spark, sf)
    run = lambda e: f.filter(F.col("evaluator") == e)
    j = run("e1").join(run("e3").select("cache_key", F.col("outcome").alias("validated")), "cache_key")
    return j.groupBy("stage").agg(F.count("*").alias("n"), st.count_if(F.col("outcome") == F.col("validated")).alias("same"))


@query("SELECT doc_id, json_extract_string(notes, '$.raw') AS raw, CAST(json_extract_string(notes, '$.n') AS BIGINT) AS n FROM (SELECT doc_id, to_json({'raw': lang || ' \"' || source || '\"', 'n': n_chars}) AS notes FROM documents)")
def notes_fields(spark, sf):
    d = pj.table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.concat(F.col("lang"), F.lit(' "'), F.col("source"), F.lit('"')).alias("raw"), F.col("n_chars").alias("n"))).alias("notes"))
    return d.select("doc_id", F.get_json_object("notes", "$.raw").alias("raw"), F.get_json_object("notes", "$.n").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY sha256('5:' || CAST(doc_id AS VARCHAR)) LIMIT 40")
def sample_outside(spark, sf):
    """A fixed number of responses that no annotator has seen."""
    return sa.outside(pj.table(spark, sf, "documents").select("doc_id"), pj.table(spark, sf, "labels"), "doc_id", 40, "5")


@query(", s AS (SELECT doc_id, row_number() OVER (PARTITION BY stage, prompt ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR))) AS k FROM r) SELECT doc_id, printf('L%03d', row_number() OVER (ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR)))) AS sample_id FROM s WHERE k <= 3", F_)
def shuffled_sheet(spark, sf):
    """A drawn sample's rows with ids in shuffled order."""
    drawn = sa.per_cell(pj.records(spark, sf), ["stage", "prompt"], "doc_id", 3, "7")
    return sa.shuffled(drawn, "doc_id", "9").select("doc_id", "sample_id")


@query("SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN outcome = 'refusal' THEN lang ELSE outcome END AS outcome FROM f) WHERE outcome IS NULL OR outcome NOT IN ('agreement', 'disagreement', 'mixed_or_conditional', 'neutral_or_no_position', 'refusal', 'safety_refusal', 'epistemic_uncertainty', 'malformed', 'generation_error', 'irrelevant') GROUP BY outcome", F_)
def unmapped_outcomes(spark, sf):
    """Outcomes outside the taxonomy, here planted in place of refusals."""
    f = pj.frame(spark, sf)
    return fr.unmapped(f.withColumn("outcome", F.when(F.col("outcome") == "refusal", F.col("lang")).otherwise(F.col("outcome"))))


@query("SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def text_reuse(spark, sf):
    """Texts that several responses share; grouped by digest, so whole texts are not shuffled."""
    d = pj.table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).filter("n > 1")


@query("SELECT item_id, polarity, min(outcome) FILTER (WHERE prompt = 'stance_first') AS stance_first, min(outcome) FILTER (WHERE prompt = 'free_1') AS free_1, min(outcome) FILTER (WHERE prompt = 'free_2') AS free_2 FROM f WHERE evaluator = 'e1' AND stage = 's1' GROUP BY ALL", F_)
def strict_pivot(spark, sf):
    """Outcomes by template; a second row in a cell is an error (found by ``require_unique``)."""
    f = pj.frame(spark, sf).filter("evaluator = 'e1' AND stage = 's1'")
    pa.require_unique(f, ["item_id", "polarity", "prompt"])
    return f.groupBy("item_id", "polarity").pivot("prompt", ["stance_first", "free_1", "free_2"]).agg(F.min("outcome"))
