"""Operators on small fixtures with known answers, and all queries against DuckDB."""

import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quorumlake.functions import stats, taxonomy, text as tx
from quorumlake.operators import agreement, contrasts, direction, frame, labels, paired, resample, sampling, scorers, series
from quorumlake.plans import registry, studies  # noqa: F401
from quorumlake.sources import export, files, identity, schemas, stores
from quorumlake.streaming.ingest import ingest

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    import pandas as pd

    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist()), key=repr)
    assert rows(got) == rows(want) and len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) == set(registry.QUERIES)


def values(spark, *pairs):
    return spark.createDataFrame([tuple(v for _, v in pairs)], [n for n, _ in pairs])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# text


def test_rules(spark):
    cases = [("I cannot help with that", "safety_refusal"), ("As an AI, I don't do this", "safety_refusal"), ("I don't have a personal opinion", "refusal"), ("On one hand yes,\non the other hand no", "mixed_or_conditional"), ("It is hard to say", "epistemic_uncertainty"), ("  Yes, surely", "agreement"), ("ſtrongly agree", "agreement"), ("No.", "disagreement"), ("Nothing of it", "neutral_or_no_position"), ("  ", "malformed"), (None, "malformed")]
    df = spark.createDataFrame([(t, "stop", w) for t, w in cases] + [("Yes", "error", "generation_error")], "t string, f string, w string")
    assert df.filter(tx.rule_outcome(F.col("t"), F.col("f")) != F.col("w")).collect() == []
    assert set(taxonomy.RULES) <= set(taxonomy.POSITION + taxonomy.NON_POSITION) and len(taxonomy.POSITION + taxonomy.NON_POSITION) == 10
    assert sum(map(len, taxonomy.RULES.values())) == 17


def test_judge_answers(spark):
    cases = [("supports", "agreement", "supports"), ("**Opposes**", "disagreement", "opposes"), ("Mixed or conditional.", "mixed_or_conditional", "mixed_or_conditional"), ("neutral-or-no-position", "neutral_or_no_position", "neutral_or_no_position"), ("`unclear`", "neutral_or_no_position", "unclear"), ("I agree", "malformed", None), ("", "malformed", None)]
    df = spark.createDataFrame(cases, "t string, o string, l string")
    got = df.select(tx.judge_outcome(F.col("t")).alias("a"), "o", tx.judge_label(F.col("t")).alias("b"), "l").collect()
    assert all(r.a == r.o and r.b == r.l for r in got)


def test_answers_and_prefixes(spark):
    answer = lambda t, required=True: one(spark, tx.final_answer(F.lit(t), "</think>", required))
    assert answer("a </think> b </think>  c ") == "c" and answer("no mark") == "" and answer("no mark", False) == "no mark"
    prefix = lambda a, b: one(spark, tx.common_prefix_length(F.lit(a), F.lit(b)))
    assert [prefix("hello", "help"), prefix("", "x"), prefix("abcX", "abcY"), prefix("😀😀a", "😀😀b"), prefix("same", "same")] == [3, 0, 3, 2, 4]
    assert one(spark, tx.first_words(F.lit("  a b\tc  d"), 3)) == "a b c"


# statistics


def test_closed_forms(spark):
    L = lambda x: F.lit(x).cast("long")
    low, high = stats.newcombe(L(56), L(70), L(48), L(80))
    assert round(one(spark, low), 4) == 0.0524 and round(one(spark, high), 4) == 0.3339
    fisher = lambda *a: one(spark, stats.fisher(*map(L, a)))
    assert round(fisher(1, 10, 6, 10), 4) == 0.0573 and round(fisher(3, 10, 3, 10), 6) == 1 and fisher(0, 0, 1, 2) is None
    mcnemar = lambda a, b: one(spark, stats.mcnemar(L(a), L(b)))
    assert mcnemar(0, 0) == 1 and mcnemar(5, 5) == 1 and abs(mcnemar(6, 0) - 2 / 64) < 1e-12
    assert one(spark, stats.wilson(L(0), L(0))[0]) is None and one(spark, stats.wilson(L(0), L(5))[0]) == 0
    shown = [one(spark, stats.signed(F.lit(x))) for x in (0.485, 0.2346, -0.081)]
    assert shown == ["+0.49", "+0.23", "-0.08"] and float(one(spark, stats.half_up(F.lit(0.1449)))) == 0.14


def test_agreement_measures(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (1, "b", "c"), (2, "x", "x"), (2, "x", "x"), (2, "y", "x"), (2, "y", "y"), (3, "z", "z"), (3, "z", "z"), (4, None, "a")], "g int, t string, p string")
    got = {r.g: r for r in agreement.agreement(df, "p", "t", ["g"]).collect()}
    assert abs(got[1].macro_f1 - 7 / 18) < 1e-12 and abs(got[1].macro_f1_reference - 7 / 12) < 1e-12
    assert abs(got[2].kappa - 0.5) < 1e-12 and got[3].kappa is None and got[3].accuracy == 1 and 4 not in got
    f1 = {r.label: r.f1 for r in agreement.label_f1(df.filter("g = 1"), "p", "t").collect()}
    assert abs(f1["a"] - 2 / 3) < 1e-12 and f1["b"] == 0.5 and f1["c"] == 0


# frame


def test_rates_keep_full_groups(spark):
    df = spark.createDataFrame([("g", "agreement", "stop"), ("g", "refusal", "length"), ("g", "refusal", "error"), (None, "refusal", "stop")], "g string, outcome string, finish_reason string").withColumn("item_lean", F.lit("left"))
    got = {(r.g, r.outcome): (r.n, r.total) for r in frame.outcome_rate(df, ["g"]).collect()}
    assert got == {("g", "agreement"): (1, 3), ("g", "refusal"): (2, 3), (None, "refusal"): (1, 1)}
    flagged = frame.flags(df)
    assert flagged.filter("finish_reason = 'error' AND (truncated OR response_complete)").count() == 0
    assert [r.stance_before_cut for r in flagged.orderBy("finish_reason").collect()].count(False) == 1
    scopes = {(r.scope, r.outcome): r.n for r in frame.by_completeness(flagged.filter("g = 'g'"), []).collect()}
    assert scopes == {("all", "agreement"): 1, ("all", "refusal"): 2, ("completed_only", "agreement"): 1, ("truncated_only", "refusal"): 1}
    with pytest.raises(frame.BrokenReference):
        frame.require_known(spark.createDataFrame([("k",)], "cache_key string"), spark.createDataFrame([("j",)], "cache_key string"))
    assert frame.unmapped(df.withColumn("outcome", F.lit("new"))).first().n == 4


def test_pairs(spark):
    df = spark.createDataFrame([("p1", "a", "x"), ("p1", "b", "y"), ("p2", "a", "x"), (None, "a", "n"), (None, "b", "m")], "k string, f string, v string")
    assert {(r.k, r.v_a, r.v_b) for r in paired.pairs(df, "f", "a", "b", ["k"], ["v"]).collect()} == {("p1", "x", "y"), (None, "n", "m")}
    u = paired.unmatched(df, "f", "a", "b", ["k"]).first()
    assert (u.only_a, u.only_b, u.both) == (1, 0, 2)
    with pytest.raises(paired.AmbiguousPairs):
        paired.require_unique(df.unionByName(df.limit(1)), ["k", "f"])


def test_gap_has_the_sign_of_selection(spark):
    rows = []
    for i in range(40):
        lean = "left" if i % 2 else "right"
        for polarity in ("orig", "inv"):
            own = lean if polarity == "orig" else {"left": "right", "right": "left"}[lean]
            sf = "agreement" if i % 4 < 2 else "disagreement"
            aligned = (sf == "agreement") == (own == "left")
            rows.append(("j", "s", f"i{i}", polarity, "stance_first", own, sf))
            rows += [("j", "s", f"i{i}", polarity, f"p{k}", own, "agreement" if aligned else "refusal") for k in range(5)]
    df = spark.createDataFrame(rows, "evaluator string, stage string, item_id string, polarity string, prompt string, item_lean string, outcome string").withColumn("finish_reason", F.lit("stop"))
    u = direction.units(frame.flags(df), "j")
    g = direction.selection_gap(u, ["stage"]).first()
    assert g.n == 400 and g.committed_n == 200 and g.gap == 2.0 and g.estimable


# resampling


def test_bootstrap_equals_gathering(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(f"c{c:02d}", float(rng.integers(0, 2))) for c in range(12) for _ in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "c string, v double")
    weights = resample.numpy_weights(spark, 12, 200, 0)
    got = {r.rep: r.k / r.n for r in resample.replicates(df, "c", {"k": F.col("v"), "n": F.lit(1)}, 200, [], weights).collect()}
    names = sorted({c for c, _ in rows})
    k, n = (np.array([sum(f(v) for c, v in rows if c == x) for x in names]) for f in (lambda v: v, lambda v: 1))
    idx = np.random.default_rng(0).integers(0, 12, (200, 12))
    want = k[idx].sum(1) / n[idx].sum(1)
    assert all(abs(got[r] - want[r]) < 1e-12 for r in range(200))


def test_clusters_not_rows_are_resampled(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 0)] * 50, "c string, v int")
    s = resample.replicates(df, "c", {"k": F.col("v"), "n": F.lit(1)}, 200, [])
    r = resample.interval(s, stats.ratio(F.col("k"), F.col("n")), [], 200).first()
    assert (r.low, r.high) == (0.0, 1.0)
    none = resample.interval(s, stats.ratio(F.col("k"), F.col("k") * 0), [], 200).first()
    assert none.low is None and none.valid == 0
    o = resample.order_interval(s, stats.ratio(F.col("k"), F.col("n")), [], 200).first()
    assert (o.low, o.high) == (0.0, 1.0)


def test_stream_weights_are_the_stream(spark):
    import random
    from collections import Counter

    rng = random.Random(0)
    want = [Counter(rng.randrange(10) for _ in range(10)) for _ in range(20)]
    got = [Counter() for _ in range(20)]
    for r in resample.stream_weights(spark, 10, 20).collect():
        got[r.rep][r.ordinal] = r.w
    assert got == want


def test_samples(spark):
    df = spark.range(1000).withColumns({"cell": F.col("id") % 4, "c": F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))})
    a = {r.id for r in sampling.per_cell(df, ["cell"], "id", 10, "1").collect()}
    assert len(a) == 40 and a == {r.id for r in sampling.per_cell(df.repartition(9), ["cell"], "id", 10, "1").collect()} != {r.id for r in sampling.per_cell(df, ["cell"], "id", 10, "2").collect()}
    s = sampling.by_stratum(df.withColumn("cell", F.when(F.col("cell") == 0, "all").otherwise("some")), "cell", ["all"], "c", 3)
    assert s.filter("cell = 'all'").count() == 250 and s.filter("cell = 'some'").select("c").distinct().count() == 3
    q = sampling.quotas(df, [("even", F.col("id") % 2 == 0, 30), ("any", F.lit(True), 30)], ["cell"], "id")
    assert q.count() == 60 == q.select("id").distinct().count()
    assert {r.sample_id for r in sampling.shuffled(df.limit(3), "id").collect()} == {"L001", "L002", "L003"}


# labels


def test_label_sheets(spark):
    sheet = lambda rows: spark.createDataFrame(rows, "sample_id string, relation string, mode string")
    a, c = sheet([("1", "supports", "m"), ("2", "supports", "m"), ("3", "opposes", "m"), ("4", "unclear", "m")]), sheet([("4", "unclear", "n"), ("3", "opposes", "m"), ("2", "neutral_or_no_position", "m"), ("1", "supports", "m")])
    q = {r.sample_id: r.commitment_differs for r in labels.queue(a, c).collect()}
    assert q == {"2": True, "4": False}
    done = labels.consensus(a, c, sheet([("2", "supports", "m"), ("4", "unclear", "n")]))
    assert {r.sample_id: (r.relation, r.provenance) for r in done.collect()}["3"] == ("opposes", "human_A_C_agreed")
    with pytest.raises(labels.UnresolvedLabels):
        labels.require_resolved(labels.consensus(a, c, sheet([("2", "supports", "m")])))
    assert one(spark, labels.resolved(F.lit(" "), F.lit("x"), F.lit("x"))) == "x" and one(spark, labels.resolved(F.lit(""), F.lit("x"), F.lit("y"))) is None
    assert {r.sample_id for r in labels.changed(a, c, ["mode"]).collect()} == {"4"}


# sources


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("k1", "e", "1", "agreement", None, None, None), ("k1", "e", "1", "refusal", None, None, None), ("k2", "e", "1", "refusal", 0.5, None, None)], schemas.EVALUATION)
    assert stores.evaluations(spark, path).count() == 0
    assert stores.append_idempotent(rows, path) == 2 and stores.append_idempotent(rows, path) == 0
    assert stores.append_idempotent(rows.withColumn("evaluator_version", F.lit("2")), path) == 2
    assert {r.evaluator_id: r.n for r in stores.summary(stores.evaluations(spark, path, ["e"])).collect()} == {"e": 4}
    with pytest.raises(stores.DuplicateKeys):
        stores.append_exclusive(rows.limit(1), path, schemas.EVALUATION, stores.EVALUATION_KEY)
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, t int, v string")
    assert {(r.k, r.v) for r in stores.last_wins(log, ["k"], "t").collect()} == {("a", "z"), ("b", "w")}


def test_label_csv_keeps_texts(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('﻿sample_id,statement,response,relation,mode,confidence_1to3,notes\n1,s,"a ""quoted"", cell\nof two lines",NA,null,,\n', encoding="utf-8")
    r = stores.labels_csv(spark, str(path), schemas.SHEET).first()
    assert (r.response, r.relation, r.mode, r.confidence_1to3, r.notes) == ('a "quoted", cell\nof two lines', "NA", "null", "", "")
    stores.require_header(spark, str(path), schemas.SHEET)
    with pytest.raises(ValueError, match="columns"):
        stores.require_header(spark, str(path), schemas.QUEUE)


def test_export_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    out = export.export(df, str(tmp_path / "t"), ("csv", "parquet", "md", "tex"))
    assert spark.read.parquet(out["parquet"]).count() == 2 and "a\\|b" in export.markdown(df) and r"1 & a|b \\" in export.latex(df)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"p": ["one", "two"]}')
    assert [(r.position, r.prompt) for r in stores.prompt_lists(spark, str(tmp_path / "d")).orderBy("position").collect()] == [(0, "one"), (1, "two")]
    first = stores.folder_digest(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "y.json").write_text("{}")
    assert first != stores.folder_digest(spark, str(tmp_path / "d"))


def test_cache_keys_are_those_of_canonical_json(spark):
    import hashlib

    request = {"rendered_prompt_hash": "h", "rendered_text": "t", "model_id": "m/x", "model_revision": "r", "tokenizer_revision": "q", "backend": "b", "precision": "p", "decoding": {"temperature": 0.7, "top_p": 1.0, "max_new_tokens": 200, "seed": None}, "item_id": "i", "variant_id": None, "template_id": None}
    plain = {k: v for k, v in request.items() if k not in ("rendered_text", "item_id", "variant_id", "template_id")}
    want = hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()
    df = spark.createDataFrame([(request,), ({**request, "item_id": "other"},), ({**request, "precision": "fp32"},)], f"request {schemas.REQUEST}")
    keys = [r[0] for r in df.select(identity.cache_key()).collect()]
    assert keys[0] == keys[1] == want != keys[2]


def test_ingest_adds_unseen_keys_once(spark, tmp_path):
    landing, store, check = (str(tmp_path / x) for x in ("landing", "store", "check"))
    schema = "k string, v int"
    rows = lambda *x: spark.createDataFrame(list(x), schema).coalesce(1).write.mode("append").json(landing)
    rows(("a", 1), ("a", 1), ("b", 2))
    ingest(spark, landing, store, schema, ["k"], check).awaitTermination()
    rows(("b", 9), ("c", 3))
    ingest(spark, landing, store, schema, ["k"], check).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(store).collect())) == [("a", 1), ("b", 2), ("c", 3)]


# scorers, series


def test_scorers(spark):
    rec = spark.createDataFrame([("1", "yes indeed", "stop"), ("2", " ", "stop"), ("3", "yes", "error"), ("4", "yes indeed", "stop")], "cache_key string, raw_text string, finish_reason string")
    rule = {r.generation_cache_key: r.outcome for r in scorers.RuleScorer().score(rec).collect()}
    assert rule == {"1": "agreement", "2": "malformed", "3": "generation_error", "4": "agreement"}
    model = scorers.BatchScorer("m", "1", lambda: lambda texts: [("pro", len(t) / 100) for t in texts], {"pro": "agreement"})
    got = {r.generation_cache_key: (r.outcome, r.confidence, r.native_label) for r in model.score(rec).collect()}
    assert got == {"1": ("agreement", 0.1, "pro"), "4": ("agreement", 0.1, "pro"), "2": ("malformed", None, None), "3": ("generation_error", None, None)}


def test_series(spark):
    curve = spark.createDataFrame(list(enumerate([0.2, 0.3, 0.55, 0.5, 0.7, 0.8])), "i int, x double")
    assert series.first_sustained(curve, "i", "x").first().i == 2
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "name string, parent string")
    assert {(r.name, r.ancestor, r.depth) for r in series.lineage(spark, chain).collect()} == {("c", "b", 1), ("c", "a", 2), ("b", "a", 1)}
    assert math.isclose(one(spark, stats.ratio(F.lit(1), F.lit(4))), 0.25)


# comparisons


def test_paired_errors(spark):
    wide = spark.createDataFrame([("agreement", "refusal", "refusal"), ("agreement", "refusal", "neutral_or_no_position"), ("refusal", "refusal", "refusal"), ("agreement", "disagreement", "agreement"), ("agreement", "agreement", "disagreement"), ("agreement", "agreement", None)], "e1 string, e2 string, human string")
    wide = wide.withColumn("human", F.when(F.col("human") == "refusal", "neutral_or_no_position").otherwise(F.col("human")))
    got = {r.test: r for r in contrasts.paired_error_tests(wide, "e1", ["e2"], "human").collect()}
    assert [(got[k].n, got[k].fixed, got[k].broken) for k in ("overread", "reversal", "any_error")] == [(3, 2, 0), (2, 0, 1), (5, 2, 1)]
    assert got["overread"].p_value == pytest.approx(0.5) and got["reversal"].difference == 0.5 and got["reversal"].p_value == 1
    assert [r.supported for r in contrasts.pair_support(contrasts.paired_error_tests(wide, "e1", ["e2"], "human")).collect()] == [False]


def test_selection_check_splits_items(spark):
    rows = [("i1", "orig", "left", "stance_first", "agreement"), ("i1", "orig", "left", "free_1", "agreement"), ("i2", "orig", "right", "stance_first", "disagreement"), ("i2", "orig", "right", "free_1", "disagreement"),
            ("i3", "orig", "left", "stance_first", "disagreement"), ("i3", "orig", "left", "free_1", "refusal"), ("i4", "orig", "right", "stance_first", "agreement"), ("i5", "orig", "left", "free_1", "agreement")]
    df = spark.createDataFrame(rows, "item_id string, polarity string, item_lean string, prompt string, outcome string").withColumns({"g": F.lit("x"), "is_directional": F.col("outcome").isin("agreement", "disagreement")})
    [r] = contrasts.selection_check(df, ["g"], ["free_1", "free_2"]).collect()
    assert (r.prompt, r.in_n, r.rest_n, r.d_in, r.d_rest, r.difference) == ("free_1", 2, 2, 1.0, -1.0, 2.0)


def test_cells_subsets_and_sets(spark):
    cells = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "k string, v double")
    got = contrasts.questions(cells, ["k"], [("q", {"k": "a"}, {"k": "b"}), ("none", {"k": "a"}, {"k": "z"})], ["v"]).collect()
    assert [(r.question, r.d_v) for r in got] == [("q", 0.5), ("none", None)]
    assert sorted(r.copy for r in contrasts.by_weight(cells, F.col("v") * 4).filter("k = 'b'").collect()) == [1, 2, 3]
    assert contrasts.subsets(cells, {"all": F.lit(True), "low": F.col("v") < 0.5}).count() == 3
    other = spark.createDataFrame([("b", 0.75), ("b", 0.75), ("c", None)], "k string, v double")
    assert tuple(contrasts.set_algebra(cells, other, "k").first()) == (1, 1, 1)
    assert [(r.k, r.column, r.value_a, r.value_b) for r in contrasts.mismatches(cells, other.distinct(), "k", ["v"]).collect()] == [("a", "v", "0.25", None)]


def test_readings(spark):
    x = lambda *v: [F.lit(i).cast("double") for i in v]
    assert [one(spark, contrasts.magnitude_reading(*x(*v))) for v in ((0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1), (None, None))] == ["larger", "attenuated", "no_change", "not_estimable"]
    shift = lambda a, b: one(spark, contrasts.shift_reading(tuple(x(*a)), tuple(x(*b))))
    assert [shift((0.1, 0.2), (0.1, 0.3)), shift((0.1, 0.2), (-0.1, 0.3)), shift((-0.1, 0.2), (0.1, 0.3))] == ["remains", "not_larger_than_explicit", "not_detected"]


def test_queue_problems(spark):
    cols = "sample_id string, relation_a string, relation_c string, mode_a string, mode_c string"
    expected = spark.createDataFrame([(f"s{i}", "supports", "opposes", "m", "m") for i in range(1, 6)], cols)
    done = spark.createDataFrame([("s1", "supports", "opposes", "m", "m", "supports"), ("s2", "supports", "opposes", "m", "m", " "), ("s3", "supports", "unclear", "m", "m", "odd"), ("s4", "supports", "opposes", "m", "m", "unclear"), ("s4", "supports", "opposes", "m", "m", "unclear"), ("s9", "supports", "opposes", "m", "m", "unclear")], cols + ", relation_adjudicated string")
    got = sorted((r.sample_id, r.rule) for r in labels.queue_problems(expected, done).collect())
    assert got == [("s2", "blank"), ("s3", "changed"), ("s3", "unknown"), ("s4", "repeated"), ("s5", "missing"), ("s9", "not_asked_for")]


def test_cluster_and_cell_weights_agree(spark):
    rows = spark.createDataFrame([(f"c{i % 5}", f"s{i % 2}", float(i)) for i in range(20)], "c string, s string, v double")
    per = rows.groupBy("c", "s").agg(F.sum("v").alias("v"))
    whole = {r.rep: r.v for r in resample.replicates(rows, "c", {"v": F.col("v")}, 20, []).collect()}
    cells = resample.replicates_by_cell(per, "c", "s", ["v"], 20).groupBy("rep").agg(F.sum("v").alias("v")).collect()
    assert {r.rep: r.v for r in cells} == whole and len(whole) == 20


@pytest.mark.parametrize("by", [[], ["g"]])
def test_draws_are_never_broadcast(spark, by):
    """The planner takes exploded draws for a few rows; their table is replicates x clusters."""
    rows = spark.range(50).select((F.col("id") % 3).alias("g"), F.concat(F.lit("c"), "id").alias("c"), F.lit(1).alias("v"))
    s = resample.replicates(rows, "c", {"v": F.col("v")}, 20, by)
    cells = resample.replicates_by_cell(rows, "c", "g", ["v"], 20)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (s, cells)]
    assert all("ShuffledHashJoin [_at" in p for p in plans) and "Broadcast" not in plans[0]


def test_paired_means_are_drawn_without_a_broadcast_and_equal_sql(spark, duck, monkeypatch):
    monkeypatch.setattr(resample, "DRAWS", 50)  # several pieces a stage
    got = registry.QUERIES["boot_mean_ci"](spark, SF)
    assert "ShuffledHashJoin [_at" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.select("stage", "valid", "low", "high").collect()) == sorted(duck.execute(f"SELECT stage, valid, low, high FROM ({registry.SQL['boot_mean_ci']})").fetchall())


def test_draws_in_pieces_are_the_hashed_draws_of_each_group(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(resample, "DRAWS", 7)
    held = {"a": 20, "b": 1, "d": 7, None: 4}
    rows = spark.createDataFrame([(g, f"c{i:02d}", float(i * i)) for g, n in held.items() for i in range(n)], "g string, c string, v double")
    got = {(r.g, r.rep): r.v for r in resample.replicates(rows, "c", {"v": F.col("v")}, 30, ["g"]).collect()}
    at = lambda rep, k, n: int(hashlib.md5(f"{rep}:{k}".encode()).hexdigest()[:8], 16) % n
    assert got == {(g, rep): float(sum(at(rep, k, n) ** 2 for k in range(n))) for g, n in held.items() if g for rep in range(30)}
    assert resample.replicates(rows.limit(0), "c", {"v": F.col("v")}, 30, []).count() == 0


# files


def test_models_and_curves(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "base.yaml").write_text("family: x\nlocked_anchor: true\nlicense:\n  name: y\n")
    (tmp_path / "m" / "tuned.yaml").write_text("family: x\nparent_checkpoint: base\n")
    got = files.model_registry(spark, str(tmp_path / "m")).select("name", "parent_checkpoint", "locked_anchor").collect()
    assert sorted(map(tuple, got), key=str) == [("base", None, True), ("tuned", "base", None)]
    for name, task, text in (("ckpt_001", "arc", {"arc_challenge": {"acc_norm": 0.5}}), ("ckpt_001", "mmlu", {"hendrycksTest-a": {"acc": 0.2}, "hendrycksTest-b": {"acc": 0.4}, "other": {"acc": 9.0}}), ("ckpt_002", "arc", None)):
        (tmp_path / "e" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "e" / name / f"eval_{task}.json").write_text(json.dumps({"results": text}) if text else "{broken")
    rows = files.eval_curves(spark, str(tmp_path / "e"), {"arc": {"key": "arc_challenge", "field": "acc_norm"}, "mmlu": {"prefix": "hendrycksTest-", "field": "acc"}}).orderBy("checkpoint").collect()
    assert [(r["index"], r.arc, r.arc_error, r.mmlu_error) for r in rows] == [(1, 0.5, None, None), (2, None, "unreadable", "missing")]
    assert rows[0].mmlu == pytest.approx(0.3) and rows[1].mmlu is None


def test_imports_are_never_replaced(spark, tmp_path):
    a, b, log = tmp_path / "a.csv", tmp_path / "b.csv", str(tmp_path / "log")
    a.write_bytes("sample_id\né\r\n".encode())
    assert files.import_once(spark, "sheet", str(a), str(b), log) and b.read_bytes() == a.read_bytes()
    assert not files.import_once(spark, "sheet", str(a), str(b), log)
    a.write_text("other")
    with pytest.raises(files.FrozenFile):
        files.import_once(spark, "sheet", str(a), str(b), log)
    assert [r.artifact for r in spark.read.schema(files.IMPORT).json(log).collect()] == ["sheet"]


def test_sample_outside(spark):
    got = {r.id for r in sampling.outside(spark.range(20), spark.range(15), "id", 3).collect()}
    assert len(got) == 3 and min(got) >= 15


def test_missing_requests_are_generated_once(spark):
    from quorumlake.operators import scorers

    requests = spark.createDataFrame([("a", "one two three four"), ("a", "one two three four"), ("b", "x"), ("c", "y")], "request_key string, prompt string")
    known = spark.createDataFrame([("b",)], "request_key string")
    got = scorers.generate_missing(scorers.EchoBackend(), requests, known).collect()
    assert sorted((r.request_key, r.raw_text) for r in got) == [("a", "one two three"), ("c", "y")]


def test_last_wins_takes_maps_and_the_last_of_ties(spark):
    from pyspark.sql import functions as F

    from quorumlake.sources import stores

    rows = spark.createDataFrame([("k", 1, {"a": "1"}), ("k", 2, {"b": "z"}), ("k", 2, {"c": "a"}), ("j", None, {})], "key string, at int, m map<string,string>").coalesce(1)
    got = {r.key: r.m for r in stores.last_wins(rows, ["key"], "at").collect()}
    assert got == {"k": {"c": "a"}, "j": {}}
    assert stores.last_wins(rows.filter(F.lit(False)), ["key"], "at").count() == 0


def test_exact_test_of_many_discordant_pairs(spark):
    import math

    from pyspark.sql import functions as F

    from quorumlake.functions import stats

    rows = spark.createDataFrame([(0, 0), (3, 9), (40_000, 40_500), (0, 2000)], "a long, b long")
    got = [r.p for r in rows.select(stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()]
    exact = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    assert got[0] == 1.0 and abs(got[1] - exact(3, 9)) < 1e-12 and 0.07 < got[2] < 0.09 and got[3] == 0.0


def test_templates_names_and_reports(spark):
    from pyspark.sql import functions as F

    from quorumlake.functions import text as tx
    from quorumlake.operators import labels, paired
    from quorumlake.sources import export

    t = spark.createDataFrame([("{y} is {q}", "no")], "q string, y string")
    assert t.select(tx.filled("Q {q} A {y} {z}", q=F.col("q"), y=F.col("y"))).first()[0] == "Q {y} is {q} A no {z}"
    assert "## One\n\n| q | y |" in export.report("T", {"One": t, "Two": "text"}) and paired.starting_with(t, "q") == ["q"]
    with pytest.raises(ValueError):
        labels.require_routed(t.withColumn("relation", F.lit(None).cast("string")), ["relation"])
