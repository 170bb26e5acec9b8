"""Global numbers, quantiles by selection, lineage of any depth, quotas."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from quorumlake.operators import ordering, sampling, series


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_numbers_are_those_of_a_window(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("a"), F.xxhash64("id").alias("_place"), F.col("id").alias("b")).repartition(7)
    got = ordering.numbered(df, F.desc("a"), "b", name="n", start=5)
    want = {r.b: r.n for r in df.withColumn("n", F.row_number().over(W.orderBy(F.desc("a"), "b")) + 4).collect()}
    assert {r.b: r.n for r in got.collect()} == want and got.columns == ["a", "_place", "b", "n"]
    assert "SinglePartition" not in plan_of(got)
    assert ordering.numbered(df.limit(0), "a").count() == 0
    same = ordering.numbered(spark.range(500).select(F.lit(1).alias("x")), "x")
    assert sorted(r.ordinal for r in same.collect()) == list(range(1, 501))


def test_quantiles_by_selection_equal_percentile(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 9), 1.5, None])) for _ in range(4000)] + [("one", 2.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    qs = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "max": 1.0}
    got = {r.g: r.asDict() for r in ordering.exact_quantiles(df, ["g"], "v", qs).collect()}
    want = {r.g: r.asDict() for r in df.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect() if r.n}
    assert set(got) == set(want)
    for g, w in want.items():
        assert {k: pytest.approx(w[k], abs=1e-9) if k != "g" else g for k in w} == got[g]
    whole = ordering.exact_quantiles(df, [], "v", {"p50": 0.5}).first()
    assert whole.p50 == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    skewed = spark.range(5000).select(F.lit("x").alias("g"), F.when(F.col("id") < 4000, 3).otherwise(F.col("id")).alias("v"))
    assert ordering.exact_quantiles(skewed, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()[2:] == (3.0, skewed.agg(F.percentile("v", 0.9)).first()[0])


def test_chains_of_a_thousand_parents(spark):
    chain = spark.range(1001).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"))
    walk = series.lineage(spark, chain)
    assert walk.count() == 1001 * 1000 // 2
    last = {(r.ancestor, r.depth) for r in walk.filter("name = 'n1000'").collect()}
    assert last == {(f"n{i}", 1000 - i) for i in range(1000)}


def test_cycles_are_reported(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", None), (None, "a"), ("self", "self")], "name string, parent string")
    assert {r.name for r in series.endless(nodes).collect()} == {"a", "b", "c", "d", "self"}
    with pytest.raises(series.CyclicLineage, match="'a', 'b', 'c', 'd', 'self'"):
        series.lineage(spark, nodes)
    fine = nodes.filter("name IN ('e', 'f')")
    assert [tuple(r) for r in series.lineage(spark, fine).collect()] == [("e", "f", 1)] and series.endless(fine).count() == 0
    assert series.lineage(spark, fine.limit(0)).count() == 0


def test_one_series_of_any_length_and_several_agree(spark):
    curve = spark.createDataFrame([(i, x) for i, x in enumerate([0.2, 0.1, 0.55, 0.5, 0.7, 0.66, 0.8])], "i int, x double")
    alone = series.first_sustained(curve, "i", "x")
    several = series.first_sustained(curve.withColumn("g", F.lit(1)), "i", "x", ["g"])
    assert tuple(alone.first()) == tuple(several.drop("g").first()) and "SinglePartition" not in plan_of(ordering.numbered(curve, "i"))


def plain_quotas(df, strata, spread, key, seed):
    """Stratum by stratum from all rows that are left."""
    taken, left = None, df
    for name, condition, n in strata:
        cell = W.partitionBy(*spread).orderBy(sampling.hash_order(F.col(key), seed))
        ranked = left.filter(condition).withColumn("_rank", F.row_number().over(cell))
        got = ranked.orderBy("_rank", sampling.hash_order(F.col(key), seed)).limit(n).drop("_rank").withColumn("stratum", F.lit(name))
        got = spark_rows(got)
        taken = got if taken is None else taken.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    return taken


def spark_rows(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_seven_strata_take_the_rows_that_are_left(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("x"))
    strata = [(f"s{k}", F.col("x") % (k + 2) == 0, n) for k, n in enumerate([13, 40, 3, 25, 60, 7])] + [("rest", F.lit(True), 30)]
    got = sampling.quotas(df, strata, ["cell"], "id", "4")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain_quotas(df, strata, ["cell"], "id", "4").collect()}
    small = [("one", F.col("x") < 2, 500), ("two", F.col("x").isNull(), 5), ("three", F.col("x") < 3, 500)]
    assert {(r.id, r.stratum) for r in sampling.quotas(df, small, ["cell"], "id").collect()} == {(r.id, r.stratum) for r in plain_quotas(df, small, ["cell"], "id", "0").collect()}


def test_small_steps_keep_their_guards(spark):
    from quorumlake.functions import stats
    from quorumlake.operators import reshape as sh

    a = spark.createDataFrame([("k", 1, None), (None, 2, "x"), ("m", 3, "y")], "k string, n int, s string")
    b = spark.createDataFrame([("k", 9, "b"), (None, 8, "c"), ("z", 7, "d")], "k string, n int, t string")
    met = {r.k: (r.n_old, r.n_new) for r in sh.joined_on(a, b, ["k"], ("_old", "_new")).collect()}
    assert met == {"k": (1, 9), None: (2, 8)}
    assert sh.resuffixed(a.toDF("k", "n_a", "s_b"), {"_a": "_100", "_b": "_250"}).columns == ["k", "n_100", "s_250"]
    assert {r.k: (r.n, r.s, r.t) for r in sh.filled(a, b, ["k"]).collect()} == {"k": (1, None, "b"), None: (2, "x", "c"), "m": (3, "y", None), "z": (7, None, "d")}
    assert {r.k: r.t for r in sh.looked_up(a, b, "k", "t").collect()} == {"k": "b", None: "c", "m": None}
    with pytest.raises(sh.NotConstant):
        sh.looked_up(a, b.unionByName(b), "k", "t")
    twice = a.unionByName(a.withColumn("n", F.col("n") + 1))
    with pytest.raises(sh.NotConstant, match="several values"):
        sh.first_values(twice, ["k"], ["n"])
    assert {r.k: r.s for r in sh.first_values(twice, ["k"], ["s"]).collect()} == {"k": None, None: "x", "m": "y"}
    assert {r.k: r.n for r in sh.first_values(twice, ["k"], ["n"], constant=False).collect()} == {"k": 1, None: 2, "m": 3}
    x = spark.createDataFrame([(0.48505,), (2.5,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in x.select(stats.half_even(F.col("x"), 4)).collect()] == [0.485, 2.5, -0.125, None]
    assert [r[0] for r in x.select(stats.half_even(F.col("x"), 0)).collect()] == [0.0, 2.0, -0.0, None]
    assert [r.k for r in sh.top_rows(b, 2, F.desc("n")).collect()] == ["k", None]


def test_digests_of_sheets_and_tables(spark, tmp_path):
    import hashlib
    import json

    from quorumlake.sources import files, stores

    sheet = [("2", "é", 'a "b"'), ("1", "s", "r")]
    df = spark.createDataFrame(sheet, "sample_id string, statement string, response string")
    want = hashlib.sha256()
    for r in sorted(sheet):
        want.update(json.dumps(list(r)).encode())
    assert stores.sheet_digest(df, ("sample_id", "statement", "response"), "sample_id") == want.hexdigest()
    rows = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(1000)]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[k : k + 7]).encode()).hexdigest() for k in range(0, len(level), 7)]
    assert stores.tree_digest(rows, ["id"], "h", 7) == stores.tree_digest(rows.repartition(5), ["id"], "h", 7) == level[0]
    assert stores.tree_digest(rows.limit(0), ["id"], "h") == hashlib.sha256(b"").hexdigest() != stores.tree_digest(rows.limit(1), ["id"], "h")
    (tmp_path / "one.yaml").write_text("family: f\nlicense: {name: mit, tiers: [1, 2]}\ntransparency:\n  tier: open\n")
    (tmp_path / "two.yaml").write_text("family: g\n")
    got = files.registry_sections(spark, str(tmp_path)).select("name", files.nested(F.col("entry"), "$.license.name").alias("license"), files.nested(F.col("entry"), "$.license.tiers[1]", "int").alias("tier"), files.nested(F.col("entry"), "$.transparency.tier", "int").alias("wrong"))
    assert [tuple(r) for r in got.orderBy("name").collect()] == [("one", "mit", 2, None), ("two", None, None, None)]


def test_cuts_after_tokens_and_printed_tables(spark, tmp_path):
    from quorumlake.operators import scorers
    from quorumlake.sources import export

    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], t.decode

    long = "several words of a rather long answer " * 20
    rows = [("1", long, "stop", 500), ("2", "short", "stop", 1), ("3", long, "error", 0), ("4", " ", "stop", 3), ("5", None, "stop", None), ("6", long, "stop", 500)]
    df = spark.createDataFrame(rows, "cache_key string, raw_text string, finish_reason string, output_tokens int")
    got = {r.cache_key: tuple(r)[1:] for r in scorers.cut_tokens(df, load, 7).collect()}
    assert got["1"] == got["6"] and got["1"][1:] == ("length", 7) and long.startswith(got["1"][0]) and len(got["1"][0].split()) in (6, 7)
    assert got["2"][:2] == ("short", "stop") and got["3"] == (long, "error", 0) and got["4"] == (" ", "stop", 3) and got["5"] == (None, "stop", None)
    out = export.paper_table(spark.createDataFrame([("a_b", 0.5)], "name string, rate double"), str(tmp_path / "t"), "Table 1. Rates", "n < 10 is not read.")
    text = "\n".join(r.value for r in spark.read.text(out["tex"]).collect())
    assert text.startswith("% Table 1. Rates n < 10") and r"a\_b & 0.5" in text
    assert [r.value for r in spark.read.text(out["md"]).collect()][0] == "**Table 1. Rates**"


def test_digest_of_three_levels_equals_sql_beyond_their_rows(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    path = f"{tmp_path}/documents.parquet"
    spark.range(64**3 + 130).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = entry.queries()["table_digest"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("n", "digest").collect()] == con.execute(f"SELECT n, digest FROM ({entry.oracle_sql()['table_digest']})").fetchall()
