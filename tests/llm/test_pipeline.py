"""The pipeline's stages on a small corpus, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(2)
    english = "the of and to in that it was for on are with as his they be at one have this from".split()
    german = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()
    prose = lambda words, n: " ".join(rng.choice(words) if rng.random() < 0.4 else "".join(rng.choices("abcdefghiklmnoprstuw", k=7)) for _ in range(n))
    rows, item = [], prose(english, 30)
    for i in range(80):
        w, lang = (english, "en") if i % 4 else (german, "de")
        rows.append((i, f"{prose(w, 60)}\nread more here\n{prose(w, 60)}", lang, "s", 0, 0.5))
    rows.append((200, rows[1][1], "en", "s", 0, 0.5))  # exact copy
    rows.append((201, rows[2][1].replace("read more here", "") + " one more word", "en", "s", 0, 0.5))  # near copy
    rows.append((202, prose(english, 50) + " " + item + " " + prose(english, 30), "en", "s", 0, 0.5))
    rows += [(203, None, "en", "s", 0, 0.5), (204, "12 34 !!", None, "s", 0, 0.5), (205, "", None, None, 0, 0.5), (3, rows[3][1], "en", "s", 0, 0.5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "words that stand nowhere in this corpus at all for sure indeed")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    docs = cp.language_id(spark, docs, folder)
    assert docs.columns == columns and {203, 204, 205}.isdisjoint(ids := [r.doc_id for r in docs.collect()]) and len(ids) == 84
    docs = cp.line_dedup(spark, docs, folder)
    assert docs.columns == columns and not docs.filter(F.col("text").contains("read more here")).count() and docs.count() == 84
    assert not docs.filter(F.col("n_chars") != F.length("text")).count()
    docs = cp.near_dedup(spark, docs, folder)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == [*range(80), 202]
    docs = cp.decontaminate(spark, docs, folder)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == list(range(80))
    packed = cp.packing(spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(range(80))


def test_run_equals_the_stages(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert {r.doc_id for r in cp.run(spark, folder).collect()} == set(range(80))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_that_share_a_hash_are_told_apart(spark, folder, monkeypatch):
    """Half of a row's key is the same for all rows: the other half still keeps clean rows."""
    monkeypatch.setattr(cp, "row_key", lambda *_: F.lit(7).cast("long"))
    monkeypatch.setattr("quorumlake.llm.jaccard.row_key", lambda *_: F.lit(7).cast("long"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL AND doc_id < 203 AND doc_id % 9 <> 4")
    kept = cp.near_dedup(spark, docs, folder)
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r.doc_id for r in docs.collect()} - {200, 201})
    assert sorted(r.doc_id for r in cp.decontaminate(spark, kept, folder).collect()) == [i for i in ids if i != 202]


def test_columns_that_clash_with_inner_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("rk", "rq", "stays", "lang_pred", "lang_score", "_host", "_rid", "par"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns and docs.filter("rk <> 'mine' OR rq <> 'mine' OR par <> 'mine'").count() == 0
    assert docs.count() == 80
