"""Logs with a manifest, broken lines, ingest that is interrupted."""

import json

import pytest
from pyspark.sql import functions as F

from quorumlake.sources import logs, stores
from quorumlake.sources.logs import Log
from quorumlake.streaming.ingest import ingest_log

SCHEMA = "k string, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return {r.k: r.v for r in df.collect()}


def test_the_newest_append_wins_whatever_its_size(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), SCHEMA, ["k"])
    assert log.read().count() == 0 and log.newest().count() == 0
    log.append(rows(spark, ("a", "first"), ("b", "first")))
    log.append(spark.range(5000).select(F.when(F.col("id") == 4321, "a").otherwise(F.concat(F.lit("x"), "id")).alias("k"), F.lit("second").alias("v")).repartition(3))
    assert held(log.newest().filter("k IN ('a', 'b')")) == {"a": "second", "b": "first"}
    log.append(rows(spark, ("a", "third"), ("a", "last")).coalesce(1))
    assert held(log.newest().filter("k IN ('a', 'b')")) == {"a": "last", "b": "first"} and log.newest().count() == 5001
    assert [r.n_rows for r in log.commits().orderBy("sequence").collect()] == [2, 5000, 2]


def test_later_logs_win_over_earlier_ones(spark, tmp_path):
    one, two = (Log(spark, str(tmp_path / n), s, ["k"]) for n, s in (("one", SCHEMA), ("two", SCHEMA + ", extra int")))
    one.append(rows(spark, ("a", "1"), ("b", "1")))
    two.append(spark.createDataFrame([("b", "2", 7)], SCHEMA + ", extra int"))
    one.append(rows(spark, ("b", "3")))
    assert held(logs.newest([one, two])) == {"a": "1", "b": "2"} and held(logs.newest([two, one])) == {"a": "1", "b": "3"}
    assert {r.extra for r in logs.newest([one, two]).collect()} == {None, 7}


def test_an_append_without_commit_is_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log = Log(spark, path, SCHEMA, ["k"], bucket_rows=2)
    log.append_unseen(rows(spark, ("a", "1")), "b1")
    with monkeypatch.context() as m:
        m.setattr(Log, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.append_unseen(rows(spark, *[(f"n{i}", "2") for i in range(40)]), "b2")
    assert held(log.read()) == {"a": "1"}
    assert log.append_unseen(rows(spark, *[(f"n{i}", "2") for i in range(40)]), "b2") == 40
    assert log.append_unseen(rows(spark, *[(f"n{i}", "2") for i in range(40)]), "b2") == 0
    assert log.read().count() == 41 and log.clean() == 1 and log.read().count() == 41


def test_the_index_misses_no_key_and_finds_none_that_is_not_there(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), SCHEMA, ["k"], bucket_rows=8)
    known = set()
    for step, (lo, hi) in enumerate([(0, 10), (5, 300), (290, 310), (0, 900), (0, 1)]):
        batch = spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(str(step)).alias("v"))
        want = {f"k{i}" for i in range(lo, hi)} - known
        assert {r.k for r in log.unseen(batch).collect()} == want
        plain = {r.k for r in batch.join(log.read(), "k", "left_anti").collect()}
        assert plain == want
        assert log.append_unseen(batch.unionByName(batch)) == len(want)
        known |= want
    assert log.last_commit().bits >= 6
    with pytest.raises(stores.DuplicateKeys):
        log.append_exclusive(rows(spark, ("k7", "x")))
    with pytest.raises(stores.DuplicateKeys):
        log.append_exclusive(rows(spark, ("new", "x"), ("new", "y")))
    assert log.append_exclusive(rows(spark, ("new", "x"))) == 1
    assert log.append_unseen(rows(spark, (None, "x"), (None, "y"))) == 1 and log.append_unseen(rows(spark, (None, "z"))) == 0


def test_what_a_batch_reads_of_the_index_does_not_grow_with_the_log(spark, tmp_path):
    read = []
    for n in (500, 16_000):
        log = Log(spark, str(tmp_path / str(n)), SCHEMA, ["k"], bucket_rows=16)
        log.append_unseen(spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v")))
        batch = spark.range(0, n, n // 10).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v"))
        read.append(log.known(batch).count())
        assert log.append_unseen(batch) == 0
    assert read[1] < 2 * read[0] < 2 * 10 * 64


LINES = [
    json.dumps({"cache_key": "a", "raw_text": "one", "input_tokens": 3}),
    "",
    json.dumps({"cache_key": "b", "raw_text": "two"})[:-6],
    "   ",
    json.dumps({"raw_text": "no key"}),
    json.dumps({"cache_key": "c", "input_tokens": "three"}),
    "[]x",
    json.dumps({"cache_key": "a", "raw_text": "again"}),
]
RECORD = "cache_key string, raw_text string, input_tokens int"


def test_broken_lines_are_told_and_stop_a_strict_scan(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(LINES) + "\n")
    path = str(tmp_path / "log.jsonl")
    found = stores.lines(spark, path, RECORD)
    bad = stores.quarantine(found).orderBy(*stores.PLACE).collect()
    assert [(r._problem, r._text) for r in bad] == [("unreadable", LINES[2]), ("no key", LINES[4]), ("unreadable", LINES[5]), ("unreadable", LINES[6])]
    with pytest.raises(stores.BrokenRecords, match="4 broken lines, 3 allowed.*log.jsonl"):
        stores.sound(found, 3)
    assert [r.raw_text for r in stores.sound(found, 4).collect()] == ["one", "again"]
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE|broken line"):
        stores.scan(spark, path, RECORD).select("raw_text").collect()
    for bad in (2, 4, 5):  # each of them alone; the reader passes over an empty array
        one = tmp_path / f"bad{bad}.jsonl"
        one.write_text("\n".join([LINES[0], LINES[1], LINES[3], LINES[bad]]))
        with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE|broken line"):
            stores.scan(spark, str(one), RECORD).select("input_tokens").collect()
    fine = tmp_path / "fine.jsonl"
    fine.write_text("\n".join([LINES[0], LINES[1], LINES[3], LINES[7]]))
    assert stores.scan(spark, str(fine), RECORD).count() == 2
    assert stores.scan(spark, path, RECORD, strict=False).count() == 2
    assert stores.last_lines(found, on=["cache_key"]).first().raw_text == "again"
    assert stores.lines(spark, str(tmp_path / "none"), RECORD).count() == 0


def test_the_last_line_of_the_last_log_wins(spark, tmp_path):
    many = [json.dumps({"cache_key": f"k{i % 50}", "raw_text": f"{i}", "input_tokens": i}) for i in range(20_000)]
    (tmp_path / "one.jsonl").write_text("\n".join(many))
    (tmp_path / "two.jsonl").write_text(json.dumps({"cache_key": "k7", "raw_text": "new"}))
    one, two = (stores.lines(spark, str(tmp_path / f"{n}.jsonl"), RECORD) for n in ("one", "two"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r.cache_key: r.raw_text for r in stores.last_lines(one, two, on=["cache_key"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"k{i}": str(19_950 + i) for i in range(50)} | {"k7": "new"}


def test_an_interrupted_stream_adds_each_key_once(spark, tmp_path, monkeypatch):
    landing, path, check = (str(tmp_path / x) for x in ("landing", "log", "check"))
    for part in range(4):
        rows(spark, *[(f"k{i}", str(part)) for i in range(part * 10, part * 10 + 15)]).coalesce(1).write.mode("append").json(landing)
    commit, calls = Log._commit, []

    def failing(self, c):
        calls.append(c)
        if len(calls) == 3:
            raise OSError("lost in mid-batch")
        commit(self, c)

    monkeypatch.setattr(Log, "_commit", failing)
    with pytest.raises(Exception, match="mid-batch"):
        ingest_log(spark, landing, path, SCHEMA, ["k"], check, files=1, bucket_rows=4).awaitTermination()
    monkeypatch.undo()
    ingest_log(spark, landing, path, SCHEMA, ["k"], check, files=1, bucket_rows=4).awaitTermination()
    log = Log(spark, path, SCHEMA, ["k"])
    assert sorted(r.k for r in log.read().collect()) == sorted(f"k{i}" for i in range(45))
    assert log.commits().count() == 4 and log.clean() == 1


def test_a_batch_in_most_folders_reads_the_index_as_a_whole(spark, tmp_path):
    """Without a look at all its keys; a small batch still opens the folders of its own keys only."""
    log = Log(spark, str(tmp_path / "log"), "k long", ["k"], bucket_rows=4)
    keys = spark.range(400).withColumnRenamed("id", "k")
    assert log.append_unseen(keys, "a") == 400
    bits = log.last_commit().bits
    assert 1 << bits >= 64 and log._touched(keys, bits) is None
    few = spark.range(398, 401).withColumnRenamed("id", "k")
    assert 1 <= len(log._touched(few, bits)) <= 3
    assert [r.k for r in log.unseen(few).collect()] == [400]
    assert log.append_unseen(spark.range(450).withColumnRenamed("id", "k"), "b") == 50 and log.append_unseen(keys, "c") == 0
    assert sorted(r.k for r in log.read().collect()) == list(range(450))
