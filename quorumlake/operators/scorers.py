"""Scorers: columns for rules, batches for models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quorumlake.functions.text import filled, first_words, is_blank, rule_outcome


class Scorer(Protocol):
    evaluator_id: str
    version: str

    def score(self, records: DataFrame) -> DataFrame: ...


class RuleScorer:
    """The pattern packs as one expression; confidence is null."""

    evaluator_id, version = "rule_stance", "1"

    def score(self, records: DataFrame) -> DataFrame:
        return records.select(F.col("cache_key").alias("generation_cache_key"), F.lit(self.evaluator_id).alias("evaluator_id"), F.lit(self.version).alias("evaluator_version"), rule_outcome(F.col("raw_text"), F.col("finish_reason")).alias("outcome"), F.lit(None).cast("double").alias("confidence"))


class BatchScorer:
    """A model behind ``load() -> (texts -> [(label, confidence)])``, loaded once a task; it never sees failed or blank rows.

    Equal texts are scored once and joined back by their digest.
    """

    def __init__(self, evaluator_id: str, version: str, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], outcomes: dict[str, str]):
        self.evaluator_id, self.version, self.load, self.outcomes = evaluator_id, version, load, outcomes

    def score(self, records: DataFrame) -> DataFrame:
        load, outcomes = self.load, self.outcomes
        failed = F.when(F.col("finish_reason") == "error", "generation_error").when(F.col("raw_text").isNull() | is_blank(F.col("raw_text")), "malformed")
        rows = records.select("cache_key", "raw_text", failed.alias("failed"), F.sha2("raw_text", 256).alias("digest"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                found = model(pdf["raw_text"].tolist())
                yield pd.DataFrame({"digest": pdf["digest"], "native_label": [x for x, _ in found], "confidence": [float(c) for _, c in found], "outcome": [outcomes.get(x, "malformed") for x, _ in found]})

        scored = rows.filter("failed IS NULL").select("digest", "raw_text").dropDuplicates(["digest"]).mapInPandas(run, "digest string, native_label string, confidence double, outcome string")
        out = rows.join(scored, "digest", "left")
        return out.select(F.col("cache_key").alias("generation_cache_key"), F.lit(self.evaluator_id).alias("evaluator_id"), F.lit(self.version).alias("evaluator_version"), F.coalesce("failed", "outcome").alias("outcome"), F.when(F.col("failed").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("failed").isNull(), F.col("native_label")).alias("native_label"))


class PairScorer:
    """A model of two texts, behind ``load() -> (premises, hypotheses -> [{label: probability}])``: the likeliest label decides,
    and notes keep all probabilities with four digits. Equal pairs are scored once."""

    def __init__(self, evaluator_id: str, version: str, load: Callable[[], Callable[[list[str], list[str]], list[dict[str, float]]]], outcomes: dict[str, str]):
        self.evaluator_id, self.version, self.load, self.outcomes = evaluator_id, version, load, outcomes

    def score(self, records: DataFrame, premise: str = "raw_text", hypothesis: str = "statement") -> DataFrame:
        load, outcomes = self.load, self.outcomes
        rows = records.select("cache_key", F.col(premise).alias("premise"), F.col(hypothesis).alias("hypothesis")).withColumn("digest", F.sha2(F.to_json(F.struct("premise", "hypothesis")), 256))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                found = model(pdf["premise"].tolist(), pdf["hypothesis"].tolist())
                top = [max(p, key=p.__getitem__) for p in found]
                yield pd.DataFrame({"digest": pdf["digest"], "native_label": top, "confidence": [p[t] for p, t in zip(found, top, strict=True)], "outcome": [outcomes[t] for t in top], "notes": [json.dumps({k: round(v, 4) for k, v in p.items()}) for p in found]})

        scored = rows.select("digest", "premise", "hypothesis").dropDuplicates(["digest"]).mapInPandas(run, "digest string, native_label string, confidence double, outcome string, notes string")
        return rows.join(scored, "digest").select(F.col("cache_key").alias("generation_cache_key"), F.lit(self.evaluator_id).alias("evaluator_id"), F.lit(self.version).alias("evaluator_version"), "outcome", "confidence", "native_label", "notes")


def judge_requests(records: DataFrame, template: str) -> DataFrame:
    """(cache_key, prompt, request_key) of the responses that can be judged; equal questions and answers share a request."""
    able = F.col("error").isNull() & ~F.coalesce(is_blank(F.col("raw_text")), F.lit(True))
    asked = records.filter(able).select("cache_key", filled(template, q=F.col("statement"), y=F.col("raw_text")).alias("prompt"))
    return asked.withColumn("request_key", F.sha2("prompt", 256))


def cut_tokens(records: DataFrame, load: Callable[[], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[int]], str]]], limit: int = 200) -> DataFrame:
    """``records`` as a budget of ``limit`` tokens would have left them: texts of more tokens are the first ones decoded again and
    end by 'length'. ``load() -> (texts -> token ids, ids -> text)`` is called once a task; equal texts are cut once. Failed and
    blank rows stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = load()
        for pdf in batches:
            ids = encode(pdf["raw_text"].tolist())
            cut = [len(x) > limit for x in ids]
            yield pd.DataFrame({"_digest": pdf["_digest"], "_cut": [decode(x[:limit]) if c else None for x, c in zip(ids, cut, strict=True)], "_tokens": [min(len(x), limit) for x in ids]})

    able = (F.col("finish_reason") != "error") & ~F.coalesce(is_blank(F.col("raw_text")), F.lit(True))
    rows = records.withColumn("_digest", F.when(able, F.sha2("raw_text", 256)))
    cut = rows.filter("_digest IS NOT NULL").select("_digest", "raw_text").dropDuplicates(["_digest"]).mapInPandas(run, "_digest string, _cut string, _tokens int")
    new = {"raw_text": F.coalesce("_cut", "raw_text"), "finish_reason": F.when(F.col("_cut").isNotNull(), "length").otherwise(F.col("finish_reason")), "output_tokens": F.coalesce("_tokens", "output_tokens")}
    return rows.join(cut, "_digest", "left").withColumns(new).select(records.columns)


class Backend(Protocol):
    """A generator: requests (request_key, prompt) to records by key; rows may come back in any order."""

    def generate(self, requests: DataFrame) -> DataFrame: ...


class EchoBackend:
    """A backend for tests: the prompt's first words come back."""

    def generate(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_key", first_words(F.col("prompt"), 3).alias("raw_text"), F.lit("stop").alias("finish_reason"))


def generate_missing(backend: Backend, requests: DataFrame, known: DataFrame) -> DataFrame:
    """Records of the requests that the store doesn't have, each request once; results are tied to requests by key."""
    return backend.generate(requests.select("request_key", "prompt").dropDuplicates(["request_key"]).join(known.select("request_key"), "request_key", "left_anti"))
