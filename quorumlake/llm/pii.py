"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence, in DataFrame functions only.

What a term discloses of an entity is measured by the information that the entity still has once the term is known,
-log2 P(entity | term): of the documents that hold the term, those in which it stands by the entity, with one unseen
document added. Documents with equal texts are one. Terms that leave ``RESIDUAL`` bits or less become spans of their own:
in two documents of two they do, in one of one they leave a whole bit and don't.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.llm.fingerprints import bind
from quorumlake.runtime import broadcast_if_small, discard, materialize

KINDS = ("email", "ip", "card", "phone")
# Leftmost, non-overlapping, as the plain patterns find them; look-behinds and possessive loops keep long runs linear
# and off the stack. \G lets a match begin where the one before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
RESIDUAL, MIN_LETTERS = 0.75, 2
NEAR = 120  # characters on each side of an entity, across lines, that are its context
BLOCK = 64
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digit = lambda d, i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    backwards = F.reverse(_digits(x))
    total = F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(backwards, i))).otherwise(digit(backwards, i)))
    return total % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(_digits(x)).between(13, 19), _luhn(x)).otherwise(False)
    return F.length(_digits(x)).between(9, 15) if kind == "phone" else F.lit(True)


def running(values: Column, op, depth: int = 2) -> Column:  # noqa: ANN001
    """Sums (or maxima, by ``op``) of each value of an array of longs and all before it. Short blocks are folded and what
    they amount to is carried on level by level, as a fold over the whole array would copy it for every value."""
    none = F.array().cast("array<bigint>")

    def fold(x: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            total = F.when(F.size(acc) == 0, v).otherwise(op(F.element_at(acc, -1), v))
            return F.concat(acc, F.array(total))

        return F.aggregate(x, none, step)

    if not depth:
        return fold(values)

    def by_parts(values: Column) -> Column:
        # taken one by one: a slice would walk the whole array
        parts = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), lambda i: fold(F.transform(F.sequence(i, F.least(i + BLOCK, F.size(values)) - 1), lambda j: F.get(values, j))))
        return F.when(F.size(values) == 0, none).otherwise(bind(parts, carried))

    def carried(parts: Column) -> Column:
        tops = running(F.transform(parts, lambda x: F.element_at(x, -1)), op, depth - 1)
        return bind(tops, lambda t: F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(v, F.get(t, i - 1)))))))

    return bind(values, by_parts)


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches by code points: the lengths of the matches and of what lies between them, summed up."""

    def placed(between: Column, found: Column) -> Column:
        steps = F.zip_with(between, found, lambda b, m: (F.coalesce(F.length(b), F.lit(0)) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        before = lambda x: F.when(F.length(x) > NEAR, F.regexp_replace(F.right(x, F.lit(NEAR)), r"^\p{L}+", "")).otherwise(x)
        after = lambda x: F.when(F.length(x) > NEAR, F.regexp_replace(F.left(x, F.lit(NEAR)), r"\p{L}+$", "")).otherwise(x)

        def span(ends: Column, m: Column, i: Column) -> Column:
            near = F.concat_ws(" ", before(F.get(between, i)), after(F.get(between, i + 1)))
            return F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(m)).cast("long").alias("start"), F.get(ends, i).alias("end"), m.alias("text"), near.alias("near"))

        return bind(running(steps, lambda x, y: x + y), lambda ends: F.transform(found, lambda m, i: span(ends, m, i)))

    return bind(F.split(text, pattern, -1), lambda between: bind(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: placed(between, found)))


def pattern_spans(text: Column) -> Column:
    """All spans of the four kinds with their text and context, by kind, then start. Texts without a kind's sign never
    meet its pattern."""

    def valid(kind: str):  # noqa: ANN202
        return lambda s: _holds(kind, s["text"])

    parts = []
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        may = text.contains(SIGNS[kind]) if SIGNS[kind] else F.lit(True)
        may = may & text.rlike("[0-9]") if kind != "email" else may
        may = may & text.rlike(PATTERNS[kind])
        parts.append(F.when(may, F.filter(located(text, pattern, kind), valid(kind))).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,near:string>>")))
    return F.concat(*parts)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _terms(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda w: F.length(w) >= MIN_LETTERS))


def revealing(docs: DataFrame, residual: float = RESIDUAL) -> DataFrame | None:
    """(entity, term, together, n_term, left): the terms that leave ``residual`` bits of an entity or less; None without any
    term that stands by an entity in enough documents for that.

    ``docs`` holds _text and _found, the pattern spans. The context of an entity is what stands within ``NEAR`` characters
    of it, up to the next match of its kind. ``together`` counts the different texts in which the term is in a context of the
    entity, ``n_term`` those that hold the term, so neither copies nor repeats within a text change anything.

    No pair is made of a document's terms and entities, but of an entity and the few terms near it; every count is a partial
    aggregate before the shuffle, so neither an entity nor a term that a third of all rows hold is collected anywhere. Most
    terms are too frequent to reveal anything: 256 marks a term, set by the texts' hashes, are a lower bound of ``n_term``, and
    only terms that may pass by it are counted text by text.
    """
    key = F.xxhash64("_text")
    spotted = docs.select(key.alias("key"), F.explode("_found").alias("s")).select("key", F.lower("s.text").alias("entity"), F.explode(_terms(F.col("s.near"))).alias("term"))
    seen = spotted.groupBy("entity", "term", "key").agg(F.lit(1).alias("one"))
    least = 1 if residual >= 1 else 2  # one document leaves a bit at least
    often = materialize(seen.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= least), "often")
    if often.isEmpty():
        discard(often)
        return None
    most = F.floor(F.col("together") * 2.0**residual * (1 + 1e-12)) - 1  # that n_term may be
    wanted = often.groupBy("term").agg(F.max(most).alias("most"))
    held = docs.select(key.alias("key"), F.explode(_terms(F.col("_text"))).alias("term"))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(63).cast("int"))
    word = F.shiftright("key", 6).bitwiseAND(3)
    marks = held.join(broadcast_if_small(wanted, 70), "term").groupBy("term").agg(F.max("most").alias("most"), *[F.bit_or(F.when(word == k, mark).otherwise(0)).alias(f"_m{k}") for k in range(4)])
    few = materialize(marks.filter(reduce(add, [F.bit_count(f"_m{k}") for k in range(4)]) <= F.col("most")).select("term"), "few")
    frequency = held.join(broadcast_if_small(few, 60), "term", "left_semi").groupBy("term", "key").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_term"))
    left = -F.log2(F.col("together") / (F.col("n_term") + 1))
    found = materialize(often.join(frequency, "term").withColumn("left", left).filter(F.col("left") <= residual), "revealing")
    discard(often, few)
    return found


def sanitised(text: Column, spans: Column) -> Column:
    """Text with each span generalised to its kind in brackets; of overlapping spans the first stands for all.

    The text is cut into blocks first, so that a piece costs its own length and not its distance from the beginning."""
    size = 1024
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def put_together(blocks: Column, ordered: Column, reach: Column) -> Column:
        def piece(at: Column, to: Column) -> Column:
            first, last = F.floor(at / size).cast("int"), F.floor(to / size).cast("int")
            return F.when(to <= at, "").otherwise(F.substring(F.array_join(F.transform(F.sequence(first, last), lambda k: F.coalesce(F.get(blocks, k), F.lit(""))), ""), (at % size + 1).cast("int"), (to - at).cast("int")))

        def part(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(reach, i - 1))
            return F.when(s["start"] < before, F.lit("")).otherwise(F.concat(piece(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

        return F.concat(F.array_join(F.transform(ordered, part), ""), piece(F.element_at(reach, -1), F.length(text).cast("long")))

    whole = bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda blocks: bind(ordered, lambda o: bind(running(F.transform(o, lambda s: -s["end"]), F.greatest), lambda reach: put_together(blocks, o, reach))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", residual: float = RESIDUAL) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind, start, end), sanitised text.

    Null text counts as empty and has no spans. ``spans`` holds the base spans and those of revealing terms, kind
    ``term``, by kind and start; such a term is a span in every document that holds it. Repeated rows are rows of their
    own (equal texts are one document to the counts); an empty table gives an empty one; other columns are left out.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spotted = base.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_found", pattern_spans(F.col("_text")))
    spotted = materialize(spotted, "spans")  # once, ids and all
    strong = revealing(spotted, residual)
    more = F.array().cast(SPAN)
    if strong is not None:
        strong = broadcast_if_small(strong.select("term").distinct(), 60)
        terms = spotted.select("_rid", F.explode(_terms(F.col("_text"))).alias("term")).join(strong, "term").groupBy("_rid").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
        spotted = spotted.join(broadcast_if_small(materialize(terms, "terms"), 200), "_rid", "left")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
        more = F.when(F.col("_terms").isNull(), more).otherwise(_bare(located(F.col("_text"), pattern, "term")))
    out = spotted.select("doc_id", "_text", _bare(F.col("_found")).alias("base"), more.alias("more"))
    out = out.select("doc_id", "_text", "base", F.concat("base", "more").alias("spans"))
    return out.select("doc_id", "base", "spans", sanitised(F.col("_text"), F.col("spans")).alias("sanitised"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), "sanitised")
