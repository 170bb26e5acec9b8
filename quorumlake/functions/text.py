"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quorumlake.functions.taxonomy import JUDGE_OUTCOMES, RULES


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Any of the patterns, case folded, with dots that match line ends."""
    return reduce(lambda a, b: a | b, (text.rlike("(?isU)" + p) for p in patterns))


def rule_outcome(text: Column, finish_reason: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Outcome of the first rule that matches; failed generations and blank texts never meet a rule."""
    rules = RULES if rules is None else rules
    body = strip(text)
    out = F.when(finish_reason == "error", "generation_error").when(text.isNull() | is_blank(text), "malformed")
    for outcome, patterns in rules.items():
        out = out.when(matches_any(body, patterns), outcome)
    return out.otherwise("neutral_or_no_position")


def judge_label(text: Column) -> Column:
    """The label that a judge's answer starts with, the longest first; null if none."""
    body = F.translate(F.ltrim(F.lower(strip(text)), F.lit("*`\"' -:")), "- ", "__")
    ordered = sorted(JUDGE_OUTCOMES, key=len, reverse=True)
    return reduce(lambda w, x: w.when(body.startswith(x), x), ordered[1:], F.when(body.startswith(ordered[0]), ordered[0]))


def judge_outcome(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in JUDGE_OUTCOMES.items() for x in pair])
    return F.coalesce(table[judge_label(text)], F.lit("malformed"))


def final_answer(text: Column, marker: str, required: Column | bool = True) -> Column:
    """What follows the last marker, stripped; without one '' where it is required, else the text."""
    required = F.lit(required) if isinstance(required, bool) else required
    return F.when(F.instr(text, marker) > 0, strip(F.substring_index(text, marker, -1))).when(required, F.lit("")).otherwise(text)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two texts share at their start, by bisection: log n comparisons of prefixes."""
    shortest = F.least(F.length(a), F.length(b))
    same = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        return F.struct(F.when(same(middle), middle).otherwise(acc["lo"]).alias("lo"), F.when(same(middle), acc["hi"]).otherwise(middle - 1).alias("hi"))

    start = F.struct(F.lit(0).cast("int").alias("lo"), shortest.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda acc: acc["lo"])


def render_arm(rendered: Column, mark: str) -> Column:
    """Whether a prompt went through a chat template (holds its mark) or raw."""
    return F.when(rendered.contains(mark), "native").otherwise("raw")


def template_parts(template: Column) -> tuple[Column, Column]:
    """Prompt and polarity of a template id ``prompt__polarity``."""
    parts = F.split(template, "__")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def true_false(text: Column) -> Column:
    """1 or 0 for true, false, 1 and 0 in any case; null for anything else."""
    body = F.lower(text.cast("string"))
    return F.when(body.isin("true", "1"), 1).when(body.isin("false", "0"), 0)


def without_start(text: Column, start: str) -> Column:
    return F.when(F.startswith(text, F.lit(start)), F.substring(text, F.lit(len(start) + 1), F.length(text))).otherwise(text)


def without_seed(name: Column) -> Column:
    """A trained variant's name without its seed."""
    return F.regexp_replace(name, r"_seed\d+$", "")


def replaced(text: Column, names: dict[str, str]) -> Column:
    """Each key replaced by its value, one after the other."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), names.items(), text)


def filled(template: str, **parts: Column) -> Column:
    """A template with {names} filled in; text that is filled in is not looked at again."""
    out, rest = [], template
    while rest:
        found = [(rest.index("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest]
        at, key = min(found) if found else (len(rest), None)
        out.append(F.lit(rest[:at]))
        if key is not None:
            out.append(parts[key])
        rest = rest[at + len(key) + 2 :] if key is not None else ""
    return F.concat(*out)


def first_words(text: Column, n: int) -> Column:
    """The first n words; the stand-in for a cut after n tokens."""
    return F.array_join(F.slice(F.split(strip(text), r"\s+"), 1, n), " ")


def joined_prompt(prefix: Column, joiner: Column, statement: Column) -> Column:
    return F.when(joiner == " ", F.trim(F.concat(prefix, joiner, statement))).otherwise(F.concat(prefix, joiner, statement))


POWER_LIMITS = {"current": "Current Power Limit", "default": "Default Power Limit", "min": "Min Power Limit", "max": "Max Power Limit"}  # fixed values: labels of the report


def power_limits(report: Column) -> Column:
    """Watts of a card's limits (current, default, min, max) from the first block of readings of a power report, or from the whole text
    where it has no such block; a limit that isn't given in watts is null."""
    first = F.nullif(F.regexp_extract(report, r"(?s)GPU Power Readings(.*?)(?:Power Samples|Module Power Readings)", 1), F.lit(""))
    watts = lambda label: F.regexp_extract(F.coalesce(first, report), label + r"\s*:\s*([0-9.]+)\s*W", 1).try_cast("double")
    return F.struct(*[watts(label).alias(name) for name, label in POWER_LIMITS.items()])
