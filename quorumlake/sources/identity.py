"""Content identities: hashes over canonical text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(c: Column) -> Column:
    """A JSON string; the characters that stand in identifiers need no further escapes than these."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _or_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def cache_key(request: str = "request") -> Column:
    """SHA-256 of the request as JSON with sorted keys; links to items and templates are no part of it."""
    r = lambda name: F.col(f"{request}.{name}")
    d = lambda name: F.col(f"{request}.decoding.{name}")
    decoding = F.concat(F.lit('{"max_new_tokens": '), _or_null(d("max_new_tokens")), F.lit(', "seed": '), _or_null(d("seed")), F.lit(', "temperature": '), _or_null(d("temperature")), F.lit(', "top_p": '), _or_null(d("top_p")), F.lit("}"))
    whole = F.concat(
        F.lit('{"backend": '), _text(r("backend")), F.lit(', "decoding": '), decoding, F.lit(', "model_id": '), _text(r("model_id")),
        F.lit(', "model_revision": '), _text(r("model_revision")), F.lit(', "precision": '), _text(r("precision")),
        F.lit(', "rendered_prompt_hash": '), _text(r("rendered_prompt_hash")), F.lit(', "tokenizer_revision": '), _text(r("tokenizer_revision")), F.lit("}"),
    )
    return F.sha2(whole, 256)


def prompt_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def variant_id(item_id: Column, perturbation: Column, *parts: Column) -> Column:
    return F.concat_ws("::", item_id, perturbation, F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
