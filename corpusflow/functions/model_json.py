"""JSON-1..3: model answers and stored references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.rows import bind
from corpusflow.schemas import REFERENCES
from corpusflow.settings import MIN_CLAIM_CHARS


def outer_object(raw: Column) -> Column:
    """JSON-1: from the first { to the last }, null when there is no such span."""
    return bind(F.regexp_extract(raw, r"(?s)\{.*\}", 0), lambda o: F.when(o != "", o))


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _string_field(item: Column, snake: str, camel: str) -> Column:
    """Value under the snake key, else the camel key; anything but a string counts as ''."""
    chosen = F.coalesce(F.variant_get(item, f"$.{snake}", "variant"), F.variant_get(item, f"$.{camel}", "variant"))
    return bind(chosen, lambda v: F.when(_is_string(v), F.variant_get(v, "$", "string")).otherwise(F.lit("")))


def _pairs(items: Column) -> Column:
    pairs = F.transform(items, lambda i: F.struct(
        _string_field(i, "statement_a", "statementA").alias("statement_a"),
        _string_field(i, "statement_b", "statementB").alias("statement_b"),
        _string_field(i, "explanation", "explanation").alias("explanation")))
    return F.filter(pairs, lambda p: ~tx.is_blank(p["statement_a"]) & ~tx.is_blank(p["statement_b"]))


def _claims(claims: Column) -> Column:
    texts = F.transform(claims, lambda c: F.when(
        _is_string(c), F.regexp_replace(F.variant_get(c, "$", "string"), r"(?U)^\s+|\s+$", "")))
    kept = F.filter(texts, lambda t: t.isNotNull() & (F.length(t) >= MIN_CLAIM_CHARS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def parse_analysis(raw: Column) -> Column:
    """JSON-2: struct(summary, contradictions[], key_claims[]), null when the text is not of
    that shape.  The text is parsed once and each part of it is taken once; a part that is
    not an array gives null under try_variant_get."""
    def parts(v: Column) -> Column:
        claims = F.coalesce(F.variant_get(v, "$.key_claims", "variant"), F.variant_get(v, "$.keyClaims", "variant"))
        return F.struct(
            F.variant_get(v, "$.summary", "variant").alias("summary"),
            F.try_variant_get(v, "$.contradictions", "array<variant>").alias("items"),
            F.try_variant_get(claims, "$", "array<variant>").alias("claims"))

    def shaped(p: Column) -> Column:
        return F.when(_is_string(p["summary"]) & p["items"].isNotNull(), F.struct(
            F.variant_get(p["summary"], "$", "string").alias("summary"),
            _pairs(p["items"]).alias("contradictions"), _claims(p["claims"]).alias("key_claims")))

    return bind(F.try_parse_json(outer_object(raw)), lambda v: bind(parts(v), shaped))


def encode_references(refs: Column) -> Column:
    """JSON-3: array of references to text."""
    return F.coalesce(F.to_json(refs), F.lit("[]"))


def decode_references(text: Column) -> Column:
    """JSON-3: text to array of references; malformed text is an empty array."""
    none = F.array().cast(REFERENCES)
    return bind(F.from_json(text, REFERENCES), lambda refs: F.when(
        refs.isNull() | F.exists(refs, lambda r: r.isNull()), none).otherwise(refs))
