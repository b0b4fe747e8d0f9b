"""Canonical labels of what judges and people answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of a JSON answer's keys, and labels that count as favourable.
VERDICT_KEYS = ("verdict", "label", "pass", "winner")
POSITIVE = ("pass", "yes", "true", "good", "correct", "acceptable", "1")
INVALID = "invalid"
_OPENING = r"(?i)^\W*(?:\[\[)?\s*"
_SIDE = r"(?:answer\s*|assistant\s*|response\s*)?"


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _number(x: Column) -> Column:
    """A number's text: without a fraction if it has none."""
    d = x.cast("double")
    return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_label(s: Column, mode: Column) -> Column:
    """Label of a plain answer: A, B, tie or invalid if pairwise; else its lower-cased text, numbers in one spelling."""

    def pair(t: Column) -> Column:
        return (
            F.when(t.rlike(rf"{_OPENING}(?:tie|c|equal|draw|both)\b"), "tie")
            .when(t.rlike(rf"{_OPENING}{_SIDE}a\b") | t.isin("1", "first"), "A")
            .when(t.rlike(rf"{_OPENING}{_SIDE}b\b") | t.isin("2", "second"), "B")
            .otherwise(INVALID)
        )

    def point(t: Column) -> Column:
        is_number = t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")
        return F.when(is_number, _number(t.try_cast("double"))).when(t == "", INVALID).otherwise(t)

    words = bind(F.btrim(F.lower(_strip(s)), F.lit(" .!\"'")), point)
    return F.when(mode == "pairwise", bind(_strip(s), pair)).otherwise(words)


def _first_key(v: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in VERDICT_KEYS])


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _answer(v: Column) -> Column:
    """struct<label, text> of a VARIANT that is no object: its label, or the text that a label is read from."""
    none = F.lit(None).cast("string")
    kind = F.schema_of_variant(v)
    fixed = (
        F.when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "pass").otherwise("fail"))
        .when(kind == "STRING", none)
        .when(F.try_variant_get(v, "$", "double").isNull(), INVALID)
        .otherwise(_number(F.try_variant_get(v, "$", "double")))
    )
    return F.struct(F.when(v.isNull(), INVALID).otherwise(fixed).alias("label"), F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"))


def _of_variant(v: Column) -> Column:
    """The same of any VARIANT: an object answers by its first key of VERDICT_KEYS, which may hold one more object."""
    inner = bind(v, lambda x: F.when(_is_object(x), _first_key(x)).otherwise(x))
    return bind(bind(inner, lambda x: F.when(_is_object(x), _first_key(x)).otherwise(x)), _answer)


def variant_label(v: Column, mode: Column) -> Column:
    """Label of a VARIANT answer."""
    return bind(_of_variant(v), lambda a: F.coalesce(a["label"], plain_label(a["text"], mode), F.lit(INVALID)))


def verdict_label(answer: Column, mode: Column) -> Column:
    """Label of an answer's text: a code fence is dropped, JSON is read by its verdict key, cut-off JSON by a pattern; null is invalid."""
    text = _strip(F.regexp_replace(_strip(answer), r"(?im)^```(?:json)?|```$", ""))
    none = F.lit(None).cast("string")

    def cut(t: Column) -> Column:
        field = F.regexp_extract(t, r'(?i)"(verdict|label|pass|winner)"\s*:\s*"?([A-Za-z0-9_]+)', 2)
        return bind(field, lambda f: F.struct(F.when(f == "", INVALID).when(F.lower(f) == "true", "pass").when(F.lower(f) == "false", "fail").alias("label"), f.alias("text")))

    def of(t: Column) -> Column:
        json = bind(F.try_parse_json(t), lambda v: F.when(v.isNull(), cut(t)).otherwise(_of_variant(v)))
        return F.when(t.startswith("{"), json).otherwise(F.struct(none.alias("label"), t.alias("text")))

    label = bind(bind(text, of), lambda a: F.coalesce(a["label"], plain_label(a["text"], mode)))
    return F.when(answer.isNull(), INVALID).otherwise(label)


def human_label(answer: Column, mode: Column) -> Column:
    """verdict_label, with model_a and model_b for A and B."""
    low = F.lower(answer)
    pair = F.when(low.isin("model_a", "a"), "A").when(low.isin("model_b", "b"), "B")
    return F.coalesce(F.when(mode == "pairwise", pair), verdict_label(answer, mode))


def unswap(label: Column) -> Column:
    return F.when(label == "A", "B").when(label == "B", "A").otherwise(label)


def moved_toward(label: Column, before: Column, mode: Column, pad_side: Column) -> Column:
    """Whether a verdict moved to the padded answer: to its side, or to a higher number, or from unfavourable to favourable."""
    pair = (label == pad_side) & ~before.eqNullSafe(pad_side)
    a, b = label.try_cast("double"), before.try_cast("double")
    words = label.isin(*POSITIVE) & ~F.coalesce(before.isin(*POSITIVE), F.lit(False))
    point = F.when(before.isNull(), F.lit(False)).when(a.isNotNull() & b.isNotNull(), a > b).otherwise(words)
    return F.coalesce(F.when(mode == "pairwise", pair).otherwise(point), F.lit(False))
