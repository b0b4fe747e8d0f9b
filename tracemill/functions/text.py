"""Text keys, feedback, failure flags and conversation parts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the feedback vocabulary.
FEEDBACK_POSITIVE = ("up", "thumbs_up", "thumbsup", "positive", "good", "like", "liked", "yes", "true", "+1", "1", "helpful", "pass", "correct")
FEEDBACK_NEGATIVE = ("down", "thumbs_down", "thumbsdown", "negative", "bad", "dislike", "disliked", "no", "false", "-1", "0", "unhelpful", "fail", "incorrect", "wrong")
FEEDBACK_NEUTRAL = ("neutral", "meh", "mixed")


def normalize_text(s: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def text_hash(s: Column) -> Column:
    return F.sha2(normalize_text(F.coalesce(s, F.lit(""))), 256)


def feedback_of_number(x: Column) -> Column:
    """Thumbs (0..1, below 0) and ratings (1..5) as negative, neutral or positive; above 5 or no number: null."""
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (x > 5), F.lit(None).cast("string"))
        .when(x < 0.5, "negative")
        .when(x <= 1, "positive")
        .when(x <= 2, "negative")
        .when(x >= 4, "positive")
        .otherwise("neutral")
    )


def feedback_of_text(s: Column) -> Column:
    word = F.replace(F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), F.lit(" "), F.lit("_"))
    return (
        F.when(word.isin(*FEEDBACK_POSITIVE), "positive")
        .when(word.isin(*FEEDBACK_NEGATIVE), "negative")
        .when(word.isin(*FEEDBACK_NEUTRAL), "neutral")
        .otherwise(feedback_of_number(word.try_cast("double")))
    )


def feedback_of_variant(v: Column) -> Column:
    """Feedback of a VARIANT: boolean, number, text, or an object that has it under value, score, rating or label."""

    def scalar(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return (
            F.when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), "positive").otherwise("negative"))
            .when(kind == "STRING", feedback_of_text(F.try_variant_get(x, "$", "string")))
            .otherwise(feedback_of_number(F.try_variant_get(x, "$", "double")))
        )

    inner = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("value", "score", "rating", "label")])
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), scalar(inner)).otherwise(scalar(v))


def is_failure(error: Column, feedback: Column) -> Column:
    return F.coalesce(error, F.lit(False)) | F.coalesce(feedback == "negative", F.lit(False))


def failure_kind(error: Column, feedback: Column) -> Column:
    return F.concat_ws(" + ", F.when(error, "error flag"), F.when(feedback == "negative", "negative user feedback"))


def last_user(messages: Column) -> Column:
    """1-based place of the last user message, 0 if none."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(0))


def user_text(messages: Column, fallback: Column) -> Column:
    """All user turns joined by newlines, or the fallback if there is none."""
    turns = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.when(F.size(turns) > 0, F.array_join(turns, "\n")).otherwise(fallback)


def prior_turns(messages: Column) -> Column:
    """Messages before the last user message."""
    return F.slice(messages, 1, F.greatest(F.lit(0), last_user(messages) - 1))


def context_text(messages: Column) -> Column:
    """Turns as `role: content` paragraphs, or (none)."""
    lines = F.transform(messages, lambda m: F.concat_ws(": ", F.coalesce(m["role"], F.lit("user")), F.coalesce(m["content"], F.lit(""))))
    return F.when(F.size(messages) > 0, F.array_join(lines, "\n\n")).otherwise("(none)")


def safe_id(given: Column) -> Column:
    """Characters outside A-Za-z0-9_.:- become -, none at the ends, 80 at most; null if nothing is left."""
    cleaned = F.btrim(F.regexp_replace(given, r"[^A-Za-z0-9_.:-]+", "-"), F.lit("-"))
    return F.when(cleaned != "", F.substring(cleaned, 1, 80))


def csv_cell(s: Column, limit: int = 32_000) -> Column:
    """A spreadsheet cell: longer texts are cut with a notice (the whole text is in the sheet)."""
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit), F.lit(" [cut here; the full text is in label_sheet.html]")))


def tag_of(tags: Column, prefix: str, default: str) -> Column:
    """The first tag with a prefix."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), F.lit(default))
