"""Quality rules: a threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.

Only built-in functions; no row leaves the JVM and nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rule; a text without lines has line ratio 0;
ratios with nothing below the line are 0 and the row has failed the base rule already. Rows that repeat are judged
alike. `judge` keeps every input column: its own are added under the names of MEASURES, its working column starts with
`__tm_`; an input column with the name of a measure is replaced. `keep` adds none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_or_empty, words_of

STOP_WORDS = (
    "the of and to a in that is was for with on be this are as it from or an by at not have "
    "der die das und ein eine zu von den im in ist mit auf nicht für sich des dem als auch es an bei "
    "le la de et les des un une du que en est qui dans pour pas sur au il ne ce se par plus sont "
    "el los las y del que en por con una no se su al lo para es más como"
).split()
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Keep rows with low <= numerator / denominator <= high."""

    name: str
    numerator: str
    denominator: str
    low: float = 0.0
    high: float = float("inf")


#: The threshold table of production.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "word_chars", high=0.06),
    Rule("exclamations", "bangs", "n_words", high=0.5),
    Rule("stop_words", "stops", "n_words", low=0.04),
    Rule("repeated_lines", "n_dup_lines", "lines", high=0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it and wherever Catalyst moves the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    The windows are sorted with their places; those equal to a neighbour are repeated; their places, sorted, each
    cover up to the next place or three words: n log n for any text.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    none = F.array().cast("array<struct<g:string,i:int>>")
    equal = lambda x, y: y["g"].eqNullSafe(x["g"])
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _let(F.sort_array(F.when(F.size(w) >= 3, grams).otherwise(none)), lambda s: _let(places(s), covered))


def measures(text: Column) -> Column:
    """A struct of MEASURES (long) and the working counts of RULES, of one text."""

    def of(t: Column, w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("lines"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("bangs"),
            F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?"))).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("stops"),
        )

    lines_of = lambda t: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return _let(text_or_empty(text), lambda t: _let(words_of(t), lambda w: _let(lines_of(t), lambda ls: of(t, w, ls))))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over a struct of measures()."""
    out = F.lit(True)
    for r in rules:
        ratio = F.coalesce(F.try_divide(m[r.numerator].cast("double"), m[r.denominator]), F.lit(0.0))
        out = out & (ratio >= F.lit(r.low)) & (ratio <= F.lit(r.high))
    return out


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of MEASURES, base_failed and kept."""

    def of(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    return _let(measures(text), of)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with MEASURES, `base_failed` and `kept`; an input column of one of these names is replaced."""
    df = docs.withColumn("__tm_q", judgement(F.col(text), rules))
    return df.withColumns({c: F.col("__tm_q")[c] for c in [*MEASURES, "base_failed", "kept"]}).drop("__tm_q")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Rows of docs that pass, with docs' columns only (a clashing input column keeps its values)."""
    return docs.filter(judgement(F.col(text), rules)["kept"])


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", *MEASURES, "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i+2], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), p AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1
), c AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(replace(t, '!', '')) AS bangs,
         len(list_filter(ws, lambda x: lower(trim(x, '.,;:!?')) IN (@STOPS@))) AS stops
  FROM w LEFT JOIN c USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 14.0
        AND n_symbols::DOUBLE / word_chars <= 0.06 AND bangs::DOUBLE / n_words <= 0.5 AND stops::DOUBLE / n_words >= 0.04
        AND n_dup_lines::DOUBLE / n_lines <= 0.5) AS kept
FROM m
""".replace("@STOPS@", ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS))))
