"""Records that nest text deeper than the format projections look are made shallow, whatever their depth.

How deep a text nests is found by expressions; only deep ones pass through Python, in Arrow batches, the others as nulls.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys that text is read from, in order; part types without text.
TEXT_KEYS = ("text", "content", "value", "output_text", "input_text")
NO_TEXT = ("tool_use", "tool_call", "function_call", "image", "image_url", "input_image")

#: Paths and the nesting from which text below them may be out of reach of the projections.
LIMITS = {
    "openai": (("$", 7),),
    "anthropic": (("$", 7), ("$.system", 4), ("$.request.system", 4), ("$.content", 5)),
    "langfuse": (("$", 7), ("$.input", 4), ("$.output", 4)),
    "generic": (("$", 5),),
}
OTEL_DEPTH = 3
#: Keys under which a text, or a list of its parts, is looked for outside messages.
_SIDES = ("input", "prompt", "question", "output", "completion", "answer", "response", "system")


def is_deep(text: Column, depth: int) -> Column:
    """Whether JSON nests to this depth or more: strings go, then all but brackets, then the innermost pairs, depth - 1 times."""
    left = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    left = F.regexp_replace(left, r"[^\[\]{}]+", "")
    for _ in range(depth - 1):
        left = F.regexp_replace(left, r"\[\]|\{\}", "")
    return F.coalesce(left != "", F.lit(False))


def plain(value: Any) -> str:
    """The text of content of any shape and depth: its parts' texts, joined by newlines, empty ones left out."""
    found, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            key = next((k for k in TEXT_KEYS if k in v), None)
            if key and not (isinstance(v.get("type"), str) and v["type"] in NO_TEXT):
                todo.append(v[key])
        elif v is not None and v != "":
            found.append(str(v))
    return "\n".join(found)


def _part(v: Any) -> Any:
    """A part of content: an object keeps its keys and its texts become plain; a list is its text."""
    if isinstance(v, dict):
        return {k: plain(x) if k in (*TEXT_KEYS, "response", "result") and isinstance(x, (dict, list)) else x for k, x in v.items()}
    return plain(v) if isinstance(v, list) else v


def _content(v: Any) -> Any:
    return [_part(p) for p in v] if isinstance(v, list) else _part(v)


def flatten(root: Any) -> Any:
    """The document with the text of messages, parts and sides brought up to where the projections look."""
    todo = [root]
    own = root if isinstance(root, dict) else {}
    observations = own.get("observations")
    tops = [own, own.get("request"), *(observations if isinstance(observations, list) else [])]
    sided = {id(v) for v in tops}
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(v)
        elif isinstance(v, dict):
            for k, x in v.items():
                if not isinstance(x, (dict, list)):
                    continue
                chat = isinstance(x, list) and any(isinstance(m, dict) and ("role" in m or "parts" in m) for m in x)
                if k in ("content", "parts") or (k == "text" and "message" not in v) or (k in _SIDES and id(v) in sided and isinstance(x, list) and not chat):
                    v[k] = _content(x)
                else:
                    todo.append(x)
    return root


def _flat_text(text: str, strings: bool) -> str:
    try:
        doc = json.loads(text)
    except ValueError:
        return text
    if strings:
        doc = _unquoted(doc)
    if isinstance(doc, list) and not any(isinstance(m, dict) and {"role", "parts", "name", "attributes"} & m.keys() for m in doc):
        return json.dumps(_content(doc), ensure_ascii=False)
    return json.dumps(flatten(doc), ensure_ascii=False)


def _unquoted(v: Any) -> Any:
    """Bodies given as JSON in a string, made shallow and quoted again."""
    if isinstance(v, list):
        return [_unquoted(x) for x in v]
    if isinstance(v, dict):
        return {k: _unquoted(x) for k, x in v.items()}
    return _flat_text(v, False) if isinstance(v, str) and v[:1] in ("{", "[") else v


def _apply(texts: pd.Series, strings: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _flat_text(t, bool(s)) for t, s in zip(texts, strings, strict=True)], dtype=object)


_flat = F.pandas_udf(_apply, StringType())


def shallow_json(text: Column, depth: int, strings: bool = False) -> Column:
    """JSON text, flattened if it nests to depth or more; with strings, brackets inside strings count too."""
    deep = is_deep(text, depth)
    if strings:
        deep = deep | is_deep(F.regexp_replace(text, r'[\\\\"]', ""), depth)
    return F.coalesce(_flat(F.when(deep, text), F.lit(strings)), text)


def shallow(records: DataFrame, fmt: str) -> DataFrame:
    """records with rec flattened where it nests too deep for the format's projection; otel spans are treated by their parser."""
    if fmt not in LIMITS:
        return records
    rec = F.col("rec")
    tests = [is_deep(F.to_json(F.try_variant_get(rec, path, "variant")), depth) for path, depth in LIMITS[fmt]]
    deep = tests[0]
    for t in tests[1:]:
        deep = deep | t
    flat = F.parse_json(_flat(F.when(deep, F.to_json(rec)), F.lit(False)))
    return records.withColumn("rec", F.coalesce(flat, rec))
