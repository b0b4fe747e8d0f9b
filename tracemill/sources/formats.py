"""Log formats as projections of VARIANT records to one trace schema.

Each parser takes records (file, index, rec) and returns TRACE_COLUMNS; a row with skip_reason is no trace. Content of
unknown shape is flattened to DEPTH levels by expressions; records that nest deeper are first made shallow (nesting.py),
so no text is lost at any depth. Only OpenTelemetry spans are grouped (by trace id); the other formats are narrow
projections without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nesting
from ..functions import text
from ..functions.verdicts import bind
from ..operators.traces import complete, skip_reason, trace_parts

TRACE_COLUMNS = ["id", "input", "output", "messages", "system", "tools", "error", "feedback", "route", "model", "metadata", "source", "skip_reason"]
DEPTH = 3
#: Keys that text, feedback, errors and routes are read from, in order; part types without text; reserved keys.
TEXT_KEYS = nesting.TEXT_KEYS
PLAIN_KEYS = ("input", "query", "question", "prompt", "text", "content", "message", "output", "answer", "completion", "response", "result")
NO_TEXT = nesting.NO_TEXT
FEEDBACK_KEYS = ("feedback", "user_feedback", "thumbs", "rating", "user_rating", "vote")
ERROR_KEYS = ("error", "is_error", "failed", "exception")
ROUTE_KEYS = ("route", "endpoint", "path", "feature", "workflow", "task", "intent")
RESERVED = ("messages", "request", "response", "choices", "metadata", "id", "model", "usage", "object", "created", "system_fingerprint", "tools")
OTEL_KEYS = ("route", "endpoint", "feature", "feedback", "user_feedback", "rating", "intent")

MESSAGES = "array<struct<role:string,content:string,tools:array<string>>>"


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, a number's type, or '' for a missing key."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), r"^\w*", 0)


def as_text(v: Column) -> Column:
    """A scalar's text."""
    return F.when(kind(v) == "BOOLEAN", F.initcap(get(v, "$", "string"))).otherwise(get(v, "$", "string"))


def text_of(v: Column, depth: int = DEPTH) -> Column:
    """Text of message content: a string, a list of parts (joined by newlines), or an object with one of TEXT_KEYS; '' for others."""

    def of(x: Column) -> Column:
        k = kind(x)
        if depth == 0:
            return F.when(k.isin("OBJECT", "ARRAY", "VOID", ""), "").otherwise(as_text(x))
        parts = F.filter(F.transform(get(x, "$", "array<variant>"), lambda p: text_of(p, depth - 1)), lambda p: p != "")
        inner = F.coalesce(*[get(x, f"$.{key}") for key in TEXT_KEYS])
        silent = F.coalesce(get(x, "$.type", "string").isin(*NO_TEXT), F.lit(False))
        return (
            F.when(k == "ARRAY", F.array_join(parts, "\n"))
            .when(k == "OBJECT", F.when(silent, "").otherwise(F.coalesce(text_of(inner, depth - 1), F.lit(""))))
            .when(k.isin("VOID", ""), "")
            .otherwise(as_text(x))
        )

    return bind(v, of)


def _none() -> Column:
    return F.array().cast("array<string>")


def tool_names(m: Column) -> Column:
    """Tools called by a chat message: tool_calls and function_call."""
    calls = F.transform(F.coalesce(get(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(F.nullif(get(c, "$.function.name", "string"), F.lit("")), get(c, "$.name", "string")))
    return F.filter(F.concat(calls, F.array(get(m, "$.function_call.name", "string"))), lambda n: F.coalesce(n != "", F.lit(False)))


def message(m: Column) -> Column:
    return F.struct(F.coalesce(get(m, "$.role", "string"), F.lit("user")).alias("role"), text_of(get(m, "$.content")).alias("content"), tool_names(m).alias("tools"))


def said(role: str, content: Column, tools: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (_none() if tools is None else tools).alias("tools"))


def _objects(vs: Column) -> Column:
    return F.filter(F.coalesce(vs, F.array().cast("array<variant>")), lambda m: kind(m) == "OBJECT")


def loose_messages(v: Column, role: str, depth: int = 1) -> Column:
    """Messages of an input or output of any shape: a list of messages, an object that holds one, or a text."""

    def of(x: Column) -> Column:
        empty = F.array().cast(MESSAGES)
        many = get(x, "$", "array<variant>")
        chat = (F.size(many) > 0) & F.forall(many, lambda m: get(m, "$.role").isNotNull())
        plain = F.coalesce(*[F.when(kind(get(x, f"$.{k}")) == "STRING", get(x, f"$.{k}", "string")) for k in PLAIN_KEYS], F.to_json(x))
        choice = get(x, "$.choices[0].message")
        nested = loose_messages(get(x, "$.messages"), role, depth - 1) if depth else empty
        obj = (
            F.when(kind(get(x, "$.messages")) == "ARRAY", nested)
            .when(get(x, "$.role").isNotNull() & get(x, "$.content").isNotNull(), F.array(message(x)))
            .when(kind(choice) == "OBJECT", F.array(message(choice)))
            .otherwise(F.array(said(role, plain)))
        )
        return (
            F.when(kind(x).isin("", "VOID"), empty)
            .when(F.coalesce(chat, F.lit(False)), F.transform(many, message))
            .when(kind(x) == "OBJECT", obj)
            .otherwise(F.array(said(role, text_of(x))))
        )

    return bind(v, of)


def scalars(v: Column, without: tuple[str, ...] = ()) -> Column:
    """Scalar entries of an object as map<string, string>; a flat list is its JSON. Nested values and nulls are left out."""
    m = F.coalesce(get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    flat = lambda x: ~kind(x).isin("OBJECT", "ARRAY", "VOID", "") | ((kind(x) == "ARRAY") & F.forall(get(x, "$", "array<variant>"), lambda y: ~kind(y).isin("OBJECT", "ARRAY", "VOID")))
    kept = F.map_filter(m, lambda k, x: ~k.isin("", *without) & F.coalesce(flat(x), F.lit(False)))
    return F.transform_values(kept, lambda _, x: F.when(kind(x) == "ARRAY", F.to_json(x)).otherwise(as_text(x)))


def merged(*maps: Column) -> Column:
    """Maps joined, the later one's values winning."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))


def _finish(df: DataFrame, fmt: str, keep_blank: bool = False) -> DataFrame:
    """From file, index, given, turns, system, tools, metadata, error, feedback, route, model, reason to TRACE_COLUMNS.

    Error, feedback, route and model are filled from the metadata where the format has none.
    """
    parts = trace_parts(F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    joined = F.array_join(F.filter(F.array(F.col("system"), F.col("__s")), lambda s: F.coalesce(s != "", F.lit(False))), "\n\n")
    df = df.withColumns({"messages": parts["messages"], "__s": parts["system"]}).withColumn("system", F.nullif(joined, F.lit("")))
    df = complete(df)
    md = lambda k: F.try_element_at("metadata", F.lit(k))
    error = F.greatest(*[F.coalesce(~md(k).isin("", "0", "0.0", "false", "False", "none", "None"), F.lit(False)) for k in ERROR_KEYS], F.coalesce(F.lower(md("status")).isin("error", "failed", "failure"), F.lit(False)))
    feedback = F.coalesce("feedback", *[text.feedback_of_text(md(k)) for k in FEEDBACK_KEYS])
    route = F.coalesce("route", *[F.nullif(md(k), F.lit("")) for k in ROUTE_KEYS])
    tools = F.array_sort(F.array_distinct(F.concat("tools", F.flatten(F.transform("turns", lambda m: F.coalesce(m["tools"], _none()))))))
    made = F.concat(F.lit("t-"), F.substring(F.sha1(F.to_json(F.struct(F.lit(fmt), "file", "index", "input", "output"))), 1, 12))
    reason = F.col("reason") if keep_blank else F.coalesce("reason", skip_reason(F.col("input"), F.col("output")))
    return df.select(
        F.coalesce(text.safe_id(F.col("given")), made).alias("id"), "input", "output", "messages", "system", tools.alias("tools"), (F.coalesce("error", F.lit(False)) | error).alias("error"),
        feedback.alias("feedback"), route.alias("route"), F.coalesce("model", md("model")).alias("model"), "metadata",
        F.struct(F.lit(fmt).alias("format"), "file", "index").alias("source"), reason.alias("skip_reason"),
    )


def _null() -> Column:
    return F.lit(None).cast("string")


def _truthy(v: Column) -> Column:
    return F.coalesce(~kind(v).isin("VOID", "") & ~F.coalesce(get(v, "$", "string"), F.lit("x")).isin("", "false", "0"), F.lit(False))


def parse_openai(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    sub = lambda k: F.when(kind(get(rec, f"$.{k}")) == "OBJECT", get(rec, f"$.{k}")).otherwise(rec)
    df = records.withColumns({"req": sub("request"), "resp": sub("response")})
    choice = get(F.col("resp"), "$.choices[0]")
    own = get(choice, "$.message")
    final = F.when(kind(own) == "OBJECT", F.array(message(own))).when(kind(choice) == "OBJECT", F.array(said("assistant", text_of(get(choice, "$.text")))))
    none = F.array().cast(MESSAGES)
    turns = F.concat(F.transform(_objects(get(F.col("req"), "$.messages", "array<variant>")), message), F.coalesce(final, none))
    df = df.withColumn("turns", turns)
    return _finish(df.select(
        "file", "index", get(rec, "$.id", "string").alias("given"), "turns", _null().alias("system"), _none().alias("tools"),
        merged(scalars(get(rec, "$.metadata")), scalars(rec, RESERVED)).alias("metadata"), (_truthy(get(rec, "$.error")) | _truthy(get(F.col("resp"), "$.error"))).alias("error"), _null().alias("feedback"), _null().alias("route"),
        F.coalesce(get(rec, "$.model", "string"), get(F.col("req"), "$.model", "string"), get(F.col("resp"), "$.model", "string")).alias("model"),
        F.when(F.size("turns") == 0, "no messages").alias("reason"),
    ), "openai")


def _blocks(m: Column) -> Column:
    """A message with content blocks: texts and tool results are its text, tool uses its tools; a user turn of results only is the tool's."""
    role = F.coalesce(get(m, "$.role", "string"), F.lit("user"))
    blocks = get(m, "$.content", "array<variant>")
    typ = lambda b: F.coalesce(get(b, "$.type", "string"), F.lit("text"))
    piece = lambda b: F.when(kind(b) != "OBJECT", as_text(b)).when(typ(b) == "tool_result", text_of(get(b, "$.content"))).when(typ(b) == "text", text_of(b)).otherwise("")
    content = F.array_join(F.filter(F.transform(blocks, piece), lambda p: p != ""), "\n")
    uses = F.filter(F.transform(blocks, lambda b: F.when(typ(b) == "tool_use", get(b, "$.name", "string"))), lambda n: F.coalesce(n != "", F.lit(False)))
    results = (F.size(blocks) > 0) & F.forall(blocks, lambda b: (kind(b) == "OBJECT") & typ(b).isin("tool_use", "tool_result"))
    listed = F.struct(F.when((role == "user") & results, "tool").otherwise(role).alias("role"), content.alias("content"), uses.alias("tools"))
    return F.when(blocks.isNotNull(), listed).otherwise(F.struct(role.alias("role"), text_of(get(m, "$.content")).alias("content"), _none().alias("tools")))


def parse_anthropic(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    req = F.when(kind(get(rec, "$.request")) == "OBJECT", get(rec, "$.request")).otherwise(rec)
    resp = F.when(kind(get(rec, "$.response")) == "OBJECT", get(rec, "$.response")).when((get(rec, "$.type", "string") == "message") & (kind(get(rec, "$.request")) == "OBJECT"), rec)
    df = records.withColumns({"req": req, "resp": resp})
    answer = F.struct(F.lit("assistant").alias("role"), *[_blocks(F.col("resp"))[c].alias(c) for c in ("content", "tools")])
    none = F.array().cast(MESSAGES)
    turns = F.concat(F.transform(_objects(get(F.col("req"), "$.messages", "array<variant>")), _blocks), F.when(kind(get(F.col("resp"), "$.content")) == "ARRAY", F.array(answer)).otherwise(none))
    stop = get(F.col("resp"), "$.stop_reason", "string")
    md = merged(scalars(get(rec, "$.metadata")), scalars(rec, (*RESERVED, "system", "type", "content", "stop_reason")), F.when(stop != "", F.create_map(F.lit("stop_reason"), stop)).otherwise(F.create_map().cast("map<string,string>")))
    df = df.withColumn("turns", turns)
    return _finish(df.select(
        "file", "index", F.coalesce(get(rec, "$.id", "string"), get(F.col("resp"), "$.id", "string")).alias("given"), "turns", text_of(get(F.col("req"), "$.system")).alias("system"), _none().alias("tools"), md.alias("metadata"),
        (_truthy(get(rec, "$.error")) | F.coalesce(get(F.col("resp"), "$.type", "string") == "error", F.lit(False))).alias("error"), _null().alias("feedback"), _null().alias("route"),
        F.coalesce(get(F.col("req"), "$.model", "string"), get(F.col("resp"), "$.model", "string")).alias("model"), F.when(F.size("turns") == 0, "no messages").alias("reason"),
    ), "anthropic")


def parse_langfuse(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    obs = _objects(get(rec, "$.observations", "array<variant>"))
    typed = lambda t: F.filter(F.col("obs"), lambda o: F.coalesce(get(o, "$.type", "string") == t, F.lit(False)))
    df = records.withColumn("obs", obs).withColumn("gens", typed("GENERATION"))
    starts = F.transform("gens", lambda o, i: F.struct(F.coalesce(get(o, "$.startTime", "string"), F.lit("")).alias("t"), i.alias("i")))
    df = df.withColumn("last", F.get("gens", F.array_max(starts)["i"]))
    side = lambda k: F.when(kind(get(rec, f"$.{k}")).isin("", "VOID"), get(F.col("last"), f"$.{k}")).otherwise(get(rec, f"$.{k}"))
    df = df.withColumns({"asked": loose_messages(side("input"), "user"), "told": loose_messages(side("output"), "assistant")})
    final = F.try_element_at("told", F.lit(-1))
    df = df.withColumn("turns", F.concat("asked", F.when(F.size("told") > 0, F.array(F.struct(F.lit("assistant").alias("role"), final["content"].alias("content"), final["tools"].alias("tools")))).otherwise(F.array().cast(MESSAGES))))
    names = F.transform(typed("TOOL"), lambda o: get(o, "$.name", "string"))
    called = F.flatten(F.flatten(F.transform("gens", lambda o: F.transform(loose_messages(get(o, "$.output"), "assistant"), lambda m: m["tools"]))))
    tools = F.filter(F.concat(names, called), lambda n: F.coalesce(n != "", F.lit(False)))
    level = lambda v: F.coalesce(F.upper(get(v, "$.level", "string")) == "ERROR", F.lit(False))
    score_name = lambda s: F.translate(F.lower(F.coalesce(get(s, "$.name", "string"), F.lit(""))), "- ", "__")
    value = lambda s: F.coalesce(get(s, "$.value"), get(s, "$.stringValue"))
    scores = _objects(get(rec, "$.scores", "array<variant>"))
    is_feedback = lambda s: score_name(s).isin(*FEEDBACK_KEYS) | score_name(s).contains("feedback") | score_name(s).contains("thumb")
    feedback = F.get(F.filter(F.transform(F.filter(scores, is_feedback), lambda s: text.feedback_of_variant(value(s))), lambda x: x.isNotNull()), F.lit(0))
    rest = F.map_from_entries(F.array_distinct(F.transform(F.filter(scores, lambda s: ~is_feedback(s)), lambda s: F.struct(F.concat(F.lit("scores."), F.coalesce(get(s, "$.name", "string"), F.lit("score"))), as_text(value(s))))))
    tags = F.when(kind(get(rec, "$.tags")) == "ARRAY", F.create_map(F.lit("tags"), F.to_json(get(rec, "$.tags")))).otherwise(F.create_map().cast("map<string,string>"))
    keep = F.map_filter(scalars(rec), lambda k, v: k.isin("release", "version", "environment") & (v != ""))
    return _finish(df.select(
        "file", "index", get(rec, "$.id", "string").alias("given"), "turns", _null().alias("system"), tools.alias("tools"), merged(scalars(get(rec, "$.metadata")), tags, keep, rest).alias("metadata"),
        (F.exists("obs", level) | level(rec)).alias("error"), feedback.alias("feedback"), F.nullif(get(rec, "$.name", "string"), F.lit("")).alias("route"), get(F.col("last"), "$.model", "string").alias("model"),
        F.when(F.size("turns") == 0, "no input or output").alias("reason"),
    ), "langfuse")


def parse_generic(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    first = lambda *ks: F.coalesce(*[get(rec, f"$.{k}") for k in ks])  # noqa: E731  the first key that is there, null or not
    asked, told = first("input", "prompt", "question"), first("output", "completion", "answer", "response")
    df = records.withColumns({"asked": loose_messages(asked, "user"), "told": loose_messages(told, "assistant")})
    final = F.try_element_at("told", F.lit(-1))["content"]
    taken = ("input", "prompt", "question", "output", "completion", "answer", "response", "metadata", "id", "tools")
    md = merged(scalars(get(rec, "$.metadata")), scalars(rec, taken))
    names = lambda v: F.filter(F.transform(get(v, "$", "array<variant>"), lambda x: F.when(kind(x) == "STRING", get(x, "$", "string"))), lambda x: x.isNotNull())
    tools = F.concat(F.coalesce(names(get(rec, "$.tools")), names(get(rec, "$.metadata.tools")), _none()), F.coalesce(F.array_compact(F.array(F.try_element_at(md, F.lit("tool")))), _none()))
    turns = F.concat("asked", F.when(F.size("told") > 0, F.array(said("assistant", final))).otherwise(F.array().cast(MESSAGES)))
    return _finish(df.select(
        "file", "index", get(rec, "$.id", "string").alias("given"), turns.alias("turns"), _null().alias("system"), tools.alias("tools"), md.alias("metadata"), F.lit(False).alias("error"), _null().alias("feedback"), _null().alias("route"), _null().alias("model"),
        F.when(kind(asked).isin("", "VOID"), "no input field").alias("reason"),
    ), "generic")


# ---- OpenTelemetry -------------------------------------------------------------------------------------------------


def attributes(v: Column) -> Column:
    """Attributes as map<string, string>: an object's scalars, or OTLP key-value pairs; nested values as JSON."""
    pairs = _objects(get(v, "$", "array<variant>"))
    value = lambda p: F.coalesce(*[get(p, f"$.value.{k}") for k in ("stringValue", "boolValue", "doubleValue", "intValue", "arrayValue", "kvlistValue")], get(p, "$.value"))
    shown = lambda x: F.when(kind(x).isin("OBJECT", "ARRAY"), F.to_json(x)).otherwise(as_text(x))
    entries = F.transform(pairs, lambda p: F.named_struct(F.lit("key"), get(p, "$.key", "string"), F.lit("value"), shown(value(p))))
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())

    def mapped(es: Column) -> Column:  # the last of a repeated key
        keys = F.transform(es, lambda e: e["key"])
        return F.map_from_entries(F.filter(es, lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i))

    flat = F.transform_values(F.coalesce(get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, x: shown(x))
    return F.when(kind(v) == "ARRAY", bind(entries, mapped)).otherwise(flat)


def otel_spans(records: DataFrame) -> DataFrame:
    """file, index, span, service of OTLP records (resourceSpans), or of flat spans as they are."""
    rs = F.when(get(F.col("rec"), "$.resourceSpans").isNotNull(), get(F.col("rec"), "$.resourceSpans", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant")))
    df = records.select("file", "index", "rec", F.explode(rs).alias("rs"))
    scopes = F.coalesce(get(F.col("rs"), "$.scopeSpans", "array<variant>"), get(F.col("rs"), "$.instrumentationLibrarySpans", "array<variant>"))
    spans = F.flatten(F.transform(scopes, lambda s: F.coalesce(get(s, "$.spans", "array<variant>"), F.array().cast("array<variant>"))))
    service = F.try_element_at(attributes(get(F.col("rs"), "$.resource.attributes")), F.lit("service.name"))
    return df.select("file", "index", service.alias("service"), F.posexplode(F.when(F.col("rs").isNull(), F.array("rec")).otherwise(spans)).alias("at", "span"))


def _semconv(raw: Column) -> Column:
    """[{role, parts: [{type, content}]}] as messages."""

    def part(p: Column) -> Column:
        typ = F.coalesce(get(p, "$.type", "string"), F.lit("text"))
        return F.when(typ.isin("text", "tool_call_response"), text_of(F.coalesce(get(p, "$.content"), get(p, "$.response"), get(p, "$.result")), 2)).otherwise("")

    def one(m: Column) -> Column:
        parts = _objects(get(m, "$.parts", "array<variant>"))
        joined = F.array_join(F.filter(F.transform(parts, part), lambda t: t != ""), "\n")
        calls = F.filter(F.transform(parts, lambda p: F.when(get(p, "$.type", "string") == "tool_call", get(p, "$.name", "string"))), lambda n: F.coalesce(n != "", F.lit(False)))
        content = F.when(kind(get(m, "$.parts")) == "ARRAY", joined).otherwise(text_of(get(m, "$.content"), 2))
        return F.struct(F.coalesce(get(m, "$.role", "string"), F.lit("user")).alias("role"), content.alias("content"), calls.alias("tools"))

    return F.transform(_objects(get(F.try_parse_json(raw), "$", "array<variant>")), one)


def _indexed(attrs: Column, prefix: str, role: str) -> Column:
    """gen_ai.prompt.N.role and gen_ai.prompt.N.content as messages, by N."""
    numbers = F.filter(F.transform(F.map_keys(attrs), lambda k: F.regexp_extract(k, rf"^{prefix}\.(\d+)\.(?:role|content)$", 1)), lambda n: n != "")
    return F.transform(F.array_sort(F.transform(F.array_distinct(numbers), lambda n: n.cast("int"))), lambda n: F.struct(
        F.coalesce(F.try_element_at(attrs, F.concat(F.lit(f"{prefix}."), n.cast("string"), F.lit(".role"))), F.lit(role)).alias("role"),
        F.coalesce(F.try_element_at(attrs, F.concat(F.lit(f"{prefix}."), n.cast("string"), F.lit(".content"))), F.lit("")).alias("content"), _none().alias("tools")))


def _events(events: Column) -> Column:
    """Span events gen_ai.<role>.message and gen_ai.choice as messages."""

    def one(e: Column) -> Column:
        name = F.coalesce(get(e, "$.name", "string"), F.lit(""))
        attrs = attributes(get(e, "$.attributes"))
        body = F.coalesce(F.when(kind(get(e, "$.body")) == "OBJECT", get(e, "$.body")), F.try_parse_json(get(e, "$.body", "string")), F.try_parse_json(F.try_element_at(attrs, F.lit("body"))))
        content = F.coalesce(F.nullif(text_of(F.coalesce(get(body, "$.message.content"), get(body, "$.content")), 2), F.lit("")), F.try_element_at(attrs, F.lit("content")), F.lit(""))
        role = F.when(name == "gen_ai.choice", "assistant").otherwise(F.regexp_extract(name, r"^gen_ai\.(system|user|assistant|tool)\.message$", 1))
        return F.struct(role.alias("role"), content.alias("content"), _none().alias("tools"))

    return F.filter(F.transform(_objects(get(events, "$", "array<variant>")), one), lambda m: m["role"] != "")


def _earlier(x: Column, y: Column) -> Column:
    """Spans by their end, then their place in the file."""
    out = F.lit(0)
    for c in ("at", "index", "end"):
        out = F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(out)
    return out


def parse_otel(records: DataFrame) -> DataFrame:
    """One trace for each trace id: the last span with messages is the conversation, the root span names the route, any span may fail.

    A trace's spans are gathered into one row; a trace id that spans everything is bounded by nothing else.
    """
    s = otel_spans(records)
    events = get(F.col("span"), "$.events")
    s = s.withColumn("events", F.coalesce(F.try_parse_json(nesting.shallow_json(F.to_json(events), nesting.OTEL_DEPTH, strings=True)), events))
    span, at = F.col("span"), F.col("attrs")
    a = lambda k: F.try_element_at(at, F.lit(k))
    first = lambda *ks: F.coalesce(*[F.nullif(get(span, f"$.{k}", "string"), F.lit("")) for k in ks])
    s = s.withColumns({"attrs": attributes(get(span, "$.attributes")), "tid": F.coalesce(first("traceId", "trace_id", "context.trace_id"), F.lit("")), "end": F.coalesce(first("endTimeUnixNano", "end_time_unix_nano").try_cast("long"), F.lit(0))})
    s = s.withColumns({f"__{k}": nesting.shallow_json(a(f"gen_ai.{k.replace('_', '.', 1)}"), nesting.OTEL_DEPTH) for k in ("input_messages", "output_messages")})
    s = s.withColumn("__instructions", nesting.shallow_json(a("gen_ai.system_instructions"), nesting.OTEL_DEPTH))
    op = F.coalesce(a("gen_ai.operation.name"), F.lit(""))
    flat = F.filter(F.array(*[F.when(F.coalesce(a(k) != "", F.lit(False)), said(r, a(k))) for k, r in (("gen_ai.prompt", "user"), ("gen_ai.completion", "assistant"))]), lambda m: m.isNotNull())
    coded = F.concat(F.coalesce(_semconv(F.col("__input_messages")), F.array().cast(MESSAGES)), F.coalesce(_semconv(F.col("__output_messages")), F.array().cast(MESSAGES)))
    numbered = F.concat(_indexed(at, r"gen_ai.prompt", "user"), _indexed(at, r"gen_ai.completion", "assistant"))
    has_coded = a("gen_ai.input.messages").isNotNull() | a("gen_ai.output.messages").isNotNull()
    s = s.withColumns({"coded": coded, "numbered": numbered, "flat": flat})
    msgs = F.when(has_coded, F.col("coded")).when(F.size("numbered") > 0, F.col("numbered")).when(F.size("flat") > 0, F.col("flat")).otherwise(_events(F.col("events")))
    is_llm = F.exists(F.map_keys(at), lambda k: k.startswith("gen_ai.")) & ~op.isin("execute_tool", "embeddings")
    code = F.coalesce(get(span, "$.status.code", "string"), get(span, "$.status.status_code", "string"), F.lit(""))
    own = F.map_filter(at, lambda k, _: ~k.startswith("gen_ai."))
    short = lambda k: F.substring_index(k, ".", -1)
    known = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.map_entries(own), lambda e: short(e["key"]).isin(*OTEL_KEYS)), lambda e: F.struct(short(e["key"]), e["value"]))))
    system = F.coalesce(F.nullif(text_of(F.try_parse_json("__instructions"), 2), F.lit("")), a("gen_ai.system_instructions"))
    root = first("parentSpanId", "parent_span_id", "parent_id").isNull()
    row = F.struct(
        "end", "index", "at", F.when(is_llm, msgs).otherwise(F.array().cast(MESSAGES)).alias("turns"), system.alias("system"), F.coalesce(F.nullif(a("gen_ai.response.model"), F.lit("")), a("gen_ai.request.model")).alias("model"),
        F.coalesce(F.nullif(a("gen_ai.provider.name"), F.lit("")), a("gen_ai.system")).alias("provider"), F.when(op == "execute_tool", a("gen_ai.tool.name")).alias("tool"),
        (code.isin("2", "STATUS_CODE_ERROR", "ERROR") | (F.coalesce(a("error.type"), F.lit("")) != "")).alias("error"), F.when(root, F.coalesce(F.nullif(a("gen_ai.agent.name"), F.lit("")), first("name"))).alias("route"),
        F.when(root, own).otherwise(F.create_map().cast("map<string,string>")).alias("own"), known.alias("known"), "service",
    )
    g = s.groupBy("file", "tid").agg(F.min(F.struct("index", "at")).alias("__o"), F.array_sort(F.collect_list(row), _earlier).alias("spans"))
    last = F.try_element_at(F.filter("spans", lambda x: F.size(x["turns"]) > 0), F.lit(-1))
    pick = lambda c: F.filter(F.transform("spans", lambda x: x[c]), lambda x: x.isNotNull())
    empty = F.create_map().cast("map<string,string>")
    fold = lambda c: F.aggregate(F.transform("spans", lambda x: x[c]), empty, lambda acc, m: F.map_concat(acc, _without(m, acc)))
    extra = lambda k, v: F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(empty)
    g = g.withColumns({"last": last, "known": fold("known"), "own": fold("own")})
    md = merged(extra("service.name", F.get(pick("service"), F.lit(0))), F.col("known"), F.col("own"), extra("provider", F.col("last.provider")))
    g = g.withColumn("metadata", md)
    return _finish(g.select(
        "file", F.col("__o.index").alias("index"), F.nullif(F.col("tid"), F.lit("")).alias("given"), F.coalesce("last.turns", F.array().cast(MESSAGES)).alias("turns"), F.col("last.system").alias("system"), pick("tool").alias("tools"), "metadata",
        F.exists("spans", lambda x: x["error"]).alias("error"), _null().alias("feedback"), F.coalesce(F.try_element_at("metadata", F.lit("route")), F.get(pick("route"), F.lit(0))).alias("route"), F.col("last.model").alias("model"),
        F.when(F.col("last").isNull(), "no gen_ai spans with message content (content capture may be off)").alias("reason"),
    ), "otel", keep_blank=True)


PARSERS = {"openai": parse_openai, "anthropic": parse_anthropic, "langfuse": parse_langfuse, "otel": parse_otel, "generic": parse_generic}


def parse(records: DataFrame, fmt: str) -> DataFrame:
    """Traces of records of one format; records that are no JSON object are skipped with that reason."""
    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {', '.join(PARSERS)}")
    return PARSERS[fmt](nesting.shallow(records.filter(kind(F.col("rec")) == "OBJECT"), fmt))
