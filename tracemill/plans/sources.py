"""Queries on log formats and exports: logs of each format are made from the test tables, then parsed, with DuckDB SQL over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suites
from ..sinks import exports
from ..sources import formats, records
from . import adapters
from .adapters import duck, run_sql
from .suites import _C, _cases, _criteria


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _content(text: Column, style: Column) -> Column:
    """Message content in four shapes: a string, a block, blocks within blocks, an object."""
    q = _quoted(text)
    return (
        F.when(style == 1, F.format_string('[{"type":"text","text":%s}]', q))
        .when(style == 2, F.format_string('[{"type":"text","text":[{"text":{"value":[{"content":[[%s]]}]}}]}]', q))
        .when(style == 3, F.format_string('{"text":%s}', q))
        .otherwise(q)
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, msgs (JSON messages in order), said (the last turn's text if it is the assistant's), asked (messages before it), system."""
    t = run_sql(spark, sf_dir, adapters.TURNS).withColumn("k", F.col("id").cast("long"))
    m = F.format_string('{"role":"%s","content":%s}', F.col("role"), _content(F.col("content"), F.col("k") % 4))
    row = F.struct("turn", "role", "content", m.alias("m"), _content(F.col("content"), F.col("k") % 4).alias("c"))
    g = t.groupBy("k").agg(F.sort_array(F.collect_list(row)).alias("a"))
    last = F.try_element_at("a", F.lit(-1))
    ends = last["role"] == "assistant"
    chat = F.filter("a", lambda x: x["role"] != "system")
    g = g.select("k", F.transform("a", lambda x: x["m"]).alias("msgs"), ends.alias("ends"), last["m"].alias("last_m"), F.when(ends, last["c"]).alias("said"), F.transform(chat, lambda x: x["m"]).alias("chat"), F.array_join(F.transform(F.filter("a", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n\n").alias("system"))
    less = lambda a: F.when(F.col("ends"), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    return g.withColumns({"asked": less(F.col("msgs")), "asked_chat": less(F.col("chat"))})


def _list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _records(df: DataFrame, text: Column, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("file"), F.col("k").cast("int").alias("index"), F.parse_json(text).alias("rec"))


def openai_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd conversations as request and response, even ones as a list of messages; every fifth has a rating, every sixth an error."""
    c = _conversations(spark, sf_dir)
    extra = F.format_string('"metadata":{"route":"/r%s","rating":%s},"error":%s', F.col("k") % 3, F.when(F.col("k") % 5 == 0, "5").otherwise('"none"'), F.when(F.col("k") % 6 == 0, "true").otherwise("false"))
    flat = F.format_string('{"id":"c%s","model":"m1","messages":%s,%s}', "k", _list(F.col("msgs")), extra)
    pair = F.format_string('{"id":"c%s","request":{"model":"m2","messages":%s},"response":{"choices":[{"message":%s}]},%s}', F.col("k"), _list(F.col("asked")), F.when(F.col("ends"), F.col("last_m")).otherwise("null"), extra)
    return _records(c, F.when(F.col("k") % 2 == 0, flat).otherwise(pair), "openai.jsonl")


def anthropic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a system text, answers as blocks; every fifth calls a tool."""
    c = _conversations(spark, sf_dir)
    tool = F.when(F.col("k") % 5 == 0, ',{"type":"tool_use","id":"u","name":"calc","input":{"a":[1]}}').otherwise("")
    said = F.format_string('{"type":"tool_result","content":%s}%s', F.coalesce("said", F.lit('""')), tool)
    text = F.format_string('{"id":"c%s","request":{"model":"m3","system":[{"type":"text","text":[[%s]]}],"messages":%s},"response":{"type":"message","content":[%s],"stop_reason":"end_turn"}}', F.col("k"), _quoted(F.col("system")), _list(F.col("asked_chat")), said)
    return _records(c, text, "anthropic.jsonl")


def langfuse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations hold their messages at the top, odd ones in the last generation."""
    c = _conversations(spark, sf_dir)
    io = F.format_string('"input":%s,"output":%s', _list(F.col("asked_chat")), F.coalesce(F.when(F.col("ends"), F.col("last_m")), F.lit("null")))
    top = F.when(F.col("k") % 2 == 0, io).otherwise('"input":null,"output":null')
    gen = F.when(F.col("k") % 2 == 1, io).otherwise('"input":"x","output":null')
    text = F.format_string('{"id":"c%s","name":"chat%s",%s,"tags":["a"],"scores":[{"name":"user-feedback","value":%s},{"name":"fluency","value":0.5}],"observations":[{"type":"GENERATION","startTime":"2","model":"late",%s},{"type":"GENERATION","startTime":"1","model":"early"},{"type":"TOOL","name":"kb"},{"type":"SPAN","level":"%s"}]}', F.col("k"), F.col("k") % 3, top, F.col("k") % 2, gen, F.when(F.col("k") % 6 == 0, "ERROR").otherwise("DEFAULT"))
    return _records(c, text, "langfuse.jsonl")


def generic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts: plain, or nested in lists; every eleventh without a prompt."""
    d = run_sql(spark, sf_dir, "SELECT doc_id AS k, coalesce(text, '') AS text, source FROM @documents@")
    q = _quoted(F.col("text"))
    prompt = F.when(F.col("k") % 11 == 0, "null").when(F.col("k") % 7 == 0, F.format_string('[[[[[%s]]]],""]', q)).otherwise(q)
    text = F.format_string('{"id":"g%s","prompt":%s,"completion":{"answer":%s},"tools":["t1"],"metadata":{"tool":"t2","route":%s}}', F.col("k"), prompt, _quoted(F.concat(F.lit("to "), F.col("k").cast("string"))), _quoted(F.coalesce("source", F.lit(""))))
    return _records(d, text, "generic.jsonl")


def otel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of spans for each conversation: a root, a tool call, a model call whose messages are coded parts (even) or events (odd)."""
    c = _conversations(spark, sf_dir)
    kv = lambda key, v: F.format_string('{"key":"%s","value":{"stringValue":%s}}', F.lit(key), v)
    deep = F.col("k") % 4 == 2
    t = run_sql(spark, sf_dir, adapters.TURNS).filter("role <> 'system'").withColumn("k", F.col("id").cast("long"))
    q = _quoted(F.col("content"))
    part = F.format_string('{"role":"%s","parts":[{"type":"text","content":%s}]}', F.col("role"), F.when(deep, F.format_string('[{"text":[[{"value":[%s]}]]}]', q)).otherwise(q))
    body = F.format_string('{"content":%s}', F.when(F.col("k") % 4 == 3, F.format_string('[{"text":[[{"value":[%s]}]]}]', q)).otherwise(q))
    event = F.format_string('{"name":"gen_ai.%s.message","body":%s}', F.col("role"), F.when(F.col("k") % 8 == 7, _quoted(body)).otherwise(body))
    g = t.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p"), event.alias("e")))).alias("a"))
    coded = kv("gen_ai.input.messages", _quoted(_list(F.transform("a", lambda x: x["p"]))))
    attrs = F.concat(F.when(F.col("k") % 2 == 0, F.concat(coded, F.lit(","))).otherwise(""), kv("gen_ai.request.model", F.lit('"m4"')))
    events = F.when(F.col("k") % 2 == 1, _list(F.transform("a", lambda x: x["e"]))).otherwise("[]")
    spans = F.format_string('[{"traceId":"T%s","spanId":"1","name":"root%s","endTimeUnixNano":"90","attributes":[]},{"traceId":"T%s","spanId":"2","parentSpanId":"1","endTimeUnixNano":"60","attributes":[%s,%s]},{"traceId":"T%s","spanId":"3","parentSpanId":"1","endTimeUnixNano":"50","status":{"code":%s},"attributes":[%s],"events":%s}]',
        F.col("k"), F.col("k") % 3, F.col("k"), kv("gen_ai.operation.name", F.lit('"execute_tool"')), kv("gen_ai.tool.name", F.lit('"lookup"')), F.col("k"), F.when(F.col("k") % 6 == 0, "2").otherwise("1"), attrs, events)
    text = F.format_string('{"resourceSpans":[{"resource":{"attributes":[%s]},"scopeSpans":[{"spans":%s}]}]}', kv("service.name", F.lit('"svc"')), spans)
    return _records(g.join(c.select("k"), "k"), text, "otel.jsonl")


MADE = {"openai": openai_records, "anthropic": anthropic_records, "langfuse": langfuse_records, "generic": generic_records, "otel": otel_records}


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"), F.md5(F.coalesce("system", F.lit(""))).alias("system_md5"), F.size("messages").alias("n_messages"), F.array_join("tools", ",").alias("tools"), "error", "feedback", "route", "model", F.try_element_at("metadata", F.lit("service.name")).alias("service"), "skip_reason")


def _parsed(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(formats.parse(MADE[fmt](spark, sf_dir), fmt))

    run.__name__ = f"parse_{fmt}"
    return run


def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.detect_formats(reduce(DataFrame.unionByName, [make(spark, sf_dir) for make in MADE.values()]))


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.export_cases(_cases(spark, sf_dir), _criteria(spark))


def export_promptfoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exports.promptfoo_tests(_suite(spark, sf_dir))
    return t.select(F.col("metadata.case_id").alias("id"), F.md5("description").alias("description_md5"), F.md5("vars.input").alias("input_md5"), F.md5(F.array_join(F.transform("vars.messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("messages_md5"), F.col("vars.context").alias("context"), F.get("assert", F.lit(0))["value"].alias("rubric"), F.col("metadata.criteria").alias("criteria"))


def export_deepeval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exports.deepeval_rows(_suite(spark, sf_dir))
    return t.select(F.col("name").alias("id"), F.md5("input").alias("input_md5"), "expected_output", "actual_output", F.array_join("context", "|").alias("context"), F.col("additional_metadata.criteria_text").alias("criteria_text"), F.array_join("additional_metadata.tags", ",").alias("tags"))


def export_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exports.inspect_rows(_suite(spark, sf_dir))
    return t.select("id", F.size("input").alias("turns"), F.md5(F.try_element_at("input", F.lit(-1))["content"]).alias("input_md5"), "target", F.array_join("metadata.criteria", ",").alias("criteria"))


QUERIES = {**{f"parse_{f}": _parsed(f) for f in MADE}, **{f.__name__: f for f in (detect_formats, export_promptfoo, export_deepeval, export_inspect)}}

# ---- DuckDB --------------------------------------------------------------------------------------------------------

_A = f"""r AS ({duck(adapters.TURNS)}), ids AS (SELECT DISTINCT id, id::BIGINT AS k FROM r), m AS (SELECT * FROM r WHERE role <> 'system'),
  s AS (SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS system FROM r WHERE role = 'system' AND content <> '' GROUP BY id),
  g AS (SELECT id, count(*) AS n, max(turn) FILTER (role = 'user') AS lu, max(turn) AS lt, arg_max(content, turn) FILTER (role = 'user') AS input, arg_max(role, turn) AS last_role, arg_max(content, turn) AS last_content FROM m GROUP BY id),
  a AS (SELECT ids.k, coalesce(g.input, '') AS input, CASE WHEN g.last_role = 'assistant' THEN g.last_content ELSE '' END AS output, coalesce(s.system, '') AS system, coalesce(g.n, 0)::INTEGER AS n,
    coalesce(g.last_role = 'assistant', false) AS ends, g.lu IS NOT NULL AS has_user FROM ids LEFT JOIN g USING (id) LEFT JOIN s USING (id))"""
_BLANK = "trim({}, ' ' || chr(9) || chr(10) || chr(13)) = ''"
_WHY = f"CASE WHEN {_BLANK.format('input')} AND {_BLANK.format('output')} THEN 'empty input and output' WHEN {_BLANK.format('input')} THEN 'no user message' END"
_MD5 = "md5(input) AS input_md5, md5(output) AS output_md5"
_RUBRIC = "expected_behavior || chr(10) || chr(10) || 'Criteria:' || chr(10) || ct"
ORACLE = {
    # a choice without a message is an empty answer
    "parse_openai": f"""WITH {_A} SELECT 'c' || k AS id, {_MD5}, md5(system) AS system_md5, (n + CASE WHEN k % 2 = 1 AND NOT ends THEN 1 ELSE 0 END)::INTEGER AS n_messages, '' AS tools, k % 6 = 0 AS error, CASE WHEN k % 5 = 0 THEN 'positive' END AS feedback, '/r' || k % 3 AS route,
  CASE WHEN k % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, NULL::VARCHAR AS service, {_WHY} AS skip_reason FROM a""",
    # an answer is always there, as a block that may be empty
    "parse_anthropic": f"""WITH {_A} SELECT 'c' || k AS id, {_MD5}, md5(system) AS system_md5, (n + CASE WHEN ends THEN 0 ELSE 1 END)::INTEGER AS n_messages, CASE WHEN k % 5 = 0 THEN 'calc' ELSE '' END AS tools, false AS error, NULL::VARCHAR AS feedback,
  NULL::VARCHAR AS route, 'm3' AS model, NULL::VARCHAR AS service, {_WHY} AS skip_reason FROM a""",
    "parse_langfuse": f"""WITH {_A} SELECT 'c' || k AS id, {_MD5}, md5('') AS system_md5, n AS n_messages, 'kb' AS tools, k % 6 = 0 AS error, CASE WHEN k % 2 = 1 THEN 'positive' ELSE 'negative' END AS feedback,
  'chat' || k % 3 AS route, 'late' AS model, NULL::VARCHAR AS service, {_WHY} AS skip_reason FROM a""",
    "parse_generic": f"""WITH a AS (SELECT doc_id AS k, CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(text, '') END AS input, 'to ' || doc_id AS output, source FROM documents)
  SELECT 'g' || k AS id, {_MD5}, md5('') AS system_md5, CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END::INTEGER AS n_messages, 't1,t2' AS tools, false AS error, NULL::VARCHAR AS feedback, nullif(source, '') AS route, NULL::VARCHAR AS model, NULL::VARCHAR AS service,
    CASE WHEN k % 11 = 0 THEN 'no input field' ELSE {_WHY} END AS skip_reason FROM a""",
    "parse_otel": f"""WITH {_A} SELECT 'T' || k AS id, {_MD5}, md5('') AS system_md5, n AS n_messages, 'lookup' AS tools, k % 6 = 0 AS error, NULL::VARCHAR AS feedback, 'root' || k % 3 AS route, 'm4' AS model, 'svc' AS service,
  NULL::VARCHAR AS skip_reason FROM a WHERE n > 0""",
    "detect_formats": "SELECT * FROM (VALUES ('openai.jsonl', 'openai'), ('anthropic.jsonl', 'anthropic'), ('langfuse.jsonl', 'langfuse'), ('generic.jsonl', 'generic'), ('otel.jsonl', 'otel')) v(file, format)",
    "export_promptfoo": f"""WITH {_C} SELECT id, md5(id || ': ' || trim(substring(input, 1, 60), ' ')) AS description_md5, md5(input) AS input_md5, md5(CASE WHEN pos % 4 = 0 THEN 'user:hi|' ELSE '' END || 'user:' || input) AS messages_md5, ctx AS context,
  {_RUBRIC} AS rubric, array_to_string(criteria, ',') AS criteria FROM cs WHERE status = 'ready'""",
    "export_deepeval": f"WITH {_C} SELECT id, md5(input) AS input_md5, expected_behavior AS expected_output, observed_output AS actual_output, CASE WHEN pos % 4 = 0 THEN 'user: hi' END AS context, ct AS criteria_text, tag AS tags FROM cs WHERE status = 'ready'",
    "export_inspect": f"WITH {_C} SELECT id, CASE WHEN pos % 4 = 0 THEN 2 ELSE 1 END AS turns, md5(input) AS input_md5, CASE WHEN ct <> '' THEN {_RUBRIC} ELSE expected_behavior END AS target, array_to_string(criteria, ',') AS criteria FROM cs WHERE status = 'ready'",
}
