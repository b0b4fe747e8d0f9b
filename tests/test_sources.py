"""Log formats on hand-written records: one case for each rule of each parser."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import formats, records

OPENAI = [
    {"id": "o1", "model": "m", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "user_feedback": "thumbs up", "metadata": {"route": "/a"}},
    {"id": "o 2!", "request": {"model": "m2", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": "u"}, {"type": "text", "text": "b"}]}]},
     "response": {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [{"id": "t", "type": "function", "function": {"name": "search", "arguments": "{}"}}]}}]}, "error": True},
    {"messages": []},
    {"id": "o1", "messages": [{"role": "human", "content": "again"}, {"role": "bot", "content": "sure"}], "metadata": {"rating": 2}},
    {"id": "o5", "messages": [{"role": "assistant", "content": "only me"}]},
]
ANTHROPIC = [
    {"id": "a1", "request": {"model": "c", "system": "sys", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "calc", "input": {}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": "4"}]}]},
     "response": {"id": "r", "type": "message", "role": "assistant", "content": [{"type": "text", "text": "four"}], "stop_reason": "end_turn"}, "metadata": {"rating": 5}},
    {"id": "a2", "system": [{"type": "text", "text": "s1"}], "messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]},
]
LANGFUSE = [
    {"id": "l1", "name": "chat", "input": None, "output": None, "tags": ["t"], "scores": [{"name": "user-feedback", "value": 0}, {"name": "fluency", "value": 0.5}],
     "observations": [{"id": "g2", "type": "GENERATION", "startTime": "2", "model": "late", "input": [{"role": "user", "content": "in"}], "output": "out2"}, {"id": "g1", "type": "GENERATION", "startTime": "1", "model": "early", "input": "no", "output": "no"}, {"type": "TOOL", "name": "kb"}, {"type": "SPAN", "level": "ERROR"}]},
    {"id": "l2", "name": "x", "input": {"question": "why"}, "output": {"answer": "so"}, "observations": []},
]
attr = lambda **kv: [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kv.items()]
OTEL = [{"resourceSpans": [{"resource": {"attributes": attr(service__name="svc")}, "scopeSpans": [{"spans": [
    {"traceId": "T1", "spanId": "1", "name": "root", "endTimeUnixNano": "90", "attributes": attr(app__route="/r"), "status": {"code": 1}},
    {"traceId": "T1", "spanId": "2", "parentSpanId": "1", "endTimeUnixNano": "50", "status": {"code": 2}, "attributes": attr(gen_ai__request__model="m", gen_ai__input__messages=json.dumps([{"role": "user", "parts": [{"type": "text", "content": "ask"}]}]), gen_ai__output__messages=json.dumps([{"role": "assistant", "parts": [{"type": "text", "content": "told"}, {"type": "tool_call", "name": "w"}]}]))},
    {"traceId": "T1", "spanId": "4", "parentSpanId": "1", "endTimeUnixNano": "60", "attributes": attr(gen_ai__operation__name="execute_tool", gen_ai__tool__name="lookup")},
    {"traceId": "T2", "spanId": "3", "endTimeUnixNano": "5", "attributes": [*attr(gen_ai__prompt__0__role="user", gen_ai__prompt__0__content="p0", gen_ai__completion__0__content="c0"), {"key": "feedback", "value": {"intValue": "1"}}]},
    {"traceId": "T3", "spanId": "5", "attributes": attr(http__route="/none")},
    {"traceId": "T4", "spanId": "6", "attributes": attr(gen_ai__system="s"), "events": [{"name": "gen_ai.user.message", "attributes": attr(content="ev")}, {"name": "gen_ai.choice", "body": {"message": {"content": "ch"}}}]},
]}]}]}]
GENERIC = [{"id": "g1", "prompt": "p", "completion": "c", "tools": ["t1"], "metadata": {"tool": "t2", "status": "failed"}}, {"output": "no input"}, {"question": " ", "answer": "x"}, {"input": None, "output": "x"}, "not an object"]


def recs(spark, data):
    df = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(data)], "file string, index int, raw string")
    return df.select("file", "index", F.parse_json("raw").alias("rec"))


def rows(spark, data, fmt):
    return {r.source["index"] if fmt != "otel" else r.id: r for r in formats.parse(recs(spark, data), fmt).collect()}


def test_openai(spark):
    r = rows(spark, OPENAI, "openai")
    assert (r[0].id, r[0].input, r[0].output, r[0].system, r[0].feedback, r[0].route, r[0].model, r[0].error) == ("o1", "hi", "yo", "be brief", "positive", "/a", "m", False)
    assert (r[1].id, r[1].input, r[1].output, r[1].tools, r[1].error, r[1].model) == ("o-2", "a\nb", "", ["search"], True, "m2")
    assert r[2].skip_reason == "no messages" and r[4].skip_reason == "no user message"
    assert [m.role for m in r[3].messages] == ["user", "assistant"] and r[3].feedback == "negative"


def test_anthropic(spark):
    r = rows(spark, ANTHROPIC, "anthropic")
    assert (r[0].input, r[0].output, r[0].system, r[0].tools, r[0].feedback, r[0].metadata["stop_reason"]) == ("q", "four", "sys", ["calc"], "positive", "end_turn")
    assert [m.role for m in r[0].messages] == ["user", "assistant", "tool", "assistant"]
    assert (r[1].system, r[1].input, r[1].output) == ("s1", "x", "y")


def test_langfuse(spark):
    r = rows(spark, LANGFUSE, "langfuse")
    assert (r[0].input, r[0].output, r[0].model, r[0].tools, r[0].error, r[0].feedback, r[0].route) == ("in", "out2", "late", ["kb"], True, "negative", "chat")
    assert r[0].metadata["scores.fluency"] == "0.5" and (r[1].input, r[1].output) == ("why", "so")


def test_otel(spark):
    r = rows(spark, OTEL, "otel")
    assert (r["T1"].input, r["T1"].output, r["T1"].tools, r["T1"].error, r["T1"].model) == ("ask", "told", ["lookup", "w"], True, "m")
    assert r["T1"].metadata["service.name"] == "svc" and r["T1"].route == "/r"
    assert (r["T2"].input, r["T2"].output, r["T2"].feedback) == ("p0", "c0", "positive")
    assert (r["T4"].input, r["T4"].output) == ("ev", "ch") and r["T3"].skip_reason.startswith("no gen_ai spans")


def test_generic(spark):
    r = rows(spark, GENERIC, "generic")
    assert (r[0].input, r[0].output, r[0].tools, r[0].error) == ("p", "c", ["t1", "t2"], True)
    assert (r[1].skip_reason, r[2].skip_reason, r[3].skip_reason) == ("no input field", "no user message", "no input field") and 4 not in r
    with pytest.raises(ValueError):
        formats.parse(recs(spark, GENERIC), "csv")


def test_files_detection_and_fingerprints(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text("\n\n".join(map(json.dumps, OPENAI)))
    (tmp_path / "a.json").write_text(json.dumps(ANTHROPIC))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/l.json").write_text(json.dumps({"data": LANGFUSE, "meta": {}}))
    (tmp_path / "t.json").write_text(json.dumps(OTEL[0]))
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, GENERIC)))
    got = records.load_records(spark, str(tmp_path))
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    n = {r.name: (r["count"], r.least, r.most) for r in got.groupBy(name).agg(F.count(F.lit(1)).alias("count"), F.min("index").alias("least"), F.max("index").alias("most")).collect()}
    assert n == {"o.jsonl": (5, 0, 4), "a.json": (2, 0, 1), "l.json": (2, 0, 1), "t.json": (1, 0, 0), "g.jsonl": (5, 0, 4)}
    kinds = {r.name: r.format for r in records.detect_formats(got).select(name, "format").collect()}
    assert kinds == {"o.jsonl": "openai", "a.json": "anthropic", "l.json": "langfuse", "t.json": "otel", "g.jsonl": "generic"}
    assert records.fingerprints(spark, str(tmp_path)).count() == 5
    (tmp_path / "bad.jsonl").write_text("{oops")
    with pytest.raises(Exception, match="not valid JSON"):
        records.load_records(spark, str(tmp_path)).collect()


def test_text_of_any_depth(spark):
    """Text nested far below what the expressions look through is kept in every format; texts with brackets and quotes stay as they are."""
    deep = 'say "]}[{ \\ here'

    def nest(n):
        v = [deep]
        for _ in range(n):
            v = [{"type": "text", "text": {"value": [v, ""]}}, {"type": "image_url", "image_url": "u"}]
        return v

    qs = [nest(n) for n in (0, 1, 2, 5, 40)]
    r = rows(spark, [{"id": "o", "messages": [{"role": "user", "content": q}], "response": {"choices": [{"message": {"role": "assistant", "content": q}}]}} for q in qs], "openai")
    assert [(x.input, x.output, x.skip_reason) for x in r.values()] == [(deep, deep, None)] * 5
    said = lambda q: [{"type": "tool_result", "content": q}, {"type": "tool_use", "name": "calc", "input": {"text": [[1]]}}]
    r = rows(spark, [{"id": "a", "request": {"system": q, "messages": [{"role": "user", "content": q}]}, "response": {"type": "message", "content": said(q), "stop_reason": "x"}} for q in qs], "anthropic")
    assert [(x.input, x.output, x.system, x.tools) for x in r.values()] == [(deep, deep, deep, ["calc"])] * 5
    r = rows(spark, [{"id": "l", "input": None, "output": None, "observations": [{"type": "GENERATION", "startTime": "1", "input": q, "output": {"choices": [{"message": {"content": q}}]}}]} for q in qs], "langfuse")
    assert [(x.input, x.output) for x in r.values()] == [(deep, deep)] * 5
    r = rows(spark, [{"id": "g", "prompt": q, "answer": [{"role": "assistant", "content": q}], "metadata": {"k": [[[[1]]]]}} for q in qs], "generic")
    assert [(x.input, x.output) for x in r.values()] == [(deep, deep)] * 5
    spans = []
    for i, q in enumerate(qs):
        coded = attr(gen_ai__input__messages=json.dumps([{"role": "user", "parts": [{"type": "text", "content": q}]}]), gen_ai__output__messages=json.dumps([{"role": "assistant", "parts": [{"type": "tool_call_response", "response": q}]}]), gen_ai__system_instructions=json.dumps(q))
        bodies = [{"name": "gen_ai.user.message", "attributes": attr(body=json.dumps({"content": q}))}, {"name": "gen_ai.choice", "body": {"message": {"content": q}}}]
        spans += [{"traceId": f"C{i}", "spanId": "1", "attributes": coded}, {"traceId": f"E{i}", "spanId": "2", "attributes": attr(gen_ai__system="s"), "events": bodies}]
    r = rows(spark, [{"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}], "otel")
    assert len(r) == 10 and all((x.input, x.output, x.system) == (deep, deep, deep if i.startswith("C") else None) for i, x in r.items())
