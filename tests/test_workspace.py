"""From a log file to a checked and exported suite."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.workspace import Workspace


def test_logs_to_suite(spark, tmp_path):
    logs = [{"id": f"t{i % 14}", "input": f"question {i % 13} about topic{i % 3} word{i * 7 % 11} mail me at a{i}@b.org", "output": "reply", "metadata": {"route": f"r{i % 2}", "feedback": "down" if i % 5 == 0 else "up"}} for i in range(16)] + [{"output": "x"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, logs)))
    ws = Workspace(spark, str(tmp_path / "ws"))
    with pytest.raises(FileNotFoundError):
        ws.select(3)
    got = {(r.metric, r.value): r["count"] for r in ws.ingest(str(tmp_path / "g.jsonl")).collect()}
    assert got["traces", ""] == 16 and got["feedback", "negative"] == 4
    ids = [r.id for r in ws.table("traces").orderBy("pos").collect()]
    assert ids[14:] == ["t0~2", "t1~2"] and ws.table("traces").filter("input LIKE '%@%'").count() == 0
    assert {r.kind: r.n for r in ws.table("redactions").groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"email": 16}
    assert ws.table("skipped").first().skip_reason == "no input field"
    picks = ws.select(5, clusters=2, threshold=0.9999)
    assert picks.count() == 5 and picks.filter("failure").count() >= 2
    assert ws.draft().count() == 5 and ws.draft().count() == 5
    assert ws.write_rubric({"criteria": [{"id": "ok", "description": "is ok"}], "judges": [{"id": "j", "mode": "pointwise", "labels": ["pass", "fail"], "prompt": "{input} {output}", "criteria": ["ok"]}]}).count() == 0
    assert ws.validate().count() == 0  # nothing is ready, nothing to find
    for r in ws.table("cases").collect():
        ws.update_case(r.id, status="ready", expected_behavior="say it", criteria=["ok"])
    with pytest.raises(ValueError):
        ws.update_case("case-001", id="x")
    assert ws.plan(3, ("pad",), 2).count() == 25
    assert ws.run(lambda prompt, trial: "pass").first().ok == 25 and ws.run(lambda p, t: "fail").collect() == []
    rows = spark.createDataFrame([(1, "case-001", " PASS ", "p"), (2, "case-002", "maybe", "p"), (3, "nope", "pass", "p"), (4, "case-003", "", "p")], "row int, case_id string, label string, labeler string")
    assert {r.row: r.outcome for r in ws.import_labels(rows).collect()} == {1: "imported", 2: "rejected", 3: "rejected", 4: "blank"}
    assert ws.check().first().verdict == "not_enough_data" and ws.label(3).count() == 3 and ws.label_sheet(ws.label(3)).count() == 3
    assert ws.export(str(tmp_path / "out")).count() >= 4 and "| j | not_enough_data |" in ws.report()
