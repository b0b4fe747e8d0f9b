"""The command line from logs to exports, with a judge command."""

from __future__ import annotations

import json
import sys

from tracemill.cli import main

JUDGE = """
import json, sys
for line in sys.stdin:
    r = json.loads(line)
    print("not json" if r["trial"] == 1 else json.dumps({"verdict": "pass"}), flush=True)
"""


def test_steps(spark, tmp_path, capsys):
    logs = [{"id": f"t{i}", "input": f"question {i} about topic{i % 3} word{i * 7 % 11}", "output": "reply", "metadata": {"feedback": "down" if i % 5 == 0 else "up"}} for i in range(9)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/g.jsonl").write_text("\n".join(map(json.dumps, logs)))
    (tmp_path / "judge.py").write_text(JUDGE)
    (tmp_path / "bad.py").write_text("import sys; sys.stdin.readline()")
    (tmp_path / "rubric.json").write_text(json.dumps({"criteria": [{"id": "ok", "description": "is ok"}], "judges": [{"id": "j", "mode": "pointwise", "labels": ["pass", "fail"], "prompt": "{input} {output}", "provider": "x:y", "criteria": ["ok"]}]}))
    ws = str(tmp_path / "ws")

    def do(*argv):
        code = main([argv[0], "-w", ws, "--json", *argv[1:]], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert do("select")[0] == 2
    code, said = do("ingest", str(tmp_path / "logs"))
    assert code == 0 and {"metric": "traces", "value": "", "count": 9} in said
    assert said[-1]["format"] == "generic" and said[-1]["records"] == 9 and len(said[-1]["sha256"]) == 64
    assert len(do("select", "-n", "3", "--clusters", "2", "--near-dup", "0.9999")[1]) == 3
    assert do("draft")[0] == 0 and do("rubric", str(tmp_path / "rubric.json")) == (0, [])
    assert do("update", "case-001", json.dumps({"status": "ready", "expected_behavior": "TODO"}))[0] == 0
    assert do("validate")[0] == 1 and do("export")[0] == 1
    assert do("update", "case-001", json.dumps({"expected_behavior": "say it", "criteria": ["ok"]}))[0] == 0
    assert do("judge-plan", "--trials", "3")[1] == [{"judge": "j", "calls": 3}]
    command = f"j={sys.executable} {tmp_path}/"
    assert do("judge-run", "--command", command + "judge.py")[0] == 3
    code, said = do("judge-run", "--command", command + "judge.py", "--enable-judge-plugin")
    assert code == 0 and (said[0]["calls"], said[0]["ok"], said[0]["errors"]) == (3, 2, 1)
    code, said = do("judge-run", "--command", command + "bad.py", "--enable-judge-plugin")  # asks the failed one alone; the command ends
    assert (said[0]["calls"], said[0]["ok"], said[0]["errors"]) == (1, 0, 1)
    assert do("judge-check")[1][0]["verdict"] == "not_enough_data"
    (tmp_path / "labels.jsonl").write_text('{"case_id": "case-001", "label": "pass"}\n{"case_id": "nope", "label": "pass"}')
    assert do("label", "-n", "2")[0] == 0 and do("label-import", str(tmp_path / "labels.jsonl"))[0] == 1
    assert do("export", "--folder", str(tmp_path / "out"), "--judge", "j")[0] == 0
    config = (tmp_path / "out/promptfoo/promptfooconfig.yaml").read_text()
    found = json.loads(config.split("\n", 1)[1])
    assert "{{ input }}" in found["defaultTest"]["options"]["rubricPrompt"]
    tests = [json.loads(x) for f in found["tests"] for x in (tmp_path / "out/promptfoo" / f.removeprefix("file://")).read_text().splitlines()]
    assert [t["metadata"]["case_id"] for t in tests] == ["case-001"]
    assert json.loads((tmp_path / "out/deepeval/judge.json").read_text())["id"] == "j" and (tmp_path / "out/inspect/task.py").exists()
    compile((tmp_path / "out/deepeval/test_suite.py").read_text(), "t", "exec")
    assert do("export", "--folder", str(tmp_path / "out"))[0] == 0 and not (tmp_path / "out/deepeval/judge.json").exists()
    assert do("report")[0] == 0 and "## Limits" in (tmp_path / "ws/report.md").read_text()
    assert do("status")[1][0]["labels"] == 1 and do("export", "--judge", "nobody")[0] == 2
