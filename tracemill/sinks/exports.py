"""Files of a suite: JSON lines, promptfoo, DeepEval and Inspect rows, the label sheet, the report, with a manifest.

The row-shaped exports are written by Spark, so a suite of any size is written by its tasks; templates and reports are
small texts from aggregates.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import promptfoo_prompt
from ..functions.text import csv_cell

CSV_COLUMNS = ("case_id", "label", "note", "labeler", "allowed_labels", "mode", "expected_behavior", "criteria", "earlier_turns", "input", "reply", "answer_b")


def _metadata() -> Column:
    return F.struct(F.col("id").alias("case_id"), "trace_id", "tags", "criteria")


def _conversation() -> Column:
    """The turns a chat provider takes, with the case's input as the last."""
    turns = F.filter("context", lambda m: m["role"].isin("system", "user", "assistant"))
    return F.concat(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.array(F.struct(F.lit("user").alias("role"), F.col("input").alias("content"))))


def jsonl_rows(cases: DataFrame) -> DataFrame:
    """cases: suites.export_cases()."""
    return cases.select("id", "input", "context", "expected_behavior", "criteria", "reference_output", "observed_output", _metadata().alias("metadata"))


def promptfoo_tests(cases: DataFrame) -> DataFrame:
    """description, vars, assert, metadata of each test."""
    rubric = F.concat(F.btrim(F.coalesce("expected_behavior", F.lit(""))), F.lit("\n\nCriteria:\n"), F.col("criteria_text"))
    return cases.select(
        F.concat(F.col("id"), F.lit(": "), F.btrim(F.substring(F.coalesce("input", F.lit("")), 1, 60))).alias("description"),
        F.struct("input", _conversation().alias("messages"), F.col("context_text").alias("context"), F.btrim(F.coalesce("expected_behavior", F.lit(""))).alias("expected_behavior"), F.col("criteria_text").alias("criteria")).alias("vars"),
        F.array(F.struct(F.lit("llm-rubric").alias("type"), rubric.alias("value"))).alias("assert"),
        F.struct(F.col("id").alias("case_id"), "trace_id", F.array_join("criteria", ",").alias("criteria")).alias("metadata"),
    )


def promptfoo_grader(judge: DataFrame) -> DataFrame:
    """provider, rubricPrompt of the judge wired in."""
    return judge.select("provider", promptfoo_prompt(F.col("prompt")).alias("rubricPrompt"))


def deepeval_rows(cases: DataFrame) -> DataFrame:
    turns = F.transform("context", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    meta = F.struct(F.col("id").alias("case_id"), "trace_id", "tags", "criteria", "criteria_text", "context_text")
    return cases.select(F.col("id").alias("name"), "input", F.col("expected_behavior").alias("expected_output"), F.col("observed_output").alias("actual_output"), F.when(F.size(turns) > 0, turns).alias("context"), meta.alias("additional_metadata"))


def inspect_rows(cases: DataFrame) -> DataFrame:
    target = F.btrim(F.coalesce("expected_behavior", F.lit("")))
    target = F.when(F.col("criteria_text") != "", F.concat(target, F.lit("\n\nCriteria:\n"), F.col("criteria_text"))).otherwise(target)
    meta = F.struct(F.col("id").alias("case_id"), "trace_id", "tags", "criteria", "observed_output")
    return cases.select("id", _conversation().alias("input"), target.alias("target"), meta.alias("metadata"))


ROWS = {"jsonl": jsonl_rows, "promptfoo": promptfoo_tests, "deepeval": deepeval_rows, "inspect": inspect_rows}


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file on any path Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _name_parts(spark: SparkSession, folder: str, name: str) -> list[str]:
    """The part files of a folder of JSON lines under names that promptfoo takes for JSON lines."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    names = [f"{name}-{i:05d}.jsonl" for i in range(len(parts))]
    for part, new in zip(parts, names, strict=True):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}"), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{new}"))
    return names


_DEEPEVAL = '''"""Runs the cases beside this file: deepeval test run test_suite.py

Fill in `answer` to call the system under test; SCORE_LOGGED=1 scores the logged answers instead. With judge.json here,
fill in `ask` so that the checked judge grades; without it, GEval grades by the model that DeepEval is set to.
"""

import json
import os
from pathlib import Path

import pytest
from deepeval import assert_test
from deepeval.metrics import BaseMetric, GEval
from deepeval.test_case import LLMTestCase, LLMTestCaseParams

HERE = Path(__file__).parent
CASES = [json.loads(line) for part in sorted(HERE.glob("part-*.json")) for line in part.read_text(encoding="utf-8").splitlines()]
JUDGE = json.loads((HERE / "judge.json").read_text(encoding="utf-8")) if (HERE / "judge.json").exists() else None


def answer(case):
    if os.environ.get("SCORE_LOGGED") == "1":
        return case["actual_output"]
    raise NotImplementedError("call your system here")


def ask(provider, prompt):
    raise NotImplementedError("call the judge's model here")


class Checked(BaseMetric):
    threshold = 0.5

    def __init__(self, case):
        self.case = case

    def measure(self, test_case):
        more = self.case.get("additional_metadata") or {}
        prompt = JUDGE["prompt"]
        fields = {"input": test_case.input, "output": test_case.actual_output, "expected_behavior": self.case.get("expected_output") or "", "criteria": more.get("criteria_text") or "", "context": more.get("context_text") or ""}
        for name, value in fields.items():
            prompt = prompt.replace("{" + name + "}", value or "")
        self.reason = ask(JUDGE["provider"], prompt)
        self.score = float(JUDGE["labels"][0].lower() in self.reason.lower())
        return self.score

    async def a_measure(self, test_case, *args, **kwargs):
        return self.measure(test_case)

    def is_successful(self):
        return self.score >= self.threshold


@pytest.mark.parametrize("case", CASES, ids=[c["name"] for c in CASES])
def test_case(case):
    made = LLMTestCase(input=case["input"], actual_output=answer(case), expected_output=case.get("expected_output"), context=case.get("context"))
    taken = [LLMTestCaseParams.INPUT, LLMTestCaseParams.ACTUAL_OUTPUT, LLMTestCaseParams.EXPECTED_OUTPUT]
    assert_test(made, [Checked(case) if JUDGE else GEval(name="expected behavior", criteria="Does the actual output do what the expected output describes?", evaluation_params=taken)])
'''

_INSPECT = '''"""inspect eval task.py --model <provider/model>: a grader compares each answer with the case's target."""

import json
from pathlib import Path

from inspect_ai import Task, task
from inspect_ai.dataset import MemoryDataset, Sample
from inspect_ai.scorer import model_graded_qa
from inspect_ai.solver import generate


@task
def suite():
    parts = sorted(Path(__file__).parent.glob("part-*.json"))
    rows = [json.loads(line) for p in parts for line in p.read_text(encoding="utf-8").splitlines()]
    return Task(dataset=MemoryDataset([Sample(**r) for r in rows]), solver=generate(), scorer=model_graded_qa())
'''


def _promptfoo_config(spark: SparkSession, parts: list[str], suite: str, grader: DataFrame | None) -> str:
    """JSON, which every YAML reader takes, below a comment that says who grades."""
    own = promptfoo_grader(grader).first() if grader is not None else None
    note = f"# Graded by the checked judge {grader.first()['id']} with its own prompt; its answers must be JSON with pass and reason." if own else "# No judge has been found trustworthy: promptfoo's default grader is used."
    config = {"description": suite, "prompts": ["{{ messages | dump }}"], "providers": ["echo"], "tests": [f"file://{p}" for p in parts]}
    if own:
        config["defaultTest"] = {"options": own.asDict()}
    return f"{note}\n{json.dumps(config, indent=2, ensure_ascii=False)}\n"


def write_export(cases: DataFrame, folder: str, formats: tuple[str, ...] = tuple(ROWS), suite: str = "suite", grader: DataFrame | None = None, judge: DataFrame | None = None) -> None:
    """One folder for each format: JSON lines written by Spark's tasks, and the files the tool needs to run them.

    grader: at most one judge with id, provider and prompt, for promptfoo; judge: at most one with labels, for DeepEval.
    A folder is written anew, so a judge of an earlier export doesn't stay.
    """
    if bad := set(formats) - set(ROWS):
        raise ValueError(f"unknown export format {sorted(bad)}; expected {tuple(ROWS)}")
    spark = cases.sparkSession
    grader, judge = (None if d is None or d.isEmpty() else d for d in (grader, judge))
    for f in formats:
        out = f"{folder}/{f}"
        ROWS[f](cases).write.mode("overwrite").json(out)
        if f == "promptfoo":
            write_file(spark, f"{out}/promptfooconfig.yaml", _promptfoo_config(spark, _name_parts(spark, out, "cases"), suite, grader))
        elif f == "deepeval":
            write_file(spark, f"{out}/test_suite.py", _DEEPEVAL)
            if judge is not None:
                j = judge.first()
                write_file(spark, f"{out}/judge.json", json.dumps({"id": j["id"], "prompt": j["prompt"], "provider": j["provider"], "labels": j["labels"] or ["pass", "fail"]}, ensure_ascii=False, indent=2))
        elif f == "inspect":
            write_file(spark, f"{out}/task.py", _INSPECT)


def manifest(df_spark, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    files = df_spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def label_sheet_rows(cases: DataFrame, modes: DataFrame) -> DataFrame:
    """The twelve columns of the CSV sheet; cells over 32,000 characters are cut with a notice. cases: export_cases() with compare_output."""
    c = cases.join(modes, cases["id"] == modes["case_id"])
    turns = F.array_join(F.transform("context", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n\n")
    cell = lambda x: csv_cell(F.coalesce(x, F.lit("")))
    return c.select(
        F.col("id").alias("case_id"), F.lit("").alias("label"), F.lit("").alias("note"), F.lit("").alias("labeler"), F.array_join("allowed", " | ").alias("allowed_labels"), "mode",
        cell(F.col("expected_behavior")).alias("expected_behavior"), cell(F.col("criteria_text")).alias("criteria"), cell(turns).alias("earlier_turns"),
        cell(F.col("input")).alias("input"), cell(F.col("observed_output")).alias("reply"), cell(F.col("compare_output")).alias("answer_b"),
    )


def write_label_csv(sheet: DataFrame, folder: str) -> None:
    sheet.select(*CSV_COLUMNS).write.mode("overwrite").option("header", "true").option("escape", '"').option("multiLine", "true").csv(folder)


def label_page(rows: list[dict], title: str) -> str:
    """An offline page of the picked cases (a few dozen rows): choices by radio buttons, labels.jsonl by a button.

    Texts are held as JSON with <, > and & escaped, so that no case can end the script; the policy allows no network.
    """
    data = json.dumps(rows, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return f"""<!doctype html><html><head><meta charset="utf-8">
<meta http-equiv="Content-Security-Policy" content="default-src 'none'; script-src 'unsafe-inline'; style-src 'unsafe-inline'">
<title>{html.escape(title)}</title><style>body{{font:16px sans-serif;max-width:50em;margin:2em auto}}pre{{white-space:pre-wrap;background:#f4f4f4;padding:.7em}}</style></head><body>
<h1>{html.escape(title)}</h1><main id="m"></main><button id="x">Export labels.jsonl</button>
<script>const rows={data};const m=document.getElementById('m'),said={{}};
for(const r of rows){{const s=document.createElement('section');const add=(t,x)=>{{const e=document.createElement(t);e.textContent=x;s.append(e)}};
add('h2',r.case_id);add('pre',r.earlier_turns||'');add('pre',r.input||'');add('pre',r.reply||'');if(r.answer_b)add('pre',r.answer_b);
for(const a of r.allowed){{const l=document.createElement('label'),i=document.createElement('input');i.type='radio';i.name=r.case_id;i.onchange=()=>said[r.case_id]=a;l.append(i,a);s.append(l)}}m.append(s)}}
document.getElementById('x').onclick=()=>{{const b=new Blob([Object.entries(said).map(([k,v])=>JSON.stringify({{case_id:k,label:v}})).join('\\n')]);const a=document.createElement('a');a.href=URL.createObjectURL(b);a.download='labels.jsonl';a.click()}};
</script></body></html>"""


LIMITS = (
    "Selection compares words: inputs that say the same in other words may fall into different clusters.",
    "Redaction knows patterns (keys, tokens, emails, phone and card numbers); names, addresses and free secrets stay. Read the traces before you share them.",
    "Expected behaviour comes from people; a case is as good as what they wrote.",
    "Verdicts depend on thresholds, cases, trials and labels; with few of them the intervals are wide.",
    "The probes cover the order of answers and padding, not a judge's liking for its own style or a misread rubric.",
)


def limits(population: dict) -> list[str]:
    """What the numbers can't say, the run's own limits first."""
    own = []
    if population.get("judgments") and not population.get("labels"):
        own.append("There are no human labels, so no judge can be called trustworthy.")
    if population.get("failures") == 0:
        own.append("No trace has an error or negative feedback, so failures could not be picked first.")
    return [*own, *LIMITS]


def report(checked: list[dict], population: dict) -> str:
    """Markdown of a run: the population, one line for each judge, the limits."""
    pct = lambda x: "n/a" if x is None else f"{100 * x:.0f}%"
    lines = ["# Report", "", *[f"- {k}: {v}" for k, v in population.items()], "", "| judge | verdict | flips | accuracy | kappa | consistent | first shown | padded |", "|---|---|---|---|---|---|---|---|"]
    for r in checked:
        k = "n/a" if r.get("kappa") is None else f"{r['kappa']:.2f}"
        lines.append(f"| {r['judge']} | {r['verdict']} | {pct(r.get('flip_rate'))} | {pct(r.get('accuracy'))} | {k} | {pct(r.get('consistency'))} | {pct(r.get('first_rate'))} | {pct(r.get('toward_padded'))} |")
    return "\n".join([*lines, "", "## Limits", "", *[f"- {x}" for x in limits(population)], ""])


def card(name: str, verdict: str, meters: list[tuple[str, float, str]]) -> str:
    """A 1200x630 SVG of a judge: a bar for each (name, share, band)."""
    colours = {"good": "#2e7d32", "warning": "#f9a825", "critical": "#c62828"}
    bars = "".join(
        f'<text x="60" y="{230 + 90 * i}" font-size="28">{html.escape(n)}</text><rect x="600" y="{205 + 90 * i}" width="{500 * max(0.0, min(1.0, s)):.0f}" height="32" fill="{colours[b]}"/><text x="1120" y="{230 + 90 * i}" font-size="24" text-anchor="end">{s:.0%}</text>'
        for i, (n, s, b) in enumerate(meters)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="1200" height="630" font-family="sans-serif"><rect width="1200" height="630" fill="#fff"/><text x="60" y="90" font-size="44">{html.escape(name)}</text><text x="60" y="150" font-size="32">{html.escape(verdict)}</text>{bars}</svg>'
