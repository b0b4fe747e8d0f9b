"""Command line over a workspace: python -m tracemill.cli COMMAND -w FOLDER.

Exit codes: 0 done; 1 the suite is invalid or label rows were rejected; 2 wrong use or a missing table; 3 a judge command
that wasn't enabled.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.judging import Thresholds
from .sinks import exports
from .sinks.exports import write_file
from .sources.records import FORMATS
from .workspace import Workspace


def _list(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def _show(df: DataFrame, as_json: bool, limit: int = 100) -> None:
    """The first rows of a small result, as lines of JSON or of key=value."""
    for r in df.limit(limit).collect():
        d = r.asDict(recursive=True)
        print(json.dumps(d, default=str, ensure_ascii=False) if as_json else "  ".join(f"{k}={v}" for k, v in d.items()))


def _document(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path}: YAML needs the yaml package; give JSON") from None
        return yaml.safe_load(text) or {}
    return json.loads(text)


def _ingest(ws: Workspace, a: argparse.Namespace) -> int:
    _show(ws.ingest(a.path, a.format, not a.no_redact), a.json)
    _show(ws.table("sources"), a.json)
    return 0


def _select(ws: Workspace, a: argparse.Namespace) -> int:
    picks = ws.select(a.n, a.failure_share, a.near_dup, _list(a.stratify), a.clusters, a.seed, a.dedupe_on == "input+output")
    _show(picks.orderBy("place").select("id", "cluster", "failure", "reasons"), a.json, a.n)
    return 0


def _draft(ws: Workspace, a: argparse.Namespace) -> int:
    print(f"cases: {ws.draft().count()}")
    return 0


def _update(ws: Workspace, a: argparse.Namespace) -> int:
    ws.update_case(a.case, **json.loads(a.fields))
    return 0


def _rubric(ws: Workspace, a: argparse.Namespace) -> int:
    problems = ws.write_rubric(_document(a.file))
    _show(problems, a.json)
    return 0 if problems.isEmpty() else 1


def _validate(ws: Workspace, a: argparse.Namespace) -> int:
    problems = ws.validate()
    _show(problems, a.json)
    return 0 if problems.isEmpty() else 1


def _plan(ws: Workspace, a: argparse.Namespace) -> int:
    _show(ws.plan(a.trials, _list(a.probes), a.probe_trials).groupBy("judge").agg(F.count(F.lit(1)).alias("calls")), a.json)
    return 0


def _run(ws: Workspace, a: argparse.Namespace) -> int:
    pairs = [c.partition("=") for c in a.command]
    if bad := [c for c, eq, cmd in pairs if not eq or not cmd]:
        raise ValueError(f"--command takes judge=command, got {bad}")
    for judge, _, command in pairs:
        _show(ws.run_command(judge, shlex.split(command), a.enable_judge_plugin, a.timeout, a.restart), a.json)
    return 0


def _check(ws: Workspace, a: argparse.Namespace) -> int:
    th = Thresholds(a.min_trials, a.min_cases, a.max_flip_rate, a.min_position_consistency, a.max_toward_padded, a.min_kappa, a.min_labeled)
    _show(ws.check(th), a.json)
    return 0


def _label(ws: Workspace, a: argparse.Namespace) -> int:
    exports.write_label_csv(ws.label_sheet(ws.label(a.n, a.seed, a.include_labeled)), f"{ws.root}/label_sheet")
    print(f"{ws.root}/label_sheet")
    return 0


def _import(ws: Workspace, a: argparse.Namespace) -> int:
    csv = a.path.rstrip("/").endswith(".csv") or not a.path.endswith((".json", ".jsonl"))
    read = ws.spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv if csv else ws.spark.read.schema("case_id string, label string, labeler string").json
    rows = read(a.path)
    who = F.coalesce(F.nullif(F.trim("labeler"), F.lit("")), F.lit("human")) if "labeler" in rows.columns else F.lit("human")
    out = ws.import_labels(rows.select(F.monotonically_increasing_id().alias("row"), "case_id", "label", who.alias("labeler")))
    _show(out.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows")), a.json)
    rejected = out.filter("outcome = 'rejected'")
    _show(rejected, a.json)
    return 0 if rejected.isEmpty() else 1


def _export(ws: Workspace, a: argparse.Namespace) -> int:
    found = ws.validate()
    if not found.isEmpty():
        _show(found, a.json)
        return 1
    _show(ws.export(a.folder or f"{ws.root}/export", _list(a.formats) or tuple(exports.ROWS), a.judge), a.json)
    return 0


def _report(ws: Workspace, a: argparse.Namespace) -> int:
    text = ws.report()
    write_file(ws.spark, f"{ws.root}/report.md", text)
    print(json.dumps({"tables": ws.status(), "report": text}) if a.json else text)
    return 0


def _status(ws: Workspace, a: argparse.Namespace) -> int:
    found = ws.status()
    print(json.dumps(found) if a.json else "\n".join(f"{k}: {'-' if v is None else v}" for k, v in found.items()))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill", description="From logs to a checked suite of cases, step by step.")
    sub = p.add_subparsers(dest="command_name", required=True)

    def command(name: str, run, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about, description=about)
        c.add_argument("-w", "--workspace", default="workspace", help="folder of the tables")
        c.add_argument("--json", action="store_true", help="print JSON")
        c.set_defaults(func=run)
        return c

    c = command("ingest", _ingest, "logs to traces")
    c.add_argument("path")
    c.add_argument("-f", "--format", choices=FORMATS)
    c.add_argument("--no-redact", action="store_true")
    c = command("select", _select, "pick traces")
    c.add_argument("-n", type=int, default=50)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--clusters", type=int)
    c.add_argument("--failure-share", type=float, default=0.3)
    c.add_argument("--near-dup", type=float, default=0.9)
    c.add_argument("--dedupe-on", choices=("input", "input+output"), default="input")
    c.add_argument("--stratify", help="metadata keys, separated by commas")
    command("draft", _draft, "cases for the picks")
    c = command("update", _update, "fields of a case, as a JSON object")
    c.add_argument("case")
    c.add_argument("fields")
    c = command("rubric", _rubric, "save criteria and judges from a JSON or YAML file")
    c.add_argument("file")
    command("validate", _validate, "problems of cases and rubric")
    c = command("judge-plan", _plan, "requests to judges")
    c.add_argument("--trials", type=int, default=5)
    c.add_argument("--probes", help="swap, pad")
    c.add_argument("--probe-trials", type=int, default=3)
    c = command("judge-run", _run, "answer requests by a command of your own")
    c.add_argument("--command", action="append", required=True, help="judge=command")
    c.add_argument("--enable-judge-plugin", action="store_true")
    c.add_argument("--timeout", type=float, default=120.0)
    c.add_argument("--restart", action="store_true")
    c = command("judge-check", _check, "verdicts on judges")
    for name, kind, value in (("trials", int, 3), ("cases", int, 10), ("kappa", float, 0.4), ("labeled", int, 20), ("position-consistency", float, 0.8)):
        c.add_argument(f"--min-{name}", type=kind, default=value)
    c.add_argument("--max-flip-rate", type=float, default=0.2)
    c.add_argument("--max-toward-padded", type=float, default=0.1)
    c = command("label", _label, "a sheet of the cases to label next")
    c.add_argument("-n", type=int, default=24)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--include-labeled", action="store_true")
    c = command("label-import", _import, "labels from a filled sheet or JSON lines")
    c.add_argument("path")
    c = command("export", _export, "files for other tools")
    c.add_argument("--formats", help="separated by commas; all by default")
    c.add_argument("--folder")
    c.add_argument("--judge", help="the judge that grades, whatever its verdict")
    command("report", _report, "a report of the run")
    command("status", _status, "rows of each table")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.func(Workspace(spark or SparkSession.builder.getOrCreate(), a.workspace), a)
    except PermissionError as e:
        code, said = 3, str(e)
    except (FileNotFoundError, ValueError, KeyError) as e:
        code, said = 2, str(e.args[0] if isinstance(e, KeyError) and e.args else e)
    print(json.dumps({"error": said}) if a.json else f"error: {said}", file=sys.stdout if a.json else sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
