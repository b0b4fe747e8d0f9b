"""Judge requests: judges x cases x probes x trials, rendered; what is left to run; judges as plug-ins."""

from __future__ import annotations

import json
import queue
import subprocess
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import context_text
from .numbering import numbered

PROBES = ("swap", "pad")


def with_criteria(cases: DataFrame, criteria: DataFrame) -> DataFrame:
    """cases with criteria_text and known_criteria: `- id: description` lines of the rubric's criteria, in the case's order.

    criteria (id, description) is the rubric's, a small table.
    """
    each = cases.select("id", F.posexplode("criteria").alias("at", "cid"))
    known = each.join(F.broadcast(criteria.select(F.col("id").alias("cid"), F.coalesce("description", F.lit("")).alias("description"))), "cid")
    lines = known.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "cid", "description"))).alias("__c"))
    out = cases.join(lines, "id", "left")
    own = F.coalesce("__c", F.array().cast("array<struct<at:int,cid:string,description:string>>"))
    text = F.array_join(F.transform(own, lambda c: F.concat(F.lit("- "), c["cid"], F.lit(": "), c["description"])), "\n")
    return out.withColumns({"criteria_text": text, "known_criteria": F.transform(own, lambda c: c["cid"])}).drop("__c")


def build_requests(cases: DataFrame, judges: DataFrame, criteria: DataFrame, trials: int = 5, probes: tuple[str, ...] = (), probe_trials: int = 3) -> DataFrame:
    """One row for each judge call.

    cases: id, pos, input, context, observed_output, compare_output, expected_behavior, criteria. judges: id, mode,
    labels, prompt. Pairwise judges take cases with a compare_output only; swap is for pairwise judges; the padded side
    alternates over all ready cases. Judges and probes are small tables that are broadcast; the cases are never shuffled
    for the product.
    """
    if trials < 1 or probe_trials < 1:
        raise ValueError("trials and probe_trials must be >= 1")
    if bad := set(probes) - set(PROBES):
        raise ValueError(f"unknown probe {sorted(bad)}; expected {PROBES}")
    plan = F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(t).alias("n")) for p, t in [("none", trials), *[(p, probe_trials) for p in probes]]])
    indexed = with_criteria(cases if "index" in cases.columns else numbered(cases, "pos"), criteria)
    j = judges.select(F.col("id").alias("judge"), F.coalesce("mode", F.lit("pointwise")).alias("mode"), "labels", "prompt")
    df = indexed.crossJoin(F.broadcast(j)).filter("mode != 'pairwise' OR coalesce(compare_output, '') != ''")
    df = df.withColumn("p", F.explode(plan)).filter("p.probe != 'swap' OR mode = 'pairwise'")
    side = F.when(F.col("p.probe") == "pad", F.when(F.col("mode") == "pointwise", "output").when(F.col("index") % 2 == 0, "A").otherwise("B"))
    df = df.withColumn("pad_side", side).withColumn("trial", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)))
    shown = prompts.presented(F.col("mode"), F.col("p.probe"), F.col("pad_side"), F.coalesce("observed_output", F.lit("")), F.coalesce("compare_output", F.lit("")))
    df = df.withColumn("shown", shown)
    fields = {
        "input": F.coalesce("input", F.lit("")), "output": F.col("shown.output"), "answer_a": F.col("shown.answer_a"), "answer_b": F.col("shown.answer_b"),
        "context": context_text(F.coalesce("context", F.array().cast("array<struct<role:string,content:string>>"))),
        "expected_behavior": F.coalesce("expected_behavior", F.lit("")), "criteria": F.col("criteria_text"),
    }
    return df.select(
        F.concat_ws(":", "judge", "id", "p.probe", F.col("trial").cast("string")).alias("request_id"), "judge", F.col("id").alias("case_id"), "mode",
        F.col("p.probe").alias("probe"), "trial", "pad_side", "labels", F.col("shown.output").alias("shown_output"), F.col("shown.answer_a").alias("answer_a"),
        F.col("shown.answer_b").alias("answer_b"), "expected_behavior", F.col("known_criteria").alias("criteria"), prompts.render(F.col("prompt"), fields).alias("prompt"),
    )


def remaining(requests: DataFrame, judgments: DataFrame) -> DataFrame:
    """Requests without a judgment yet (resume)."""
    return requests.join(judgments.select("request_id").distinct(), "request_id", "left_anti")


def judge_rows(requests: DataFrame, judge: Callable[[str, int], str]) -> DataFrame:
    """Judgments of requests by a Python judge (prompt, trial) -> answer, in Arrow batches; an exception becomes `error`.

    The judge is called once a row in the task that holds it; make it a cheap client, opened lazily for each worker.
    """
    out = "request_id string, judge string, case_id string, mode string, probe string, trial int, pad_side string, verdict string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, failed = [], []
            for prompt, trial in zip(b["prompt"], b["trial"], strict=True):
                try:
                    said.append(judge(prompt, int(trial)))
                    failed.append(None)
                except Exception as e:  # a judge's own failure is a result
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield b[["request_id", "judge", "case_id", "mode", "probe", "trial", "pad_side"]].assign(verdict=said, error=failed)

    return requests.select("request_id", "judge", "case_id", "mode", "probe", "trial", "pad_side", "prompt").mapInPandas(run, out)


class LineProcess:
    """A command that answers each JSON line on its stdin by one on its stdout."""

    def __init__(self, argv: list[str]):
        self.proc = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", bufsize=1)
        self.lines: queue.Queue[str | None] = queue.Queue()
        threading.Thread(target=self._read, daemon=True).start()

    def _read(self) -> None:
        for line in self.proc.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def ask(self, request: dict, timeout: float) -> dict:
        """TimeoutError or ValueError for one bad answer; ConnectionError when the command has ended or can no longer be trusted."""
        try:
            self.proc.stdin.write(json.dumps(request, ensure_ascii=False) + "\n")
            self.proc.stdin.flush()
            line = self.lines.get(timeout=timeout)
        except queue.Empty:
            raise TimeoutError(f"no response within {timeout:g}s") from None
        except OSError as e:
            raise ConnectionError(f"judge command exited: {e}") from e
        if line is None:
            raise ConnectionError(f"judge command exited with {self.proc.wait()}")
        answer = json.loads(line)
        if not isinstance(answer, dict):
            raise ValueError("the answer is no JSON object")
        return answer

    def close(self) -> None:
        self.proc.kill()
        self.proc.wait()


def judge_command(requests: DataFrame, argv: list[str], enable: bool = False, timeout: float = 120.0) -> DataFrame:
    """Judgments by a command of the user's own, off unless enabled: one process a task, one JSON line a request and an answer.

    An answer is {"verdict": ...}. A late answer is an error and the process is started anew, as its late line would be
    taken for the next answer. When the command ends, that request is an error and the rest of its task's requests get no
    judgment, so that a later run asks them again.
    """
    if not enable:
        raise PermissionError("judge commands are off; pass enable=True to start the command you name")
    keep = ["request_id", "judge", "case_id", "mode", "probe", "trial", "pad_side"]
    out = "request_id string, judge string, case_id string, mode string, probe string, trial int, pad_side string, verdict string, error string, seconds double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process, ended = None, False
        try:
            for b in batches:
                found = []
                for text in b["request"]:
                    if ended:
                        break
                    row, begun, verdict, error = json.loads(text), time.monotonic(), None, None
                    try:
                        process = process or LineProcess(argv)
                        said = process.ask(row, timeout).get("verdict")
                        verdict = None if said is None else str(said)
                    except TimeoutError as e:
                        error = str(e)
                        process.close()
                        process = None
                    except ValueError as e:
                        error = f"{type(e).__name__}: {e}"
                    except OSError as e:
                        error, ended = str(e), True
                    found.append((*(row.get(k) for k in keep), verdict, error, time.monotonic() - begun))
                if found:
                    yield pd.DataFrame(found, columns=[*keep, "verdict", "error", "seconds"])
        finally:
            if process:
                process.close()

    shown = ("shown_output", "answer_a", "answer_b")
    return requests.select(F.to_json(F.struct(*[c for c in requests.columns if c not in shown])).alias("request")).mapInPandas(run, out)


def control_longer(requests: DataFrame) -> DataFrame:
    """A control judge: the longer answer wins, A on ties."""
    return requests.withColumn("verdict", F.when(F.length("answer_a") >= F.length("answer_b"), "A").otherwise("B"))


def control_coin(requests: DataFrame) -> DataFrame:
    """A control judge: the parity of the first byte of the request's sha256."""
    byte = F.conv(F.substring(F.sha2("request_id", 256), 1, 2), 16, 10).cast("int")
    return requests.withColumn("verdict", F.when(byte % 2 == 0, "A").otherwise("B"))


def calls_per_judge(requests: DataFrame, judges: DataFrame, unit_price: float = 0.0) -> DataFrame:
    """judge, calls, cost for every judge, 0 without requests."""
    n = requests.groupBy("judge").agg(F.count(F.lit(1)).alias("calls"))
    out = judges.select(F.col("id").alias("judge")).join(n, "judge", "left").withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long"))
    return out.withColumn("cost", F.bround(F.col("calls") * F.lit(float(unit_price)), 4))


def run_log(judgments: DataFrame) -> DataFrame:
    """judge, calls, ok, errors."""
    return judgments.groupBy("judge").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"))
