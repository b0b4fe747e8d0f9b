"""A folder of tables and the steps from logs to a checked suite: each reads what the ones before it wrote.

Tables are Parquet on any path Spark can write. A step that rewrites what it reads writes a copy first.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import redact, text
from .operators import dedupe, judging, labelling, planning, selection, suites, traces
from .sinks import exports
from .sources import formats, records
from .staging import stage

UPDATABLE = ("expected_behavior", "criteria", "reference_output", "compare_output", "status", "tags")
STEPS = ("traces", "picks", "cases", "rubric", "requests", "judgments", "labels", "checked")
_JUDGES = "pos int, id string, mode string, labels array<string>, prompt string, provider string, criteria array<string>"


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- tables ----

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"{self.root}/{name} not found; steps in order: {', '.join(STEPS)}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        stage(df, name).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.table(name)

    def status(self) -> dict[str, int | None]:
        """Rows of each table there is, None for those to come."""
        return {s: self.table(s).count() if self.has(s) else None for s in STEPS}

    # ---- logs to cases ----

    def ingest(self, path: str, fmt: str | None = None, redacted: bool = True) -> DataFrame:
        """Files or a folder of logs to traces; returns the summary. Files of unknown format fail, naming them."""
        raw = stage(records.load_records(self.spark, path), "raw")
        kinds = [(r["file"], fmt or r["format"]) for r in records.detect_formats(raw).collect()]
        if unknown := [f for f, k in kinds if k is None]:
            raise ValueError(f"could not detect the log format of {unknown[:5]}; pass fmt as one of {', '.join(records.FORMATS)}")
        parts = []
        for k in sorted({k for _, k in kinds}):
            files = self.spark.createDataFrame([(f,) for f, x in kinds if x == k], "file string")
            parts.append(formats.parse(raw.join(F.broadcast(files), "file", "left_semi"), k))
        parsed = stage(reduce(DataFrame.unionByName, parts), "parsed")
        self.save("sources", traces.source_report(parsed).join(records.fingerprints(self.spark, path).withColumnRenamed("path", "file"), "file", "left"))
        self.save("skipped", parsed.filter("skip_reason IS NOT NULL").groupBy("source.file", "skip_reason").agg(F.count(F.lit(1)).alias("records")))
        # files in the order of their names, records in the order of their places
        number = {f: i for i, f in enumerate(sorted(f for f, _ in kinds))}
        order = self.spark.createDataFrame([(f, i) for f, i in number.items()], "__f string, __n long")
        kept = parsed.filter("skip_reason IS NULL").drop("skip_reason").join(F.broadcast(order), F.col("source.file") == F.col("__f"))
        kept = traces.unique_ids(kept.withColumn("pos", F.col("__n") * (1 << 40) + F.col("source.index")).drop("__f", "__n"))
        if redacted:
            clean = redact.redact_text
            found = kept.select("id", F.explode(F.concat(F.transform("messages", lambda m: m["content"]), F.map_values("metadata"), F.array("system"))).alias("t")).filter("t IS NOT NULL")
            self.save("redactions", redact.counts_by_kind(found, "id", "t").groupBy("id", "kind").agg(F.sum("n").alias("n")))
            kept = kept.withColumns({
                "messages": F.transform("messages", lambda m: F.struct(m["role"].alias("role"), clean(m["content"]).alias("content"))),
                "input": clean(F.col("input")), "output": clean(F.col("output")), "system": clean(F.col("system")), "metadata": F.transform_values("metadata", lambda _, v: clean(v)),
            })
        return traces.summary(self.save("traces", kept))

    def select(self, n: int = 50, share: float = 0.3, threshold: float = 0.9, stratify: tuple[str, ...] = (), clusters: int | None = None, seed: int = 0, on_output: bool = False) -> DataFrame:
        """Picks: unique traces, clustered, then chosen with a reason each."""
        t = self.table("traces").withColumn("failure", text.is_failure(F.col("error"), F.col("feedback")))
        said = text.user_text(F.col("messages"), F.col("input"))
        t = t.withColumn("text", F.concat_ws("\n", said, "output") if on_output else said)
        groups = dedupe.near_groups(t.select("id", "pos", "text", "failure"), threshold)
        reps = groups.select("rep", "represents", "failing").distinct()
        unique = stage(t.join(reps, F.col("id") == F.col("rep")).drop("rep"), "unique")
        clustered, terms = selection.topic_clusters(unique, n, clusters, seed)
        clustered = stage(clustered.drop("features"), "clustered")
        picks = self.spark.createDataFrame(selection.select_traces(clustered, n, share, stratify), "id string, cluster long, failure boolean, reasons array<string>")
        self.save("clusters", self.spark.createDataFrame([(c, w) for c, w in terms.items()], "cluster int, terms array<string>"))
        place = self.spark.createDataFrame([(r["id"], i) for i, r in enumerate(picks.collect())], "id string, place int")
        return self.save("picks", picks.join(place, "id").join(unique.select("id", "represents", "failing"), "id"))

    def draft(self) -> DataFrame:
        """Cases for picks that have none yet; cases there are stay as they are."""
        old = self.table("cases") if self.has("cases") else None
        known = old if old is not None else self.spark.createDataFrame([], "trace_id string")
        new = suites.draft_cases(self.table("traces").drop("cluster", "failure"), self.table("picks"), known)
        return self.save("cases", old.unionByName(new) if old is not None else new)

    def update_case(self, case_id: str, **fields) -> None:
        if bad := set(fields) - set(UPDATABLE):
            raise ValueError(f"cannot update {sorted(bad)}; allowed: {', '.join(UPDATABLE)}")
        if fields.get("status", "ready") not in suites.STATUSES:
            raise ValueError(f"status must be one of {suites.STATUSES}")
        cases = self.table("cases")
        if not cases.filter(F.col("id") == case_id).limit(1).count():
            raise KeyError(f"no case with id {case_id}")
        value = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
        self.save("cases", cases.withColumns({k: F.when(F.col("id") == case_id, value(v)).otherwise(F.col(k)) for k, v in fields.items() if v is not None}))

    def write_rubric(self, rubric: dict) -> DataFrame:
        """Saves criteria and judges; returns the problems."""
        self.save("rubric", self.spark.createDataFrame([(json.dumps(rubric),)], "rubric string"))
        return suites.rubric_errors(*self.rubric())

    def rubric(self) -> tuple[DataFrame, DataFrame]:
        """(criteria, judges)."""
        r = json.loads(self.table("rubric").first().rubric)
        criteria = [(i, c.get("id"), c.get("description")) for i, c in enumerate(r.get("criteria") or [])]
        judges = [(i, j.get("id"), j.get("mode"), j.get("labels"), j.get("prompt"), j.get("provider"), j.get("criteria") or []) for i, j in enumerate(r.get("judges") or [])]
        return self.spark.createDataFrame(criteria, "pos int, id string, description string"), self.spark.createDataFrame(judges, _JUDGES)

    def validate(self) -> DataFrame:
        criteria, judges = self.rubric()
        return suites.rubric_errors(criteria, judges).unionByName(suites.case_errors(self.table("cases"), criteria))

    # ---- judges ----

    def _ready(self) -> DataFrame:
        return self.table("cases").filter("status = 'ready'").withColumn("pos", F.regexp_extract("id", r"(\d+)$", 1).try_cast("long"))

    def plan(self, trials: int = 5, probes: tuple[str, ...] = (), probe_trials: int = 3) -> DataFrame:
        criteria, judges = self.rubric()
        return self.save("requests", planning.build_requests(self._ready(), judges, criteria, trials, probes, probe_trials))

    def run(self, judge: Callable[[str, int], str]) -> DataFrame:
        """Asks a judge for what has no judgment yet, and appends; returns the log."""
        todo = self.table("requests")
        if self.has("judgments"):
            todo = planning.remaining(todo, self.table("judgments").filter("error IS NULL"))
        new = stage(planning.judge_rows(todo, judge), "judged")
        new.write.mode("append").parquet(f"{self.root}/judgments")
        return planning.run_log(new)

    def run_command(self, judge: str, argv: list[str], enable: bool = False, timeout: float = 120.0, restart: bool = False) -> DataFrame:
        """Asks a command for what this judge has no judgment for yet; with restart, for all anew. Returns the log."""
        todo = self.table("requests").filter(F.col("judge") == judge)
        if self.has("judgments") and restart:
            self.save("judgments", self.table("judgments").filter(F.col("judge") != judge))
        elif self.has("judgments"):
            todo = planning.remaining(todo, self.table("judgments").filter("error IS NULL"))
        new = stage(planning.judge_command(todo, argv, enable, timeout), "judged")
        new.drop("seconds").write.mode("append").parquet(f"{self.root}/judgments")
        return new.groupBy("judge").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.bround(F.sum("seconds"), 2).alias("seconds"))

    def check(self, th: judging.Thresholds = judging.Thresholds()) -> DataFrame:
        judged = self.table("judgments").filter("error IS NULL")
        modes = judged.select("case_id", "mode").distinct()
        labels = self.table("labels").join(modes, "case_id") if self.has("labels") else None
        return self.save("checked", judging.check_judges(judged, labels, th))

    # ---- labels and exports ----

    def label(self, n: int = 24, seed: int = 0, again: bool = False) -> DataFrame:
        """Cases to label next, with their strata."""
        cases = self._ready()
        if self.has("labels") and not again:
            cases = cases.join(self.table("labels").select(F.col("case_id").alias("id")).distinct(), "id", "left_anti")
        none = self.spark.createDataFrame([], "case_id string, consensus string, uncertainty double")
        sig = judging.signals(judging.label_counts(self.table("judgments").filter("error IS NULL"))) if self.has("judgments") else none
        return labelling.pick_cases(cases, sig, n, seed)

    def label_sheet(self, picks: DataFrame) -> DataFrame:
        cases = self.table("cases").join(picks.select(F.col("case_id").alias("id")), "id", "left_semi")
        criteria, judges = self.rubric()
        rows = suites.export_cases(cases, criteria).join(cases.select("id", "compare_output"), "id")
        return exports.label_sheet_rows(rows, suites.case_modes(cases, judges))

    def import_labels(self, rows: DataFrame) -> DataFrame:
        """rows: row, case_id, label, labeler. Merges what is valid and returns every row's outcome."""
        checked = stage(labelling.check_import(rows, suites.case_modes(self.table("cases"), self.rubric()[1])), "import")
        old = self.table("labels") if self.has("labels") else self.spark.createDataFrame([], "case_id string, labeler string, label string")
        self.save("labels", labelling.upsert(old, checked.filter("outcome = 'imported'")))
        return checked

    def export(self, folder: str, kinds: tuple[str, ...] = tuple(exports.ROWS), judge: str | None = None) -> DataFrame:
        """Writes the ready cases in each format; refuses while validation finds problems. Returns the manifest.

        The judge that grades is the first trustworthy one, or the one named, whatever its verdict.
        """
        if problems := [f"{r.place}: {r.problem}" for r in self.validate().limit(20).collect()]:
            raise ValueError("fix the suite first: " + "; ".join(problems))
        criteria, judges = self.rubric()
        if judge is not None:
            named = judges.filter(F.col("id") == judge)
            if named.isEmpty():
                raise KeyError(f"no judge with id {judge}")
            grader, any_provider = named.filter("coalesce(provider, '') != ''"), named
        elif self.has("checked"):
            checked = self.table("checked").select("judge", "verdict")
            grader, any_provider = suites.pick_grader(judges, checked), suites.pick_grader(judges, checked, need_provider=False)
        else:
            grader = any_provider = None
        exports.write_export(suites.export_cases(self.table("cases"), criteria), folder, kinds, grader=grader, judge=any_provider)
        return exports.manifest(self.spark, folder)

    def report(self) -> str:
        return exports.report([r.asDict() for r in self.table("checked").orderBy("judge").collect()] if self.has("checked") else [], self.status())
