"""Queries on plans, labels, cases and exports, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.prompts import PAD_TEXT
from ..operators import judging, labelling, planning, suites
from ..sinks import exports
from . import adapters
from .adapters import duck, run_sql

PROMPT = "Q: {input} A: {answer_a} B: {answer_b} O: {output} C: {context} E: {expected_behavior} K: {criteria} {\"verdict\": \"A\"}"


def _criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "right", "is right"), (1, "short", "is short")], "pos int, id string, description string")


def _judges(spark: SparkSession) -> DataFrame:
    rows = [(0, "j0", "pairwise", ["A", "B"], PROMPT, None, ["right"]), (1, "j4", "pointwise", ["pass", "fail"], PROMPT, "ollama:m", ["short"]), (2, "j9", "pointwise", ["pass", "fail"], PROMPT, "x", ["nope"])]
    return spark.createDataFrame(rows, "pos int, id string, mode string, labels array<string>, prompt string, provider string, criteria array<string>")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_sql(spark, sf_dir, adapters.CASES)
    crit = F.when(F.col("pos") % 37 == 2, F.array().cast("array<string>")).when(F.col("pos") % 41 == 3, F.array(F.lit("right"), F.lit("nope"))).otherwise(F.array(F.lit("short"), F.lit("right")))
    context = F.when(F.col("pos") % 4 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return c.withColumns({"criteria": crit, "context": context, "reference_output": F.lit(None).cast("string"), "tags": F.array(F.concat(F.lit("cluster:"), F.col("source")))})


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _cases(spark, sf_dir).filter("status = 'ready'").withColumn("index", F.col("pos"))
    df = planning.build_requests(ready, _judges(spark), _criteria(spark), 5, ("swap", "pad"), 3)
    return df.select("request_id", "probe", "trial", "pad_side", F.array_join("criteria", ",").alias("criteria"), F.md5("prompt").alias("prompt_md5"))


def prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts stand for judges' prompts."""
    df = run_sql(spark, sf_dir, "SELECT item_id, text FROM @benchmark@")
    return df.select("item_id", prompts.prompt_hash(F.col("text")).alias("prompt_hash"))


def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _cases(spark, sf_dir).filter("status = 'ready'")
    df = planning.build_requests(ready, _judges(spark), _criteria(spark), 5, ("swap", "pad"), 3)
    return planning.calls_per_judge(df, _judges(spark), 0.25)


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = run_sql(spark, sf_dir, adapters.JUDGMENTS).drop("verdict")
    done = run_sql(spark, sf_dir, adapters.JUDGMENTS).filter("trial < 2 AND CAST(case_id AS BIGINT) % 2 = 0")
    return planning.remaining(req, done).groupBy("judge", "probe").agg(F.count(F.lit(1)).alias("calls"))


def control_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = run_sql(spark, sf_dir, adapters.JUDGMENTS).select("request_id", "case_id", F.concat("request_id", F.lit("xx")).alias("answer_a"), F.repeat("case_id", F.lit(3)).alias("answer_b"))
    longer = planning.control_longer(req).select("request_id", F.col("verdict").alias("longer"))
    return longer.join(planning.control_coin(req).select("request_id", F.col("verdict").alias("coin")), "request_id")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, adapters.JUDGMENTS).withColumn("error", F.when(F.col("verdict").isNull(), "no answer"))
    return planning.run_log(df)


def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = run_sql(spark, sf_dir, adapters.LABELERS).select("case_id", "labeler", "label")
    new = run_sql(spark, sf_dir, "SELECT CAST(doc_id AS STRING) AS case_id, 'p1' AS labeler, 'tie' AS label, doc_id AS row FROM @labels@ WHERE doc_id % 2 = 0")
    return labelling.upsert(old, new)


def import_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, """SELECT doc_id AS row, CASE WHEN doc_id % 10 = 1 THEN 'nowhere' ELSE CAST(doc_id AS STRING) END AS case_id,
      CASE doc_id % 5 WHEN 0 THEN 'model_a' WHEN 1 THEN ' b ' WHEN 2 THEN 'maybe' WHEN 3 THEN '  ' ELSE 'B' END AS label, 'p' AS labeler FROM @labels@""")
    cases = run_sql(spark, sf_dir, "SELECT CAST(doc_id AS STRING) AS case_id, 'pairwise' AS mode FROM @labels@").withColumn("allowed", F.array(F.lit("A"), F.lit("B")))
    return labelling.check_import(rows, cases)


def uncertain_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).filter("status = 'ready'").withColumn("id", F.col("trace_id"))
    sig = judging.signals(judging.label_counts(run_sql(spark, sf_dir, adapters.JUDGMENTS)))
    return labelling.pick_cases(cases, sig, 24)


def label_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).withColumn("stratum", F.col("observed_failure").cast("string"))
    return labelling.spread_rank(cases).select("id", "stratum", "turn")


def balanced_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id AS pos, d.lang AS category, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS label FROM @labels@ l JOIN @documents@ d ON d.doc_id = l.doc_id")
    return labelling.balanced_head(rows, 20)


def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    again = cases.filter("pos % 61 = 0")
    return suites.case_errors(cases.unionByName(again), _criteria(spark)).groupBy("place", "problem").agg(F.count(F.lit(1)).alias("n"))


def rubric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.rubric_errors(_criteria(spark), _judges(spark))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.status_counts(_cases(spark, sf_dir))


def criteria_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.with_criteria(_cases(spark, sf_dir), _criteria(spark)).select("id", "criteria_text", F.size("known_criteria").alias("n_known"))


def case_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.case_modes(_cases(spark, sf_dir), _judges(spark)).select("case_id", "mode", F.array_join("allowed", "|").alias("allowed"))


def export_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exports.jsonl_rows(suites.export_cases(_cases(spark, sf_dir), _criteria(spark)))
    return rows.select("id", F.md5("input").alias("input_md5"), F.size("context").alias("turns"), F.array_join("criteria", ",").alias("criteria"), "observed_output", F.array_join("metadata.tags", ",").alias("tags"))


def grader_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = spark.createDataFrame([("j0", "trustworthy"), ("j4", "trustworthy"), ("j9", "biased")], "judge string, verdict string")
    return suites.pick_grader(_judges(spark), checked).select("id", "provider")


def csv_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    full = suites.export_cases(cases, _criteria(spark)).join(cases.select(F.col("id").alias("__i"), "compare_output"), F.col("id") == F.col("__i")).drop("__i")
    sheet = exports.label_sheet_rows(full, suites.case_modes(cases, _judges(spark)))
    return sheet.select("case_id", "mode", "allowed_labels", F.length("input").alias("n_input"), "reply", "answer_b", "criteria", "earlier_turns")


def draft_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run_sql(spark, sf_dir, adapters.DOC_TRACES).withColumns({
        "input": F.col("text"), "output": F.lit("o"), "messages": F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), "model": F.lit("m"),
        "tools": F.when(F.col("pos") % 5 == 0, F.array(F.lit("kb"))).otherwise(F.array().cast("array<string>"))}).drop("cluster", "failure")
    picks = run_sql(spark, sf_dir, adapters.DOC_TRACES).filter("pos % 50 = 0").select("id", "cluster", F.array(F.lit("why")).alias("reasons"), "failure", F.col("pos").alias("place"))
    old = t.filter("pos % 200 = 0").select(F.col("id").alias("trace_id"))
    return suites.draft_cases(t, picks, old).select("id", "trace_id", F.array_join("tags", ",").alias("tags"), "observed_failure", F.size("context").alias("turns"))


QUERIES = {f.__name__: f for f in (plan_requests, prompt_hash, plan_counts, resume_anti, control_judges, run_log, label_upsert, import_reject, uncertain_pick, label_spread, balanced_head, validate_errors, rubric_errors, status_counts, criteria_join, case_modes, export_cases, grader_pick, csv_sheet, draft_cases)}

# ---- DuckDB --------------------------------------------------------------------------------------------------------

_C = f"""cs AS (SELECT *, CASE WHEN pos % 37 = 2 THEN []::VARCHAR[] WHEN pos % 41 = 3 THEN ['right', 'nope'] ELSE ['short', 'right'] END AS criteria,
  CASE WHEN pos % 37 = 2 THEN '' WHEN pos % 41 = 3 THEN '- right: is right' ELSE '- short: is short' || chr(10) || '- right: is right' END AS ct,
  CASE WHEN pos % 4 = 0 THEN 'user: hi' ELSE '(none)' END AS ctx, 'cluster:' || source AS tag FROM ({duck(adapters.CASES)}))"""
_JJ = "jj AS (SELECT * FROM (VALUES (0, 'j0', 'pairwise'), (1, 'j4', 'pointwise'), (2, 'j9', 'pointwise')) v(pos, judge, mode))"
_PL = """pl AS (SELECT cs.*, jj.judge, jj.mode, p.probe, t.trial, CASE WHEN probe = 'pad' THEN CASE WHEN mode = 'pointwise' THEN 'output' WHEN cs.pos % 2 = 0 THEN 'A' ELSE 'B' END END AS pad_side
  FROM cs CROSS JOIN jj CROSS JOIN (VALUES ('none', 5), ('swap', 3), ('pad', 3)) p(probe, n) CROSS JOIN (SELECT unnest(range(5))::INTEGER AS trial) t
  WHERE status = 'ready' AND trial < n AND (mode <> 'pairwise' OR coalesce(compare_output, '') <> '') AND (probe <> 'swap' OR mode = 'pairwise'))"""
_PADDED = f"chr(10) || chr(10) || '{PAD_TEXT}'"
ORACLE = {
    "prompt_hash": "SELECT item_id, substring(sha256(text), 1, 12) AS prompt_hash FROM benchmark",
    "plan_requests": f"""WITH {_C}, {_JJ}, {_PL}, s AS (SELECT *, observed_output || CASE WHEN probe = 'pad' AND pad_side IN ('A', 'output') THEN {_PADDED} ELSE '' END AS a,
  CASE WHEN probe = 'pad' AND pad_side = 'B' THEN rtrim(compare_output) || {_PADDED} ELSE compare_output END AS b FROM pl),
  w AS (SELECT *, 'Q: ' || input || ' A: ' || CASE WHEN mode = 'pairwise' THEN CASE WHEN probe = 'swap' THEN b ELSE a END ELSE '{{answer_a}}' END || ' B: ' ||
    CASE WHEN mode = 'pairwise' THEN CASE WHEN probe = 'swap' THEN a ELSE b END ELSE '{{answer_b}}' END || ' O: ' || CASE WHEN mode = 'pairwise' THEN '{{output}}' ELSE a END || ' C: ' || ctx || ' E: ' || expected_behavior || ' K: ' || ct || ' {{"verdict": "A"}}' AS prompt FROM s)
  SELECT judge || ':' || id || ':' || probe || ':' || trial AS request_id, probe, trial, pad_side, array_to_string(list_filter(criteria, lambda c: c <> 'nope'), ',') AS criteria, md5(prompt) AS prompt_md5 FROM w""",
    "plan_counts": f"WITH {_C}, {_JJ}, {_PL} SELECT jj.judge, count(pl.id) AS calls, round_even(count(pl.id) * 0.25::DOUBLE, 4) AS cost FROM jj LEFT JOIN pl USING (judge) GROUP BY jj.judge",
    "resume_anti": f"SELECT judge, probe, count(*) AS calls FROM ({duck(adapters.JUDGMENTS)}) WHERE NOT (trial < 2 AND case_id::BIGINT % 2 = 0) GROUP BY ALL",
    "control_judges": f"SELECT request_id, CASE WHEN length(request_id) + 2 >= 3 * length(case_id) THEN 'A' ELSE 'B' END AS longer, CASE WHEN ('0x' || substr(sha256(request_id), 1, 2))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS coin FROM ({duck(adapters.JUDGMENTS)})",
    "run_log": f"SELECT judge, count(*) AS calls, count(verdict) AS ok, count(*) - count(verdict) AS errors FROM ({duck(adapters.JUDGMENTS)}) GROUP BY judge",
    "label_upsert": f"""WITH o AS ({duck(adapters.LABELERS)}), n AS (SELECT doc_id::VARCHAR AS case_id FROM labels WHERE doc_id % 2 = 0)
  SELECT case_id, labeler, label FROM o WHERE NOT (labeler = 'p1' AND case_id IN (SELECT case_id FROM n)) UNION ALL SELECT case_id, 'p1', 'tie' FROM n""",
    "import_reject": """WITH r AS (SELECT doc_id AS row, CASE WHEN doc_id % 10 = 1 THEN 'nowhere' ELSE doc_id::VARCHAR END AS case_id, doc_id % 5 AS k FROM labels)
  SELECT row, case_id, CASE WHEN case_id <> 'nowhere' THEN CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 4 THEN 'B' END END AS label, 'p' AS labeler,
    CASE WHEN k = 3 THEN 'blank' WHEN case_id = 'nowhere' OR k = 2 THEN 'rejected' ELSE 'imported' END AS outcome,
    CASE WHEN k = 3 THEN NULL WHEN case_id = 'nowhere' THEN 'no such case' WHEN k = 2 THEN 'label maybe is not allowed' END AS problem FROM r""",
    "label_spread": f"""WITH {_C}, r AS (SELECT id, observed_failure::VARCHAR AS stratum, tag, row_number() OVER (PARTITION BY observed_failure, tag ORDER BY md5('0:' || id), id) AS r FROM cs)
  SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY r, md5('0:' || tag), tag)::INTEGER AS turn FROM r""",
    "balanced_head": """WITH r AS (SELECT d.doc_id::VARCHAR AS id, d.doc_id AS pos, d.lang AS category, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  f AS (SELECT category, min(pos) AS f FROM r GROUP BY category), k AS (SELECT r.*, f, row_number() OVER (PARTITION BY label, r.category ORDER BY id) AS rk FROM r JOIN f ON f.category = r.category),
  a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rk, f) AS at_ FROM k) SELECT id, category, label FROM a ORDER BY at_, label LIMIT 20""",
    "validate_errors": f"""WITH {_C}, al AS (SELECT * FROM cs UNION ALL SELECT * FROM cs WHERE pos % 61 = 0), e AS (
  SELECT 'cases[' || id || ']' AS place, 'duplicate case id' AS problem FROM cs WHERE pos % 61 = 0
  UNION ALL SELECT 'cases[' || id || ']', 'status must be one of draft, ready, dropped' FROM al WHERE status NOT IN ('draft', 'ready', 'dropped')
  UNION ALL SELECT 'cases[' || id || ']', 'empty input' FROM al WHERE status = 'ready' AND trim(input) = ''
  UNION ALL SELECT 'cases[' || id || '].expected_behavior', 'missing or still TODO' FROM al WHERE status = 'ready' AND contains(expected_behavior, 'TODO')
  UNION ALL SELECT 'cases[' || id || '].criteria', 'no criteria' FROM al WHERE status = 'ready' AND len(criteria) = 0
  UNION ALL SELECT 'cases[' || id || '].criteria', 'unknown criterion nope' FROM al WHERE status = 'ready' AND list_contains(criteria, 'nope')) SELECT place, problem, count(*) AS n FROM e GROUP BY ALL""",
    "rubric_errors": "SELECT 'rubric.judges[2].criteria' AS place, 'unknown criterion nope' AS problem",
    "status_counts": f"WITH {_C} SELECT status, count(*) AS cases FROM cs GROUP BY status",
    "criteria_join": f"WITH {_C} SELECT id, ct AS criteria_text, len(list_filter(criteria, lambda c: c <> 'nope'))::INTEGER AS n_known FROM cs",
    "case_modes": f"WITH {_C} SELECT id AS case_id, CASE WHEN coalesce(compare_output, '') <> '' THEN 'pairwise' ELSE 'pointwise' END AS mode, CASE WHEN coalesce(compare_output, '') <> '' THEN 'A|B' ELSE 'pass|fail' END AS allowed FROM cs",
    "export_cases": f"WITH {_C} SELECT id, md5(input) AS input_md5, CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS turns, array_to_string(criteria, ',') AS criteria, observed_output, tag AS tags FROM cs WHERE status = 'ready'",
    "grader_pick": "SELECT 'j4' AS id, 'ollama:m' AS provider",
    "csv_sheet": f"""WITH {_C} SELECT id AS case_id, CASE WHEN coalesce(compare_output, '') <> '' THEN 'pairwise' ELSE 'pointwise' END AS mode, CASE WHEN coalesce(compare_output, '') <> '' THEN 'A | B' ELSE 'pass | fail' END AS allowed_labels,
  (CASE WHEN length(input) > 32000 THEN 32000 + 49 ELSE length(input) END)::INTEGER AS n_input, observed_output AS reply, coalesce(compare_output, '') AS answer_b, ct AS criteria, CASE WHEN pos % 4 = 0 THEN 'user: hi' ELSE '' END AS earlier_turns FROM cs WHERE status = 'ready'""",
    "draft_cases": f"""WITH t AS ({duck(adapters.DOC_TRACES)}), o AS (SELECT count(*) AS k FROM t WHERE pos % 200 = 0), n AS (SELECT *, row_number() OVER (ORDER BY pos) + (SELECT k FROM o) AS n FROM t WHERE pos % 50 = 0 AND pos % 200 <> 0)
  SELECT 'case-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id, id AS trace_id, concat_ws(',', 'route:' || route, 'model:m', CASE WHEN pos % 5 = 0 THEN 'tool:kb' END, CASE WHEN error THEN 'error' END, 'feedback:' || feedback, 'cluster:' || cluster) AS tags,
    failure AS observed_failure, 0 AS turns FROM n""",
}
