"""Traces, cases, judgments and labels made from the test tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL whose @table@ marks name Parquet tables of the folder."""
    for name in dict.fromkeys(re.findall(r"@(\w+)@", text)):
        table(spark, sf_dir, name).createOrReplaceTempView(f"tm_{name}")
    return spark.sql(re.sub(r"@(\w+)@", r"tm_\1", text))


def duck(text: str) -> str:
    return re.sub(r"@(\w+)@", r"\1", text)


#: Every document as a single-turn trace; cluster and dist are stand-ins for a clustering, equal in both engines.
DOC_TRACES = """
SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id AS pos, coalesce(d.text, '') AS text, d.source AS route, d.lang AS lang,
       coalesce(l.quality = 0, false) AS error,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' END AS feedback,
       coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false) AS failure,
       d.doc_id % 7 AS cluster, CAST((d.doc_id * 37) % 101 AS DOUBLE) AS dist
FROM @documents@ d LEFT JOIN @labels@ l ON d.doc_id = l.doc_id
"""

#: Judges with known faults over the labelled documents; the truth is A for good quality, else B.
_TRUTH = "CASE WHEN quality = 1 THEN 'A' ELSE 'B' END"
_OTHER = "CASE WHEN quality = 1 THEN 'B' ELSE 'A' END"
_SAID = f"""
CASE judge WHEN 'j0' THEN {_TRUTH}
  WHEN 'j1' THEN CASE WHEN doc_id % 4 <> 0 OR (doc_id * 31 + trial * 7 + pid * 13) % 10 >= 3 THEN {_TRUTH} ELSE {_OTHER} END
  WHEN 'j2' THEN CASE WHEN (doc_id * 31 + trial * 17 + pid * 13) % 10 >= 4 THEN {_TRUTH} ELSE {_OTHER} END
  WHEN 'j3' THEN CASE WHEN probe = 'swap' THEN 'B' ELSE 'A' END
  WHEN 'j4' THEN CASE WHEN doc_id % 3 = 0 THEN {_OTHER} ELSE {_TRUTH} END
  WHEN 'j5' THEN {_TRUTH}
  ELSE CASE WHEN probe = 'pad' AND doc_id % 5 = 0 THEN pad_side ELSE {_TRUTH} END END
"""
_SHOWN = "CASE WHEN probe = 'swap' THEN CASE said WHEN 'A' THEN 'B' ELSE 'A' END ELSE said END"
JUDGMENTS = f"""
SELECT concat(judge, ':', CAST(doc_id AS STRING), ':', probe, ':', CAST(trial AS STRING)) AS request_id, judge, CAST(doc_id AS STRING) AS case_id, 'pairwise' AS mode, probe, trial, pad_side,
  CASE WHEN doc_id % 97 = 5 AND trial = 1 THEN 'I think both' WHEN doc_id % 89 = 7 AND trial = 2 THEN NULL
    WHEN doc_id % 7 = 0 THEN concat('[[', shown, ']]') WHEN doc_id % 7 = 1 THEN concat('Assistant ', shown, ' is better') WHEN doc_id % 7 = 2 THEN concat('**', shown, '**')
    WHEN doc_id % 7 = 3 THEN concat('{{"verdict": "', shown, '", "reason": "x"}}') WHEN doc_id % 7 = 4 THEN concat('  answer ', lower(shown), '.')
    WHEN doc_id % 7 = 5 THEN concat('{{"winner": "', shown, '", "reas') ELSE shown END AS verdict
FROM (SELECT *, {_SHOWN} AS shown FROM (SELECT *, {_SAID} AS said FROM (
  SELECT l.doc_id, coalesce(l.quality, 0) AS quality, j.judge, p.probe, p.pid, t.trial,
         CASE WHEN p.probe = 'pad' THEN CASE WHEN l.doc_id % 2 = 0 THEN 'A' ELSE 'B' END END AS pad_side
  FROM @labels@ l CROSS JOIN (VALUES ('j0'), ('j1'), ('j2'), ('j3'), ('j4'), ('j5'), ('j6')) AS j(judge)
  CROSS JOIN (VALUES ('none', 0), ('swap', 1), ('pad', 2)) AS p(probe, pid) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(trial)
  WHERE (p.probe = 'none' OR t.trial < 3) AND (j.judge <> 'j5' OR l.doc_id < 12)) a) b) c
"""
HUMAN = f"SELECT CAST(doc_id AS STRING) AS case_id, {_TRUTH} AS label, 'pairwise' AS mode FROM (SELECT doc_id, coalesce(quality, 0) AS quality FROM @labels@) q"

#: Three labelers who don't always agree, in several spellings.
LABELERS = """
SELECT CAST(l.doc_id AS STRING) AS case_id, concat('p', CAST(k.k AS STRING)) AS labeler, 'pairwise' AS mode,
  CASE (l.doc_id * 7 + k.k * 5) % 4 WHEN 0 THEN 'model_a' WHEN 1 THEN 'A' WHEN 2 THEN 'Assistant B' ELSE 'model_b' END AS label
FROM @labels@ l CROSS JOIN (VALUES (0), (1), (2)) AS k(k) WHERE (l.doc_id + k.k) % 6 <> 0
"""

#: Conversations as rows; the operators build the traces.
TURNS = "SELECT CAST(conv_id AS STRING) AS id, turn, lower(role) AS role, coalesce(text, '') AS content FROM @conversations@"

#: Cases of the labelled documents: some without a second answer, some drafts, some faulty.
CASES = """
SELECT concat('case-', CAST(l.doc_id AS STRING)) AS id, CAST(l.doc_id AS STRING) AS trace_id, l.doc_id AS pos,
  CASE WHEN l.doc_id % 11 = 3 THEN 'draft' WHEN l.doc_id % 53 = 5 THEN 'done' ELSE 'ready' END AS status,
  CASE WHEN l.doc_id % 29 = 1 THEN ' ' ELSE coalesce(d.text, '') END AS input, concat('reply to ', CAST(l.doc_id AS STRING)) AS observed_output,
  CASE WHEN l.doc_id % 3 <> 0 THEN concat('other reply to ', CAST(l.doc_id AS STRING), '  ') END AS compare_output,
  CASE WHEN l.doc_id % 17 = 4 THEN 'TODO: say' ELSE 'a good answer' END AS expected_behavior,
  coalesce(l.quality = 0, false) AS observed_failure, d.source AS source
FROM @labels@ l JOIN @documents@ d ON d.doc_id = l.doc_id
"""
