"""Queries on traces: keys, duplicates, strata, budgets, selection, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import redact, text
from ..operators import dedupe, selection, traces
from . import adapters
from .adapters import duck, run_sql

N = 40
STRATIFY = ("lang",)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, adapters.DOC_TRACES)


def unique_doc_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents as unique traces, in the shape selection takes."""
    t = _docs(spark, sf_dir)
    reps = dedupe.exact_groups(t).select(F.col("rep").alias("id"))
    u = t.join(reps, "id", "left_semi")
    tools = F.when(F.col("pos") % 5 == 0, F.array(F.lit("kb_search"))).otherwise(F.array().cast("array<string>"))
    return u.select("id", "pos", "cluster", "dist", "failure", "error", "feedback", "route", F.lit(None).cast("string").alias("model"), tools.alias("tools"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), "text")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", text.text_hash(F.col("text")).alias("hash"))


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_groups(_docs(spark, sf_dir)).select("hash", "rep", "represents", "failing")


def dedupe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir)
    return dedupe.membership(t, dedupe.exact_groups(t))


def failure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", text.is_failure(F.col("error"), F.col("feedback")).alias("failure"), text.failure_kind(F.col("error"), F.col("feedback")).alias("kind"))


def feedback_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "CASE event_id % 9 WHEN 0 THEN 'Thumbs Up' WHEN 1 THEN ' NO ' WHEN 2 THEN 'meh' WHEN 3 THEN '4.5' WHEN 4 THEN '-2' WHEN 5 THEN 'great' WHEN 6 THEN '0.2' WHEN 7 THEN '3' ELSE event_type END"
    df = run_sql(spark, sf_dir, f"SELECT event_id, value, {said} AS said FROM @events@")
    return df.select("event_id", text.feedback_of_text(F.col("said")).alias("from_text"), text.feedback_of_number(F.col("value")).alias("from_number"))


def trace_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces.from_turns(run_sql(spark, sf_dir, adapters.TURNS))
    return t.select("id", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"), F.size("messages").alias("n_messages"), F.size(text.prior_turns(F.col("messages"))).alias("n_prior"), F.md5(text.user_text(F.col("messages"), F.col("input"))).alias("user_md5"), (F.size(F.filter("messages", lambda m: m["role"] == "user")) > 1).alias("multi_turn"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summary(_docs(spark, sf_dir), top=20)


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id").cast("long")
    tools = F.when(k % 5 == 0, F.array(F.lit("kb"), F.lit("calc"))).when(k % 3 == 0, F.array(F.lit("kb"))).otherwise(F.array().cast("array<string>"))
    t = traces.from_turns(run_sql(spark, sf_dir, adapters.TURNS))
    return traces.summary(t.withColumns({"error": k % 6 == 0, "feedback": F.when(k % 4 == 0, "negative"), "route": F.concat(F.lit("/r"), (k % 3).cast("string")), "tools": tools}))


def dup_id_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, "SELECT CAST(user_id AS STRING) AS id, event_id AS pos FROM @events@")
    return traces.unique_ids(df).select("pos", "id")


def skip_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, "SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN ' ' ELSE coalesce(text, '') END AS input, CASE WHEN doc_id % 26 = 0 THEN '' ELSE 'x' END AS output FROM @documents@")
    return df.withColumn("reason", traces.skip_reason(F.col("input"), F.col("output"))).filter("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("skipped"))


def strata_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.strata_histogram(unique_doc_traces(spark, sf_dir), N, STRATIFY)


def failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.failure_budget(unique_doc_traces(spark, sf_dir), N)


def failure_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.failure_round_robin(unique_doc_traces(spark, sf_dir), 12)


def cluster_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cluster_shares(unique_doc_traces(spark, sf_dir))


def quota_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unique_doc_traces(spark, sf_dir)
    have = selection.failure_round_robin(u, 12).groupBy("cluster").agg(F.count(F.lit(1)).alias("have"))
    return selection.quotas(selection.cluster_shares(u), have, N, 12)


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.counts_by_kind(_docs(spark, sf_dir), "id", "text")


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", F.sha2(redact.redact_text(F.col("text")), 256).alias("sha"))


def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, "SELECT o_orderkey AS k, CAST(4000000000000000 + o_orderkey * 7919 AS STRING) AS digits FROM @orders@")
    return df.select("k", redact.is_card(F.col("digits")).alias("card"))


def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.near_groups(_docs(spark, sf_dir))


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unique_doc_traces(spark, sf_dir).select("id", "text")
    df, _ = selection.topic_clusters(u, N)
    return df.select("id", "cluster", "dist")


def select_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = selection.select_traces(unique_doc_traces(spark, sf_dir), N, stratify=STRATIFY)
    return spark.createDataFrame(picks, "id string, cluster long, failure boolean, reasons array<string>")


QUERIES = {f.__name__: f for f in (text_keys, exact_dedupe, dedupe_members, failure_flags, feedback_norm, trace_build, ingest_summary, ingest_report, dup_id_suffix, skip_accounting, strata_histogram, failure_budget, failure_round_robin, cluster_shares, quota_remainder, redact_counts, redact_text, luhn_cards, near_dup_groups, topic_clusters, select_picks)}

# ---- DuckDB --------------------------------------------------------------------------------------------------------

_T = f"t AS ({duck(adapters.DOC_TRACES)}), k AS (SELECT *, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM t)"
_G = f"{_T}, g AS (SELECT hash, arg_min(id, (NOT failure, pos)) AS rep, count(*) AS represents, count(*) FILTER (failure) AS failing FROM k GROUP BY hash)"
_U = f"{_G}, u AS (SELECT t.* FROM t JOIN g ON g.rep = t.id)"
_F = """v AS (SELECT field, value, count(*) AS count FROM (
  SELECT 'route' AS field, route AS value, 0 AS o FROM u WHERE coalesce(route, '') <> '' UNION ALL SELECT 'tools', CASE WHEN pos % 5 = 0 THEN 'kb_search' ELSE '(none)' END, 1 FROM u
  UNION ALL SELECT 'error', error::VARCHAR, 2 FROM u UNION ALL SELECT 'feedback', coalesce(feedback, '(none)'), 3 FROM u UNION ALL SELECT 'lang', lang, 4 FROM u WHERE lang IS NOT NULL) GROUP BY field, value)"""
_RR = "rr AS (SELECT id, pos, cluster, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, pos) AS rank FROM u WHERE failure) JOIN (SELECT cluster, count(*) AS size FROM u GROUP BY cluster) USING (cluster) ORDER BY rank, size DESC, cluster LIMIT 12)"
ORACLE = {
    "text_keys": f"WITH {_T} SELECT id, hash FROM k",
    "exact_dedupe": f"WITH {_G} SELECT * FROM g",
    "dedupe_members": f"WITH {_G} SELECT k.id, g.rep FROM k JOIN g USING (hash)",
    "failure_flags": f"WITH {_T} SELECT id, failure, CASE WHEN error AND feedback = 'negative' THEN 'error flag + negative user feedback' WHEN error THEN 'error flag' WHEN feedback = 'negative' THEN 'negative user feedback' ELSE '' END AS kind FROM t",
    "feedback_norm": """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'positive' WHEN 4 THEN 'negative' WHEN 5 THEN NULL WHEN 6 THEN 'negative' WHEN 7 THEN 'neutral'
  ELSE CASE WHEN event_type IN ('like', 'good') THEN 'positive' WHEN event_type IN ('bad', 'fail') THEN 'negative' END END AS from_text,
  CASE WHEN value IS NULL OR isnan(value) OR value > 5 THEN NULL WHEN value < 0.5 THEN 'negative' WHEN value <= 1 THEN 'positive' WHEN value <= 2 THEN 'negative' WHEN value >= 4 THEN 'positive' ELSE 'neutral' END AS from_number FROM events""",
    "trace_build": f"""WITH r AS ({duck(adapters.TURNS)}), m AS (SELECT * FROM r WHERE role NOT IN ('system', 'developer')),
  a AS (SELECT id, count(*) AS n_messages, max(turn) FILTER (role = 'user') AS lu, arg_max(content, turn) FILTER (role = 'user') AS input, max_by(struct_pack(r := role, c := content), turn) AS last,
    string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'user') AS ut, count(*) FILTER (role = 'user') AS nu FROM m GROUP BY id)
  SELECT id, md5(coalesce(input, '')) AS input_md5, md5(CASE WHEN last.r = 'assistant' THEN last.c ELSE '' END) AS output_md5, n_messages::INTEGER AS n_messages,
    (SELECT count(*) FROM m WHERE m.id = a.id AND m.turn < a.lu)::INTEGER AS n_prior, md5(coalesce(ut, '')) AS user_md5, nu > 1 AS multi_turn FROM a""",
    "ingest_summary": f"""WITH {_T}, r AS (SELECT coalesce(route, 'none') AS value, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
  SELECT 'traces' AS metric, '' AS value, count(*) AS count FROM t UNION ALL SELECT 'with_error', '', count(*) FILTER (error) FROM t
  UNION ALL SELECT 'feedback', coalesce(feedback, 'none'), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'route', value, count FROM r""",
    "ingest_report": f"""WITH r AS ({duck(adapters.TURNS)}), t AS (SELECT id, id::BIGINT AS k, count(*) FILTER (role = 'user') AS nu FROM r GROUP BY id)
  SELECT 'traces' AS metric, '' AS value, count(*) AS count FROM t UNION ALL SELECT 'with_error', '', count(*) FILTER (k % 6 = 0) FROM t UNION ALL SELECT 'multi_turn', '', count(*) FILTER (nu > 1) FROM t
  UNION ALL SELECT 'feedback', CASE WHEN k % 4 = 0 THEN 'negative' ELSE 'none' END, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'route', '/r' || k % 3, count(*) FROM t GROUP BY 2
  UNION ALL SELECT 'tool', 'kb', count(*) FROM t WHERE k % 5 = 0 OR k % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'tool', 'calc', count(*) FROM t WHERE k % 5 = 0 HAVING count(*) > 0""",
    "dup_id_suffix": "SELECT event_id AS pos, CASE WHEN n > 1 THEN id || '~' || n ELSE id END AS id FROM (SELECT event_id, user_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)",
    "skip_accounting": """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN ' ' ELSE coalesce(text, '') END AS input, CASE WHEN doc_id % 26 = 0 THEN '' ELSE 'x' END AS output FROM documents)
  SELECT source, CASE WHEN trim(output) = '' THEN 'empty input and output' ELSE 'no user message' END AS reason, count(*) AS skipped FROM d WHERE trim(input, ' ' || chr(9) || chr(10) || chr(13)) = '' GROUP BY ALL""",
    "strata_histogram": f"""WITH {_U}, {_F} SELECT field, value, count, CASE WHEN nv > 20 THEN nv || ' distinct values (limit 20)' WHEN nv = 1 AND field <> 'lang' THEN 'one value' END AS skipped FROM (SELECT *, count(*) OVER (PARTITION BY field) AS nv FROM v)""",
    "failure_budget": f"WITH {_U} SELECT count(*) AS \"unique\", count(*) FILTER (failure) AS failures, least(count(*) FILTER (failure), {N}, greatest(ceil(0.3 * {N})::BIGINT, round_even((count(*) FILTER (failure))::DOUBLE / greatest(count(*), 1) * {N}, 0)::BIGINT))::BIGINT AS budget FROM u",
    "failure_round_robin": f"WITH {_U}, {_RR} SELECT * FROM rr",
    "cluster_shares": f"WITH {_U} SELECT cluster, count(*) AS size, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM u GROUP BY cluster",
    "quota_remainder": f"""WITH {_U}, {_RR}, s AS (SELECT cluster, count(*) AS size, sum(count(*)) OVER () AS total FROM u GROUP BY cluster), h AS (SELECT cluster, count(*) AS have FROM rr GROUP BY cluster),
  q AS (SELECT cluster, greatest(0.0::DOUBLE, {N}.0::DOUBLE * size / total - coalesce(have, 0)) AS need FROM s LEFT JOIN h USING (cluster)),
  w AS (SELECT *, floor(need) AS whole, {N} - 12 - sum(floor(need)) OVER () AS left_, row_number() OVER (ORDER BY need - floor(need) DESC, cluster) AS rk FROM q)
  SELECT cluster, need, (whole + CASE WHEN rk <= left_ THEN 1 ELSE 0 END)::BIGINT AS take FROM w""",
    "luhn_cards": """SELECT k, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN (2 * d[i]::INT) // 10 + (2 * d[i]::INT) % 10 ELSE d[i]::INT END)) % 10 = 0 AS card
  FROM (SELECT o_orderkey AS k, (4000000000000000 + o_orderkey * 7919)::VARCHAR AS d FROM orders)""",
}
