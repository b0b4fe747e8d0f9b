"""Queries on judge reliability, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, verdicts
from ..operators import judging
from ..staging import stage
from . import adapters
from .adapters import duck, run_sql

TH = judging.Thresholds()


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(judging.label_counts(run_sql(spark, sf_dir, adapters.JUDGMENTS)), "judge-counts")


def _human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.human_labels(run_sql(spark, sf_dir, adapters.HUMAN))


def judge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.check_judges(run_sql(spark, sf_dir, adapters.JUDGMENTS), run_sql(spark, sf_dir, adapters.HUMAN), TH)


def per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.per_case(_counts(spark, sf_dir)).withColumn("mo3", stats.round4(F.col("mo3")))


def flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return judging.stability(judging.per_case(c), c, TH)


def accuracy_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return judging.agreement(judging.per_case(c), c, _human(spark, sf_dir), TH)


def position_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return judging.position_probe(judging.per_case(c), c)


def padding_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.padding_probe(judging.per_case(_counts(spark, sf_dir)))


def meters_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.meters(judge_verdict(spark, sf_dir))


def balance_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, human = judging.per_case(_counts(spark, sf_dir)), _human(spark, sf_dir)
    return judging.balance_warnings(judging.confusion(cases, human, TH), human.join(cases.select("case_id").distinct(), "case_id", "left_semi"))


def judge_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judging.signals(_counts(spark, sf_dir))
    return df.withColumns({c: F.array_join(c, ",") for c in ("flipped", "pad_moved")})


def label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.human_labels(run_sql(spark, sf_dir, adapters.LABELERS))


def verdict_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, adapters.JUDGMENTS)
    return df.select("request_id", verdicts.verdict_label(F.col("verdict"), F.col("mode")).alias("label"), verdicts.unswap(verdicts.verdict_label(F.col("verdict"), F.col("mode"))).alias("unswapped"))


def request_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = run_sql(spark, sf_dir, adapters.JUDGMENTS)
    short = full.select("request_id", "verdict")
    return judging.with_requests(short, full.drop("verdict")).groupBy("judge", "probe").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("case_id").alias("cases"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT o_orderkey AS k0, CAST(o_orderkey % 120 + 1 AS BIGINT) AS n, CAST((o_orderkey * 7) % (o_orderkey % 120 + 2) AS BIGINT) AS k FROM @orders@")


def wilson_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.rate(F.col("k"), F.col("n"))
    return _grid(spark, sf_dir).select("k", "n").distinct().select("k", "n", r["rate"].alias("rate"), r["lo"].alias("lo"), r["hi"].alias("hi"))


def mo3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _grid(spark, sf_dir).filter("2 * k > n").select("k", "n").distinct()
    return df.select("k", "n", stats.round4(stats.majority_of_3(F.col("k"), F.col("n"), F.lit(False))).alias("mo3"), stats.round4(stats.majority_of(5, F.col("k"), F.col("n"), F.lit(False))).alias("mo5"))


QUERIES = {f.__name__: f for f in (judge_verdict, per_case, flip_rate, accuracy_kappa, position_probe, padding_probe, meters_risk, balance_warnings, judge_signal, label_resolve, verdict_norm, request_join, wilson_grid, mo3_grid)}

# ---- DuckDB --------------------------------------------------------------------------------------------------------

Z = "1.959963984540054::DOUBLE"


def _wilson(k: str, n: str) -> tuple[str, str, str]:
    p = f"(({k})::DOUBLE / nullif({n}, 0))"
    z2 = f"({Z} * {Z})"
    centre = f"(({p} + {z2} / (2 * {n}::DOUBLE)) / (1 + {z2} / {n}::DOUBLE))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n}::DOUBLE + {z2} / (4 * {n}::DOUBLE * {n}::DOUBLE)) / (1 + {z2} / {n}::DOUBLE))"
    lo, hi = f"greatest(0.0::DOUBLE, {centre} - {half})", f"least(1.0::DOUBLE, {centre} + {half})"
    if_any = lambda x: f"CASE WHEN {n} > 0 THEN round_even({x}, 4) END"
    return f"round_even({p}, 4)", if_any(lo), if_any(hi)


def _norm(v: str) -> str:
    pair = lambda s: f"""CASE WHEN regexp_matches({s}, '(?i)^\\W*(\\[\\[)?\\s*(tie|c|equal|draw|both)\\b') THEN 'tie'
      WHEN regexp_matches({s}, '(?i)^\\W*(\\[\\[)?\\s*(answer\\s*|assistant\\s*|response\\s*)?a\\b') THEN 'A'
      WHEN regexp_matches({s}, '(?i)^\\W*(\\[\\[)?\\s*(answer\\s*|assistant\\s*|response\\s*)?b\\b') THEN 'B' ELSE 'invalid' END"""  # noqa: E731
    field = f"regexp_extract({v}, '\"(verdict|winner)\"\\s*:\\s*\"?([A-Za-z0-9_]+)', 2)"
    return f"CASE WHEN {v} IS NULL THEN 'invalid' WHEN starts_with(trim({v}), '{{') THEN {pair(field)} ELSE {pair(f'trim({v})')} END"


BASE = f"""
WITH j AS ({duck(adapters.JUDGMENTS)}), n AS (SELECT *, {_norm('verdict')} AS presented FROM j),
l AS (SELECT *, CASE WHEN probe = 'swap' AND presented = 'A' THEN 'B' WHEN probe = 'swap' AND presented = 'B' THEN 'A' ELSE presented END AS label FROM n),
c AS (SELECT judge, case_id, probe, label, count(*) AS n FROM l GROUP BY ALL),
x AS (SELECT *, max(n) OVER (PARTITION BY judge, case_id, probe) AS mx FROM c),
m AS (SELECT judge, case_id, probe, sum(n)::BIGINT AS trials, max(n) AS top, count(*) AS labels, count(*) FILTER (n = mx) > 1 AS tied,
  CASE WHEN count(*) FILTER (n = mx) = 1 THEN max(label) FILTER (n = mx) END AS majority FROM x GROUP BY ALL),
pad AS (SELECT judge, case_id, max(pad_side) AS pad_side FROM j WHERE probe = 'pad' GROUP BY ALL),
pc AS (SELECT b.judge, 'pairwise' AS mode, b.case_id, b.trials, b.majority, round_even(b.top::DOUBLE / b.trials, 4) AS majority_share, b.labels > 1 AS flipped,
  CASE WHEN b.trials >= 5 AND NOT b.tied THEN (b.top * (b.top - 1) / 2 * (b.trials - b.top) + b.top * (b.top - 1) * (b.top - 2) / 6)::DOUBLE / (b.trials * (b.trials - 1) * (b.trials - 2) / 6) END AS mo3,
  s.case_id IS NOT NULL AS swapped, s.majority AS swap_majority, p.case_id IS NOT NULL AS padded, p.majority AS pad_majority,
  p.case_id IS NOT NULL AND p.majority IS DISTINCT FROM b.majority AS pad_changed,
  p.case_id IS NOT NULL AND p.majority IS DISTINCT FROM b.majority AND coalesce(p.majority = pad.pad_side, false) AND b.majority IS DISTINCT FROM pad.pad_side AS pad_toward
  FROM m b LEFT JOIN m s ON s.judge = b.judge AND s.case_id = b.case_id AND s.probe = 'swap' LEFT JOIN m p ON p.judge = b.judge AND p.case_id = b.case_id AND p.probe = 'pad'
  LEFT JOIN pad ON pad.judge = b.judge AND pad.case_id = b.case_id WHERE b.probe = 'none'),
h AS (SELECT case_id, label AS human FROM ({duck(adapters.HUMAN)})),
stab0 AS (SELECT judge, mode, count(*) FILTER (trials >= 3) AS cases, count(*) FILTER (trials >= 3 AND flipped) AS flips,
  round_even(avg(majority_share) FILTER (trials >= 3), 4) AS self_agreement, count(*) FILTER (trials >= 3 AND majority IS NULL) AS no_majority,
  round_even(avg(mo3) FILTER (trials >= 3), 4) AS mo3 FROM pc GROUP BY ALL),
calls AS (SELECT judge, count(*) AS calls, count(*) FILTER (presented = 'invalid') AS invalid_outputs FROM n GROUP BY ALL),
stab AS (SELECT judge, mode, cases, flips, {_wilson('flips', 'cases')[0]} AS flip_rate, {_wilson('flips', 'cases')[1]} AS flip_lo, {_wilson('flips', 'cases')[2]} AS flip_hi,
  self_agreement, no_majority, mo3, invalid_outputs, calls FROM stab0 JOIN calls USING (judge)),
conf AS (SELECT judge, coalesce(majority, '(no majority)') AS said, human, count(*) AS n FROM pc JOIN h USING (case_id) WHERE trials >= 3 GROUP BY ALL),
tot AS (SELECT judge, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (said = human), 0)::BIGINT AS correct FROM conf GROUP BY ALL),
sa AS (SELECT judge, said AS x, sum(n) AS a FROM conf GROUP BY ALL), tr AS (SELECT judge, human AS x, sum(n) AS b FROM conf GROUP BY ALL),
ch AS (SELECT judge, sum(a * b) AS ab FROM sa JOIN tr USING (judge, x) GROUP BY ALL), mb AS (SELECT judge, max(b) AS most FROM tr GROUP BY ALL),
si AS (SELECT judge, (count(*) FILTER (label = human))::DOUBLE / count(*) AS single FROM l JOIN h USING (case_id) WHERE probe = 'none' GROUP BY ALL),
po AS (SELECT *, correct::DOUBLE / n AS po, coalesce(ab, 0)::DOUBLE / (n::DOUBLE * n) AS pe FROM tot LEFT JOIN ch USING (judge) JOIN mb USING (judge) LEFT JOIN si USING (judge)),
agr AS (SELECT judge, n AS labeled, correct, {_wilson('correct', 'n')[0]} AS accuracy, {_wilson('correct', 'n')[1]} AS accuracy_lo, {_wilson('correct', 'n')[2]} AS accuracy_hi,
  CASE WHEN pe < 1 THEN round_even((po - pe) / (1 - pe), 4) END AS kappa,
  CASE WHEN pe < 1 THEN round_even(greatest(-1.0::DOUBLE, (po - pe) / (1 - pe) - {Z} * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe)))), 4) END AS kappa_lo,
  CASE WHEN pe < 1 THEN round_even(least(1.0::DOUBLE, (po - pe) / (1 - pe) + {Z} * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe)))), 4) END AS kappa_hi,
  round_even(pe, 4) AS chance_agreement, round_even(single, 4) AS single_call_accuracy, round_even(most::DOUBLE / n, 4) AS majority_baseline FROM po),
pr AS (SELECT judge, count(*) AS n, count(*) FILTER (majority = swap_majority) AS same FROM pc WHERE swapped GROUP BY ALL),
fi AS (SELECT judge, count(*) AS ab, count(*) FILTER (presented = 'A') AS f FROM n WHERE probe IN ('none', 'swap') AND presented IN ('A', 'B') GROUP BY ALL),
pos AS (SELECT judge, n AS swap_cases, {_wilson('same', 'n')[0]} AS consistency, {_wilson('same', 'n')[1]} AS consistency_lo, {_wilson('same', 'n')[2]} AS consistency_hi,
  {_wilson('f', 'ab')[0]} AS first_rate, {_wilson('f', 'ab')[1]} AS first_lo, {_wilson('f', 'ab')[2]} AS first_hi FROM pr LEFT JOIN fi USING (judge)),
pd0 AS (SELECT judge, count(*) AS n, count(*) FILTER (pad_changed) AS ch, count(*) FILTER (pad_toward) AS tw FROM pc WHERE padded GROUP BY ALL),
pdd AS (SELECT judge, n AS pad_cases, {_wilson('ch', 'n')[0]} AS pad_changed, {_wilson('tw', 'n')[0]} AS toward_padded, {_wilson('tw', 'n')[1]} AS toward_lo, {_wilson('tw', 'n')[2]} AS toward_hi FROM pd0),
full_ AS (SELECT *, CASE WHEN cases < 10 THEN 'not_enough_data' WHEN flip_rate > 0.2 THEN 'unstable'
  WHEN (swap_cases >= 10 AND consistency < 0.8) OR (pad_cases >= 10 AND toward_padded > 0.1) THEN 'biased'
  WHEN labeled >= 20 AND (kappa IS NULL OR kappa < 0.4 OR accuracy <= majority_baseline) THEN 'misaligned'
  WHEN coalesce(labeled, 0) < 20 THEN 'not_enough_data' ELSE 'trustworthy' END AS verdict
  FROM stab LEFT JOIN agr USING (judge) LEFT JOIN pos USING (judge) LEFT JOIN pdd USING (judge))
"""
_BAND = "CASE WHEN {0} <= {1} THEN 'good' WHEN {0} <= {2} THEN 'warning' ELSE 'critical' END"
ORACLE = {
    "judge_verdict": BASE + "SELECT * FROM full_",
    "per_case": BASE + "SELECT * REPLACE (round_even(mo3, 4) AS mo3) FROM pc",
    "flip_rate": BASE + "SELECT * FROM stab",
    "accuracy_kappa": BASE + "SELECT * FROM agr",
    "position_probe": BASE + "SELECT * FROM pos",
    "padding_probe": BASE + "SELECT * FROM pdd",
    "meters_risk": BASE + f"""SELECT *, CASE WHEN 'critical' IN (flips, position, padding, agreement) THEN 'critical' WHEN 'warning' IN (flips, position, padding, agreement) THEN 'warning' ELSE 'good' END AS risk
  FROM (SELECT judge, {_BAND.format('coalesce(flip_rate, 0)', 0.2, 0.4)} AS flips, CASE WHEN swap_cases > 0 THEN {_BAND.format('abs(coalesce(first_rate, 0) - 0.5)', 0.1, 0.2)} END AS position,
  CASE WHEN swap_cases > 0 THEN round_even(greatest(coalesce(first_rate, 0), 1 - coalesce(first_rate, 0)), 4) END AS follows,
  CASE WHEN swap_cases > 0 THEN CASE WHEN coalesce(first_rate, 0) >= 0.5 THEN 'first-shown' ELSE 'second-shown' END END AS side,
  CASE WHEN pad_cases > 0 THEN {_BAND.format('coalesce(toward_padded, 0)', 0.1, 0.25)} END AS padding,
  CASE WHEN labeled > 0 THEN CASE WHEN kappa >= 0.4 THEN 'good' WHEN kappa >= 0.2 THEN 'warning' ELSE 'critical' END END AS agreement FROM full_)""",
    "balance_warnings": BASE + """, u AS (SELECT DISTINCT case_id, human FROM h JOIN (SELECT DISTINCT case_id FROM pc) USING (case_id)),
  k AS (SELECT human, count(*) AS k, sum(count(*)) OVER () AS n FROM u GROUP BY human), w AS (SELECT * FROM k ORDER BY k DESC, human DESC LIMIT 1),
  jj AS (SELECT judge, sum(n) AS n, coalesce(sum(n) FILTER (said = human), 0) AS ok, count(DISTINCT said) AS answers, max(said) AS one FROM conf GROUP BY judge),
  b AS (SELECT judge, arg_max(human, (b, human)) AS top, max(b) AS most FROM (SELECT judge, human, sum(n) AS b FROM conf GROUP BY ALL) GROUP BY judge),
  q AS (SELECT *, round_even(ok::DOUBLE / n, 4) AS acc, round_even(most::DOUBLE / n, 4) AS base FROM jj JOIN b USING (judge) WHERE n >= 5)
  SELECT '(labels)' AS about, 'skewed' AS kind, n::BIGINT AS n, human AS top, round_even(k::DOUBLE / n, 4) AS share FROM w WHERE n >= 5 AND k::DOUBLE / n >= 0.8
  UNION ALL SELECT judge, 'constant', n::BIGINT, one, acc FROM q WHERE answers = 1 UNION ALL SELECT judge, 'not better than baseline', n::BIGINT, top, base FROM q WHERE answers > 1 AND acc <= base""",
    "judge_signal": BASE + """, s0 AS (SELECT case_id, majority, count(*) AS n FROM pc WHERE majority IS NOT NULL GROUP BY ALL),
  s1 AS (SELECT case_id, count(*) AS k, CASE WHEN count(*) FILTER (n = mx) = 1 THEN max(majority) FILTER (n = mx) END AS consensus FROM (SELECT *, max(n) OVER (PARTITION BY case_id) AS mx FROM s0) GROUP BY case_id),
  g AS (SELECT case_id, count(*) AS judges, coalesce(string_agg(judge, ',' ORDER BY judge) FILTER (flipped), '') AS flipped, coalesce(string_agg(judge, ',' ORDER BY judge) FILTER (pad_changed), '') AS pad_moved,
    count(*) FILTER (flipped) AS nf, count(*) FILTER (pad_changed) AS np FROM pc GROUP BY case_id)
  SELECT case_id, judges, consensus, coalesce(k > 1, false) AS disagree, flipped, pad_moved,
    round_even(CASE WHEN coalesce(k > 1, false) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + nf::DOUBLE / judges + 0.5::DOUBLE * np / judges, 4) AS uncertainty FROM g LEFT JOIN s1 USING (case_id)""",
    "label_resolve": f"""WITH l AS (SELECT case_id, CASE WHEN label IN ('model_a', 'A') THEN 'A' ELSE 'B' END AS label FROM ({duck(adapters.LABELERS)})),
  c AS (SELECT case_id, label, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT *, max(n) OVER (PARTITION BY case_id) AS mx FROM c)
  SELECT case_id, max(label) FILTER (n = mx) AS human FROM x GROUP BY case_id HAVING count(*) FILTER (n = mx) = 1""",
    "verdict_norm": f"SELECT request_id, label, CASE label WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE label END AS unswapped FROM (SELECT request_id, {_norm('verdict')} AS label FROM ({duck(adapters.JUDGMENTS)}))",
    "request_join": f"SELECT judge, probe, count(*) AS calls, count(DISTINCT case_id) AS cases FROM ({duck(adapters.JUDGMENTS)}) GROUP BY ALL",
    "wilson_grid": f"SELECT k, n, {_wilson('k', 'n')[0]} AS rate, {_wilson('k', 'n')[1]} AS lo, {_wilson('k', 'n')[2]} AS hi FROM (SELECT DISTINCT (o_orderkey % 120 + 1)::BIGINT AS n, ((o_orderkey * 7) % (o_orderkey % 120 + 2))::BIGINT AS k FROM orders)",
    "mo3_grid": """WITH g AS (SELECT DISTINCT (o_orderkey % 120 + 1)::BIGINT AS n, ((o_orderkey * 7) % (o_orderkey % 120 + 2))::BIGINT AS k FROM orders),
  f AS (SELECT k, n, k::DOUBLE AS b, (n - k)::DOUBLE AS o, n::DOUBLE AS m FROM g WHERE 2 * k > n)
  SELECT k, n, CASE WHEN n >= 5 THEN round_even((b * (b - 1) / 2 * o + b * (b - 1) * (b - 2) / 6) / (m * (m - 1) * (m - 2) / 6), 4) END AS mo3,
    CASE WHEN n >= 7 THEN round_even((CASE WHEN b >= 3 THEN b * (b - 1) * (b - 2) / 6 ELSE 0 END * CASE WHEN o >= 2 THEN o * (o - 1) / 2 ELSE 0 END + CASE WHEN b >= 4 THEN b * (b - 1) * (b - 2) * (b - 3) / 24 ELSE 0 END * CASE WHEN o >= 1 THEN o ELSE 0 END
      + CASE WHEN b >= 5 THEN b * (b - 1) * (b - 2) * (b - 3) * (b - 4) / 120 ELSE 0 END) / (m * (m - 1) * (m - 2) * (m - 3) * (m - 4) / 120), 4) END AS mo5 FROM f""",
}
