"""Judge statistics: hand-computed numbers, tiny tables, verdict spellings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats, verdicts
from tracemill.operators import judging

SCHEMA = "judge string, case_id string, mode string, probe string, trial int, pad_side string, verdict string"


def test_hand_computed_statistics(spark):
    df = spark.createDataFrame([(8, 10), (0, 20), (0, 0)], "k int, n int")
    w = [r.w for r in df.select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert (w[0].lo, w[0].hi) == (pytest.approx(0.4902, abs=5e-5), pytest.approx(0.9433, abs=5e-5)) and (w[1].lo, w[2]) == (0.0, None) and w[1].hi == pytest.approx(0.1611, abs=5e-5)
    k = spark.range(1).select(stats.kappa(F.lit(0.7), F.lit(0.5)).alias("k"), stats.kappa_interval(F.lit(0.7), F.lit(0.5), F.lit(50)).alias("ci"), stats.kappa(F.lit(1.0), F.lit(1.0)).alias("none")).first()
    assert k.k == pytest.approx(0.4) and k.ci.lo == pytest.approx(0.146, abs=1e-3) and k.ci.hi == pytest.approx(0.654, abs=1e-3) and k.none is None
    m = spark.createDataFrame([(4, 5, False), (3, 5, False), (5, 5, False), (2, 3, False), (3, 6, True)], "top int, n int, tied boolean")
    got = [r.x for r in m.select(stats.majority_of_3(F.col("top"), F.col("n"), F.col("tied")).alias("x")).collect()]
    assert got == [1.0, pytest.approx(0.7), 1.0, None, None]
    same = [r.x for r in m.select(stats.majority_of(3, F.col("top"), F.col("n"), F.col("tied")).alias("x")).collect()]
    assert same == pytest.approx(got, nan_ok=True) if None not in got else [x is None or x == pytest.approx(y) for x, y in zip(same, got, strict=True)]


SPELLINGS = [
    ("A", "pairwise", "A"), ("**B**", "pairwise", "B"), ("[[A]]", "pairwise", "A"), ("Assistant B is better", "pairwise", "B"), ("[[C]]", "pairwise", "tie"), ("I think both", "pairwise", "invalid"), (None, "pairwise", "invalid"),
    ("PASS.", "pointwise", "pass"), ("4.0", "pointwise", "4"), ("4.5", "pointwise", "4.5"), ("", "pointwise", "invalid"), ('{"pass": false, "reason": "x"}', "pointwise", "fail"), ('{"verdict":"B"}', "pairwise", "B"), ('{"score": 1}', "pairwise", "invalid"),
    ('{"pass": true, "reas', "pointwise", "pass"), ('```json\n{"label": "A"}\n```', "pairwise", "A"), ('{"verdict": {"label": "A"}}', "pairwise", "A"), ('{"verdict": null}', "pairwise", "invalid"), ("first", "pairwise", "A"), ("2", "pairwise", "B"), ('{"label": 4.0}', "pointwise", "4"), ("{nothing", "pointwise", "invalid"),
]


def test_verdict_spellings(spark):
    df = spark.createDataFrame([(i, a, m) for i, (a, m, _) in enumerate(SPELLINGS)], "i int, a string, m string")
    got = {r.i: r.x for r in df.select("i", verdicts.verdict_label(F.col("a"), F.col("m")).alias("x")).collect()}
    assert [got[i] for i in range(len(SPELLINGS))] == [w for *_, w in SPELLINGS]


def table(spark, rows):
    return spark.createDataFrame([("j", c, m, p, t, s, v) for c, m, p, t, s, v in rows], SCHEMA)


def test_flips_ties_and_agreement(spark):
    rows = [(f"c{i}", "pointwise", None, t, None, "pass" if i % 2 == 0 else "fail") for i in range(10) for t in range(3)]
    rows[0] = ("c0", "pointwise", "none", 0, None, "fail")
    rows += [("tie", "pointwise", "none", t, None, v) for t, v in enumerate(["pass", "fail"])]
    labels = spark.createDataFrame([(f"c{i}", "pass" if i % 2 == 0 else "fail", "pointwise") for i in range(10)] + [("c1", "pass", "pointwise")], "case_id string, label string, mode string")
    r = judging.check_judges(table(spark, rows), labels, judging.Thresholds(min_labeled=5)).first()
    assert (r.cases, r.flips, r.flip_rate, r.labeled, r.accuracy, r.kappa) == (10, 1, 0.1, 9, 1.0, 1.0)  # c1's labelers tie
    assert r.self_agreement == round((9 + 0.6667) / 10, 4) and r.verdict == "trustworthy"
    one = {x.case_id: x for x in judging.per_case(judging.label_counts(table(spark, rows))).collect()}
    assert one["tie"].majority is None and one["tie"].flipped and one["c0"].majority == "pass"
    assert judging.check_judges(table(spark, rows)).first().verdict == "not_enough_data"


def test_always_first_shown_is_biased_and_padding_moves(spark):
    rows = [(f"c{i}", "pairwise", p, t, "A" if p == "pad" else None, "A") for i in range(12) for p in ("none", "swap", "pad") for t in range(3)]
    r = judging.check_judges(table(spark, rows)).first()
    assert (r.consistency, r.first_rate, r.pad_changed, r.verdict) == (0.0, 1.0, 0.0, "biased")
    rows = [(f"c{i}", "pairwise", p, t, "B" if p == "pad" else None, "B" if p == "pad" and i < 5 else "A") for i in range(10) for p in ("none", "pad") for t in range(3)]
    r = judging.check_judges(table(spark, rows)).first()
    assert (r.pad_changed, r.toward_padded, r.verdict) == (0.5, 0.5, "biased")
    m = judging.meters(judging.check_judges(table(spark, rows))).first()
    assert (m.padding, m.risk, m.position) == ("critical", "critical", None)


def test_requests_complete_short_judgments(spark):
    req = spark.createDataFrame([("r1", "j", "c", "pairwise", "none")], "request_id string, judge string, case_id string, mode string, probe string")
    short = spark.createDataFrame([("r1", "A")], "request_id string, verdict string")
    assert judging.with_requests(short, req).first().case_id == "c"
    with pytest.raises(Exception, match="judgment without a case"):
        judging.with_requests(spark.createDataFrame([("nope", "A")], "request_id string, verdict string"), req).collect()


def test_empty_judgments(spark):
    assert judging.check_judges(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_over_ranges_are_dense_and_ordered(spark):
    from tracemill.operators.numbering import numbered

    df = spark.range(500).selectExpr("CASE WHEN id % 50 = 7 THEN NULL ELSE (id * 37) % 400 END AS pos", "id AS index0").repartition(5)
    got = sorted(((r["index"], r.pos) for r in numbered(df, "pos").collect()), key=lambda x: x[0])
    assert [i for i, _ in got] == list(range(500))
    assert [p for _, p in got] == sorted((p for _, p in got), key=lambda p: -1 if p is None else p)
    assert numbered(df.limit(0), "pos").collect() == []
