"""How far each judge can be trusted: all judges in one pipeline of partial sums.

Rows of judgments: judge, case_id, mode, probe (none, swap, pad; null is none), trial, pad_side, verdict (text). They
are counted by (judge, case, probe, label) first, with a combine on the map side, so that a judge or case with a third
of all rows is a few partial counts before anything is shuffled. Everything after works on those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, verdicts
from ..functions.stats import round4
from ..staging import stage

NO_MAJORITY = "(no majority)"


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the published verdicts."""

    min_trials: int = 3
    min_cases: int = 10
    max_flip_rate: float = 0.2
    min_position_consistency: float = 0.8
    max_toward_padded_rate: float = 0.1
    min_kappa: float = 0.4
    min_labeled: int = 20
    beat_majority_baseline: bool = True


def with_requests(judgments: DataFrame, requests: DataFrame) -> DataFrame:
    """Judgments in the short form (request_id, verdict) take the other columns from their request; own values win.

    Raises on rows whose case is named neither by themselves nor by a request.
    """
    theirs = requests.select(*[F.col(c).alias(f"__{c}") for c in requests.columns])
    both = judgments.join(theirs, judgments["request_id"] == theirs["__request_id"], "left")
    cols = dict.fromkeys([*requests.columns, *judgments.columns])
    pick = [F.coalesce(*[F.col(x) for x in (c, f"__{c}") if x in both.columns]).alias(c) for c in cols]
    out = both.select(*pick)
    missing = F.raise_error(F.concat(F.lit("judgment without a case: "), F.coalesce("request_id", F.lit("null"))))
    return out.withColumn("case_id", F.when(F.col("case_id").isNull(), missing.cast("string")).otherwise(F.col("case_id")))


def labelled(judgments: DataFrame) -> DataFrame:
    """Adds label: the canonical verdict, in the original order of the answers; presented: the same as it was given."""
    given = verdicts.verdict_label(F.col("verdict"), F.col("mode"))
    df = judgments.withColumn("probe", F.coalesce("probe", F.lit("none"))).withColumn("presented", given)
    return df.withColumn("label", F.when(F.col("probe") == "swap", verdicts.unswap(F.col("presented"))).otherwise(F.col("presented")))


def label_counts(judgments: DataFrame) -> DataFrame:
    """judge, mode, case_id, probe, presented, label, pad_side, n."""
    return labelled(judgments).groupBy("judge", "mode", "case_id", "probe", "presented", "label", "pad_side").agg(F.count(F.lit(1)).alias("n"))


def majorities(counts: DataFrame, keys: list[str], label: str = "label", n: str = "n") -> DataFrame:
    """keys, trials, majority (null if the top count is tied), share, labels (number of different ones), top, tied."""
    by = counts.groupBy(*keys, label).agg(F.sum(n).alias("__n"))
    top = by.groupBy(*keys).agg(F.sum("__n").alias("trials"), F.max("__n").alias("top"), F.max_by(label, "__n").alias("__best"), F.count(F.lit(1)).alias("labels"), F.sort_array(F.collect_list("__n"), asc=False).alias("__all"))
    tied = F.coalesce(F.get("__all", F.lit(1)) == F.col("top"), F.lit(False))
    top = top.withColumn("tied", tied).withColumn("majority", F.when(~F.col("tied"), F.col("__best")))
    return top.withColumn("share", F.col("top") / F.col("trials")).drop("__best", "__all")


def per_case(counts: DataFrame) -> DataFrame:
    """One row for each judge and case with plain trials: its majority, flips, and the majorities under swap and padding."""
    m = majorities(counts, ["judge", "mode", "case_id", "probe"])
    sides = counts.filter("probe = 'pad'").groupBy("judge", "case_id").agg(F.max("pad_side").alias("pad_side"))
    of = lambda probe, c: F.max(F.when(F.col("probe") == probe, F.col(c)))
    wide = m.groupBy("judge", "mode", "case_id").agg(
        of("none", "trials").alias("trials"), of("none", "majority").alias("majority"), of("none", "share").alias("share"),
        of("none", "labels").alias("labels"), of("none", "top").alias("top"), of("none", "tied").alias("tied"),
        of("swap", "trials").isNotNull().alias("swapped"), of("swap", "majority").alias("swap_majority"),
        of("pad", "trials").isNotNull().alias("padded"), of("pad", "majority").alias("pad_majority"),
    )
    wide = wide.join(sides, ["judge", "case_id"], "left")
    toward = verdicts.moved_toward(F.col("pad_majority"), F.col("majority"), F.col("mode"), F.col("pad_side"))
    moved = F.col("padded") & ~F.col("pad_majority").eqNullSafe(F.col("majority"))
    return wide.filter("trials IS NOT NULL").select(
        "judge", "mode", "case_id", "trials", "majority", round4(F.col("share")).alias("majority_share"),
        (F.col("labels") > 1).alias("flipped"), stats.majority_of_3(F.col("top"), F.col("trials"), F.col("tied")).alias("mo3"),
        "swapped", "swap_majority", "padded", "pad_majority", moved.alias("pad_changed"), (moved & toward).alias("pad_toward"),
    )


def human_labels(labels: DataFrame) -> DataFrame:
    """case_id, human: the strict majority over labelers; ties are dropped. labels: case_id, label, mode (or none)."""
    mode = F.col("mode") if "mode" in labels.columns else F.lit("pointwise")
    canon = labels.filter("label IS NOT NULL").select("case_id", verdicts.human_label(F.col("label"), mode).alias("label"))
    m = majorities(canon.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")), ["case_id"])
    return m.filter("majority IS NOT NULL").select("case_id", F.col("majority").alias("human"))


def stability(cases: DataFrame, counts: DataFrame, th: Thresholds) -> DataFrame:
    """One row for each judge: flip rate, self-agreement, majority-of-3 stability, invalid outputs, calls."""
    ok = F.col("trials") >= th.min_trials
    own = cases.groupBy("judge", "mode").agg(
        F.count_if(ok).alias("cases"), F.count_if(ok & F.col("flipped")).alias("flips"),
        round4(F.avg(F.when(ok, F.col("majority_share")))).alias("self_agreement"),
        F.count_if(ok & F.col("majority").isNull()).alias("no_majority"),
        round4(F.avg(F.when(ok, F.col("mo3")))).alias("mo3"),
    )
    calls = counts.groupBy("judge").agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(F.col("presented") == verdicts.INVALID, F.col("n"))), F.lit(0)).alias("invalid_outputs"))
    r = stats.rate(F.col("flips"), F.col("cases"))
    return own.join(calls, "judge").select(
        "judge", "mode", "cases", "flips", r["rate"].alias("flip_rate"), r["lo"].alias("flip_lo"), r["hi"].alias("flip_hi"),
        "self_agreement", "no_majority", "mo3", "invalid_outputs", "calls",
    )


def confusion(cases: DataFrame, human: DataFrame, th: Thresholds) -> DataFrame:
    """judge, said, human, n over cases with enough trials and a human label."""
    m = cases.filter(F.col("trials") >= th.min_trials).join(human, "case_id")
    return m.groupBy("judge", F.coalesce("majority", F.lit(NO_MAJORITY)).alias("said"), "human").agg(F.count(F.lit(1)).alias("n"))


def agreement(cases: DataFrame, counts: DataFrame, human: DataFrame, th: Thresholds) -> DataFrame:
    """One row for each judge with labelled cases: accuracy, kappa with interval, single-call accuracy, majority baseline."""
    conf = confusion(cases, human, th)
    said = conf.groupBy("judge", F.col("said").alias("x")).agg(F.sum("n").alias("a"))
    true = conf.groupBy("judge", F.col("human").alias("x")).agg(F.sum("n").alias("b"))
    chance = said.join(true, ["judge", "x"]).groupBy("judge").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    base = true.groupBy("judge").agg(F.max("b").alias("most"))
    total = conf.groupBy("judge").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("said") == F.col("human"), F.col("n"))), F.lit(0)).alias("correct"))
    single = counts.filter("probe = 'none'").join(human, "case_id").groupBy("judge").agg(
        (F.coalesce(F.sum(F.when(F.col("label") == F.col("human"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("single"))
    df = total.join(chance, "judge", "left").join(base, "judge").join(single, "judge", "left")
    n = F.col("n").cast("double")
    df = df.withColumns({"po": F.col("correct") / n, "pe": F.coalesce("ab", F.lit(0)) / (n * n)})
    k, ci, r = stats.kappa(F.col("po"), F.col("pe")), stats.kappa_interval(F.col("po"), F.col("pe"), n), stats.rate(F.col("correct"), F.col("n"))
    return df.select(
        "judge", F.col("n").alias("labeled"), F.col("correct"), r["rate"].alias("accuracy"), r["lo"].alias("accuracy_lo"), r["hi"].alias("accuracy_hi"),
        round4(k).alias("kappa"), round4(ci["lo"]).alias("kappa_lo"), round4(ci["hi"]).alias("kappa_hi"), round4(F.col("pe")).alias("chance_agreement"),
        round4(F.col("single")).alias("single_call_accuracy"), round4(F.col("most") / n).alias("majority_baseline"),
    )


def position_probe(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each pairwise judge with swapped trials: consistency of majorities, share of first-shown answers."""
    pairs = cases.filter("mode = 'pairwise' AND swapped").groupBy("judge").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("majority") == F.col("swap_majority")).alias("same"))
    shown = counts.filter("mode = 'pairwise' AND probe IN ('none', 'swap') AND presented IN ('A', 'B')").groupBy("judge").agg(
        F.sum("n").alias("ab"), F.coalesce(F.sum(F.when(F.col("presented") == "A", F.col("n"))), F.lit(0)).alias("first"))
    c, f = stats.rate(F.col("same"), F.col("n")), stats.rate(F.col("first"), F.col("ab"))
    return pairs.join(shown, "judge", "left").select(
        "judge", F.col("n").alias("swap_cases"), c["rate"].alias("consistency"), c["lo"].alias("consistency_lo"), c["hi"].alias("consistency_hi"),
        f["rate"].alias("first_rate"), f["lo"].alias("first_lo"), f["hi"].alias("first_hi"))


def padding_probe(cases: DataFrame) -> DataFrame:
    """One row for each judge with padded trials: majorities that changed, and those that moved to the padded answer."""
    df = cases.filter("padded").groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.count_if("pad_changed").alias("changed"), F.count_if("pad_toward").alias("toward"))
    c, t = stats.rate(F.col("changed"), F.col("n")), stats.rate(F.col("toward"), F.col("n"))
    return df.select("judge", F.col("n").alias("pad_cases"), c["rate"].alias("pad_changed"), t["rate"].alias("toward_padded"), t["lo"].alias("toward_lo"), t["hi"].alias("toward_hi"))


def verdict(th: Thresholds) -> Column:
    """The verdict ladder over a judge's rounded rates."""
    unstable = F.col("flip_rate") > th.max_flip_rate
    position = (F.col("swap_cases") >= th.min_cases) & (F.col("consistency") < th.min_position_consistency)
    padding = (F.col("pad_cases") >= th.min_cases) & (F.col("toward_padded") > th.max_toward_padded_rate)
    low = F.col("kappa").isNull() | (F.col("kappa") < th.min_kappa)
    if th.beat_majority_baseline:
        low = low | (F.col("accuracy") <= F.col("majority_baseline"))
    enough = F.coalesce(F.col("labeled") >= th.min_labeled, F.lit(False))
    return (
        F.when(F.col("cases") < th.min_cases, "not_enough_data")
        .when(unstable, "unstable")
        .when(F.coalesce(position, F.lit(False)) | F.coalesce(padding, F.lit(False)), "biased")
        .when(enough & low, "misaligned")
        .when(~enough, "not_enough_data")
        .otherwise("trustworthy")
    )


def check_judges(judgments: DataFrame, labels: DataFrame | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """One row for each judge: stability, agreement with people, both probes, and its verdict."""
    counts = stage(label_counts(judgments), "judge-counts")  # read by each part below
    cases = stage(per_case(counts), "judge-cases")
    out = stability(cases, counts, th)
    if labels is None:
        labels = judgments.sparkSession.createDataFrame([], "case_id string, label string, mode string")
    for part in (agreement(cases, counts, human_labels(labels), th), position_probe(cases, counts), padding_probe(cases)):
        out = out.join(part, "judge", "left")
    return out.withColumn("verdict", verdict(th))


def meters(checked: DataFrame) -> DataFrame:
    """Risk bands of check_judges() rows: flips, position, padding, agreement, and the worst of them."""
    flip = stats.band(F.coalesce("flip_rate", F.lit(0.0)), 0.2, 0.4)
    first = F.coalesce("first_rate", F.lit(0.0))
    pos = F.when(F.col("swap_cases") > 0, stats.band(F.abs(first - 0.5), 0.1, 0.2))
    pad = F.when(F.col("pad_cases") > 0, stats.band(F.coalesce("toward_padded", F.lit(0.0)), 0.1, 0.25))
    agree = F.when(F.col("labeled") > 0, F.when(F.col("kappa") >= 0.4, "good").when(F.col("kappa") >= 0.2, "warning").otherwise("critical"))
    df = checked.select("judge", flip.alias("flips"), pos.alias("position"), F.when(F.col("swap_cases") > 0, round4(F.greatest(first, 1 - first))).alias("follows"), F.when(F.col("swap_cases") > 0, F.when(first >= 0.5, "first-shown").otherwise("second-shown")).alias("side"), pad.alias("padding"), agree.alias("agreement"))
    return df.withColumn("risk", stats.worst(F.col("flips"), F.col("position"), F.col("padding"), F.col("agreement")))


def balance_warnings(conf: DataFrame, used: DataFrame, min_cases: int = 5, share: float = 0.8) -> DataFrame:
    """(about, kind, n, top, share): skewed human labels, judges no better than the baseline, judges of one answer.

    conf: confusion(); used: case_id, human of the judged cases.
    """
    w = Window.partitionBy()
    by = used.groupBy("human").agg(F.count(F.lit(1)).alias("k")).withColumns({"n": F.sum("k").over(w), "r": F.row_number().over(Window.orderBy(F.desc("k"), F.desc("human")))})
    skew = by.filter((F.col("r") == 1) & (F.col("n") >= min_cases) & (F.col("k") / F.col("n") >= share)).select(F.lit("(labels)").alias("about"), F.lit("skewed").alias("kind"), "n", F.col("human").alias("top"), round4(F.col("k") / F.col("n")).alias("share"))
    said = conf.groupBy("judge", "said").agg(F.sum("n").alias("k")).groupBy("judge").agg(F.count(F.lit(1)).alias("answers"), F.max_by("said", "k").alias("one"))
    true = conf.groupBy("judge", "human").agg(F.sum("n").alias("k")).groupBy("judge").agg(F.max("k").alias("most"), F.max_by("human", F.struct("k", "human")).alias("top"))
    tot = conf.groupBy("judge").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("said") == F.col("human"), F.col("n"))), F.lit(0)).alias("ok"))
    j = tot.join(said, "judge").join(true, "judge").filter(F.col("n") >= min_cases).withColumns({"acc": round4(F.col("ok") / F.col("n")), "base": round4(F.col("most") / F.col("n"))})
    constant = j.filter("answers = 1").select(F.col("judge").alias("about"), F.lit("constant").alias("kind"), "n", F.col("one").alias("top"), F.col("acc").alias("share"))
    no_better = j.filter("answers > 1 AND acc <= base").select(F.col("judge").alias("about"), F.lit("not better than baseline").alias("kind"), "n", "top", F.col("base").alias("share"))
    return skew.unionByName(constant).unionByName(no_better)


def signals(counts: DataFrame) -> DataFrame:
    """One row for each case: consensus of the judges' majorities, who flipped or moved under padding, and the uncertainty."""
    cases = per_case(counts)
    said = majorities(cases.filter("majority IS NOT NULL").groupBy("case_id", F.col("majority").alias("label")).agg(F.count(F.lit(1)).alias("n")), ["case_id"])
    by = cases.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("judges"), F.array_sort(F.collect_set(F.when(F.col("flipped"), F.col("judge")))).alias("flipped"),
        F.array_sort(F.collect_set(F.when(F.col("pad_changed"), F.col("judge")))).alias("pad_moved"))
    df = by.join(said.select("case_id", F.col("majority").alias("consensus"), (F.col("labels") > 1).alias("__d")), "case_id", "left").withColumn("disagree", F.coalesce("__d", F.lit(False)))
    n = F.greatest(F.lit(1), F.col("judges")).cast("double")
    score = F.when(F.col("disagree"), 2.0).otherwise(0.0) + F.size("flipped") / n + F.lit(0.5) * F.size("pad_moved") / n
    return df.select("case_id", "judges", "consensus", "disagree", "flipped", "pad_moved", round4(score).alias("uncertainty"))
