"""Cases and rubrics: drafting from picks, validation as rows of problems, export rows, the grader to wire in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import context_text, prior_turns

STATUSES = ("draft", "ready", "dropped")
TODO = "TODO"


def case_tags() -> Column:
    """route, model, tool, error, feedback and cluster tags, in this order."""
    one = lambda c, x: F.when(c, F.array(x)).otherwise(F.array().cast("array<string>"))
    named = lambda name: one(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"{name}:"), F.col(name)))
    tools = F.transform(F.coalesce("tools", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tool:"), t))
    return F.concat(named("route"), named("model"), tools, one(F.coalesce("error", F.lit(False)), F.lit("error")), named("feedback"), F.array(F.concat(F.lit("cluster:"), F.col("cluster").cast("string"))))


def draft_cases(traces: DataFrame, picks: DataFrame, existing: DataFrame) -> DataFrame:
    """New cases for picks (id, cluster, reasons, failure, place) that no existing case (trace_id) has, numbered on.

    The picks are few (one for each case wanted), so the numbering window is over a small table.
    """
    known = existing.select(F.col("trace_id").alias("id")).distinct()
    start = existing.count()
    new = picks.join(known, "id", "left_anti")
    df = traces.join(F.broadcast(new.select("id", "cluster", "reasons", "failure", "place")), "id")
    df = df.withColumn("n", F.row_number().over(Window.orderBy("place")) + start)
    number = F.when(F.length(F.col("n").cast("string")) < 3, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))
    return df.select(
        F.concat(F.lit("case-"), number).alias("id"), F.col("id").alias("trace_id"), F.lit("draft").alias("status"), F.col("reasons").alias("selected_because"), "input",
        prior_turns(F.col("messages")).alias("context"), F.col("output").alias("observed_output"), F.col("failure").alias("observed_failure"),
        F.lit("TODO: one or two sentences on what a good answer does").alias("expected_behavior"), F.array(F.lit("TODO-criterion-id")).alias("criteria"),
        F.lit(None).cast("string").alias("reference_output"), F.lit(None).cast("string").alias("compare_output"), case_tags().alias("tags"),
    )


def has_todo(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit(TODO)), F.lit(False))


def case_errors(cases: DataFrame, criteria: DataFrame) -> DataFrame:
    """(place, problem) rows: duplicate ids, bad status, and for ready cases empty input, TODO texts, missing or unknown criteria."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    at = F.concat(F.lit("cases["), F.coalesce("id", F.lit("")), F.lit("]"))
    rule = lambda df, place, what: df.select(place.alias("place"), F.lit(what).alias("problem") if isinstance(what, str) else what.alias("problem"))
    ready = cases.filter("coalesce(status, 'draft') = 'ready'")
    eb = F.col("expected_behavior")
    twice = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    unknown = ready.select("id", F.explode("criteria").alias("cid")).join(F.broadcast(criteria.select(F.col("id").alias("cid"))), "cid", "left_anti")
    found = [
        rule(twice, at, "duplicate case id"),
        rule(cases.filter(~F.coalesce("status", F.lit("draft")).isin(*STATUSES)), at, "status must be one of draft, ready, dropped"),
        rule(ready.filter(blank(F.col("input"))), at, "empty input"),
        rule(ready.filter(blank(eb) | has_todo(eb)), F.concat(at, F.lit(".expected_behavior")), "missing or still TODO"),
        rule(ready.filter(F.size(F.coalesce("criteria", F.array().cast("array<string>"))) == 0), F.concat(at, F.lit(".criteria")), "no criteria"),
        rule(unknown, F.concat(at, F.lit(".criteria")), F.concat(F.lit("unknown criterion "), F.col("cid"))),
        rule(ready.filter(has_todo(F.col("reference_output"))), F.concat(at, F.lit(".reference_output")), "still TODO"),
    ]
    return reduce(DataFrame.unionByName, found)


def rubric_errors(criteria: DataFrame, judges: DataFrame) -> DataFrame:
    """(place, problem) rows of a rubric: criteria (pos, id, description), judges (pos, id, mode, labels, prompt, criteria)."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""
    where = lambda what, field: F.concat(F.lit(f"rubric.{what}["), F.col("pos").cast("string"), F.lit(f"].{field}"))
    row = lambda df, place, problem: df.select(place.alias("place"), (problem if isinstance(problem, Column) else F.lit(problem)).alias("problem"))
    again = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("__n > 1")
    missing = lambda c: blank(c) | has_todo(c)
    unknown = judges.select("pos", F.explode("criteria").alias("cid")).join(criteria.select(F.col("id").alias("cid")), "cid", "left_anti")
    found = [
        row(criteria.filter(missing(F.col("id"))), where("criteria", "id"), "missing or still TODO"),
        row(again(criteria), where("criteria", "id"), F.concat(F.lit("duplicate id "), F.col("id"))),
        row(criteria.filter(missing(F.col("description"))), where("criteria", "description"), "missing or still TODO"),
        row(judges.filter(missing(F.col("id"))), where("judges", "id"), "missing or still TODO"),
        row(again(judges), where("judges", "id"), F.concat(F.lit("duplicate id "), F.col("id"))),
        row(judges.filter(~F.coalesce("mode", F.lit("pointwise")).isin("pointwise", "pairwise")), where("judges", "mode"), "must be one of pointwise, pairwise"),
        row(judges.filter(F.coalesce(F.size("labels"), F.lit(0)) <= 0), where("judges", "labels"), "list the verdict labels the judge may return"),
        row(judges.filter(has_todo(F.col("prompt"))), where("judges", "prompt"), "still TODO"),
        row(unknown, where("judges", "criteria"), F.concat(F.lit("unknown criterion "), F.col("cid"))),
        row(criteria.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), F.lit("rubric.criteria"), "no criteria defined"),
    ]
    return reduce(DataFrame.unionByName, found)


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce("status", F.lit("draft")).alias("status")).agg(F.count(F.lit(1)).alias("cases"))


def case_modes(cases: DataFrame, judges: DataFrame) -> DataFrame:
    """case_id, mode, allowed: pairwise if the rubric has a pairwise judge and the case a second answer; labels in rubric order."""
    labels = judges.select(F.coalesce("mode", F.lit("pointwise")).alias("mode"), "pos", F.posexplode("labels").alias("at", "label")).filter(~has_todo(F.col("label")))
    union = labels.groupBy("mode").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "at", "label"))), lambda x: x["label"])).alias("allowed"))
    has_pair = judges.agg(F.coalesce(F.bool_or(F.col("mode") == "pairwise"), F.lit(False)).alias("has_pair"))
    mode = F.when(F.col("has_pair") & (F.coalesce("compare_output", F.lit("")) != ""), "pairwise").otherwise("pointwise")
    df = cases.crossJoin(F.broadcast(has_pair)).select(F.col("id").alias("case_id"), mode.alias("mode")).join(F.broadcast(union), "mode", "left")
    default = F.when(F.col("mode") == "pairwise", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("pass"), F.lit("fail")))
    return df.select("case_id", "mode", F.coalesce("allowed", default).alias("allowed"))


def export_cases(cases: DataFrame, criteria: DataFrame) -> DataFrame:
    """Ready cases with their criteria spelled out: the rows that every export is written from."""
    from .planning import with_criteria

    ready = with_criteria(cases.filter("status = 'ready'"), criteria)
    context = F.coalesce("context", F.array().cast("array<struct<role:string,content:string>>"))
    return ready.select(
        "id", "trace_id", "input", context.alias("context"), context_text(context).alias("context_text"), "expected_behavior", "criteria", "criteria_text",
        "reference_output", "observed_output", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def pick_grader(judges: DataFrame, checked: DataFrame, need_provider: bool = True) -> DataFrame:
    """At most one row: the first trustworthy pointwise judge (in rubric order) with a prompt, and a provider if needed."""
    ok = checked.filter("verdict = 'trustworthy'").select(F.col("judge").alias("id"))
    df = judges.join(ok, "id", "left_semi").filter("coalesce(mode, 'pointwise') = 'pointwise' AND coalesce(prompt, '') != ''")
    df = df.filter("coalesce(provider, '') != ''") if need_provider else df
    return df.orderBy("pos").limit(1)
