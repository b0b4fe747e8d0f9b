"""Traces from conversation turns, their ids, what is skipped, and what an ingest run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import last_user

#: Roles by other names.
ROLES = {"human": "user", "ai": "assistant", "model": "assistant", "bot": "assistant"}


def role_of(role: Column) -> Column:
    role = F.lower(F.coalesce(role, F.lit("user")))
    return F.when(role == "human", "user").when(role.isin("ai", "model", "bot"), "assistant").otherwise(role)


def trace_parts(messages: Column) -> dict[str, Column]:
    """input, output, messages and system of a conversation: array<struct<role, content>> with all its turns."""
    is_system = lambda m: m["role"].isin("system", "developer")
    named = F.transform(messages, lambda m: F.struct(role_of(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    system = F.array_join(F.transform(F.filter(named, lambda m: is_system(m) & (m["content"] != "")), lambda m: m["content"]), "\n\n")
    return {"messages": F.filter(named, lambda m: ~is_system(m)), "system": F.nullif(system, F.lit(""))}


def complete(df: DataFrame) -> DataFrame:
    """Adds input (the last user turn) and output (the last turn if it is the assistant's) to rows with messages."""
    last = F.try_element_at("messages", F.lit(-1))
    at = last_user(F.col("messages"))
    return df.withColumns({
        "input": F.when(at > 0, F.get("messages", at - 1)["content"]).otherwise(""),
        "output": F.coalesce(F.when(last["role"] == "assistant", last["content"]), F.lit("")),
    })


def from_turns(turns: DataFrame) -> DataFrame:
    """id, messages, system, input, output from rows (id, turn, role, content). One conversation is one trace and must fit a row."""
    m = turns.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    return complete(m.select("id", *[c.alias(n) for n, c in trace_parts(F.col("turns")).items()]))


def unique_ids(df: DataFrame, order: str = "pos") -> DataFrame:
    """The k-th row of an id becomes id~k, from the second on.

    Only ids that occur twice or more are ranked, each in ranges of its order: a range's rows are one window group, and
    the counts of the ranges before it are added, so an id with a third of all rows is no single task.
    """
    size = 50_000
    df = df.withColumn("__b", F.floor(F.col(order) / size))
    counts = df.groupBy("id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("id", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy("id", "__b").orderBy(order))).join(starts, ["id", "__b"])
    k = F.col("__r") + F.col("__start")
    return ranked.withColumn("id", F.when(k > 1, F.concat_ws("~", "id", k.cast("string"))).otherwise(F.col("id"))).drop("__b", "__r", "__start")


def skip_reason(inp: Column, out: Column) -> Column:
    """Why a record becomes no trace; null if it does."""
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""
    return F.when(blank(inp) & blank(out), "empty input and output").when(blank(inp), "no user message")


def summary(traces: DataFrame, top: int = 20) -> DataFrame:
    """(metric, value, count): traces, with_error, multi_turn (of messages), the feedback histogram, the most frequent routes and tools (top-k reports).

    Tables without messages or tools have no such rows.
    """
    users = F.size(F.filter("messages", lambda m: m["role"] == "user")) if "messages" in traces.columns else F.lit(None)
    one = traces.agg(F.count(F.lit(1)).alias("traces"), F.count_if("error").alias("with_error"), F.count_if(users > 1).alias("multi_turn"))
    totals = one.select(F.expr("stack(3, 'traces', '', traces, 'with_error', '', with_error, 'multi_turn', '', multi_turn) AS (metric, value, count)"))
    if "messages" not in traces.columns:
        totals = totals.filter("metric <> 'multi_turn'")
    hist = lambda name, df, c: df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("metric"), "value", "count")
    most = lambda df: df.orderBy(F.desc("count"), "value").limit(top)
    out = totals.unionByName(hist("feedback", traces, F.coalesce("feedback", F.lit("none")))).unionByName(most(hist("route", traces, F.coalesce("route", F.lit("none")))))
    if "tools" in traces.columns:
        out = out.unionByName(most(hist("tool", traces.select(F.explode("tools").alias("tool")), F.col("tool"))))
    return out


def source_report(parsed: DataFrame) -> DataFrame:
    """file, format, records, traces, skipped of every source file: parsed rows with source and skip_reason."""
    skipped = F.count_if(F.col("skip_reason").isNotNull())
    return parsed.groupBy("source.file", "source.format").agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - skipped).alias("traces"), skipped.alias("skipped"))
