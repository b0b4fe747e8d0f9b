"""JSON and JSONL files as rows (file, index, rec) with rec a VARIANT: any shape, typed only when it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMATS = ("openai", "anthropic", "langfuse", "otel", "generic")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """file, index, rec from a file or folder: arrays, {"data": [...]}, {"traces": [...]}, single objects, or JSON lines.

    JSON lines are read line by line, so their files are split over tasks; a whole-file document is one row until its
    array is exploded. A line that is no JSON fails with its file. Blank lines are skipped; index counts from 0.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__at"), F.btrim("value").alias("__line"))
        .filter("__line != ''")
    )
    bad = F.raise_error(F.concat(F.col("file"), F.lit(": not valid JSON or JSONL: "), F.substring("__line", 1, 80)))
    rec = F.try_parse_json("__line")
    lines = lines.select("file", "__b", "__at", F.coalesce(rec, F.parse_json(bad.cast("string"))).alias("rec"))
    # numbered inside each split of a file, the rows of the splits before it added: a large file is many window groups
    before = Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "__b").agg(F.count(F.lit(1)).alias("__n")).select("file", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = lines.withColumn("__r", F.row_number().over(Window.partitionBy("file", "__b").orderBy("__at")) - 1)
    lines = ranked.join(starts, ["file", "__b"]).select("file", (F.col("__r") + F.col("__start")).cast("int").alias("index"), "rec")
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    doc = whole.select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    return lines.unionByName(documents(doc))


def documents(doc: DataFrame) -> DataFrame:
    """file, index, rec of whole JSON documents (file, v)."""
    data, traces = F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$.traces", "array<variant>")
    otlp = F.try_variant_get("v", "$.resourceSpans", "variant").isNotNull()
    rows = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.when(~otlp, data), traces, F.array("v"))
    return doc.select("file", F.posexplode(rows).alias("index", "rec"))


def detect_one() -> Column:
    """The format a record looks like, or null; the order is the precedence. A key counts by being there, null or not."""
    rec = F.col("rec")
    key = lambda *ks: F.greatest(*[F.try_variant_get(rec, f"$.{k}", "variant").isNotNull() for k in ks], F.lit(False))
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(rec, p, "variant")), F.lit(""))
    is_array = lambda p: kind(p).startswith("ARRAY")
    req = F.when(kind("$.request").startswith("OBJECT"), F.try_variant_get(rec, "$.request", "variant")).otherwise(rec)
    messages = F.try_variant_get(req, "$.messages", "array<variant>")
    system = F.coalesce(F.schema_of_variant(F.try_variant_get(req, "$.system", "variant")), F.lit(""))
    blocks = F.coalesce(F.exists(messages, lambda m: F.coalesce(F.exists(F.try_variant_get(m, "$.content", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string").isin("tool_use", "tool_result"), F.lit(False))), F.lit(False))), F.lit(False))
    anthropic = (
        (is_array("$.response.content") & (key("response.stop_reason") | F.coalesce(F.try_variant_get(rec, "$.response.type", "string") == "message", F.lit(False))))
        | (F.coalesce(F.try_variant_get(rec, "$.type", "string") == "message", F.lit(False)) & is_array("$.content"))
        | (messages.isNotNull() & (((system == "STRING") | system.startswith("ARRAY")) & ~key("choices") | blocks))
    )
    return (
        F.when(key("resourceSpans", "spanId", "span_id") | key("context.span_id"), "otel")
        .when(key("observations", "htmlPath", "projectId"), "langfuse")
        .when(anthropic, "anthropic")
        .when(key("messages", "choices", "request.messages"), "openai")
        .when(key("input") & key("output") & is_array("$.scores"), "langfuse")
        .when(key("input", "prompt", "question") & key("output", "completion", "answer", "response"), "generic")
    )


def detect_formats(records: DataFrame, votes: int = 20) -> DataFrame:
    """file, format: the vote of a file's first records; ties go to the format seen first, no vote gives null."""
    first = records.filter(F.col("index") < votes).select("file", "index", detect_one().alias("format"))
    by = first.filter("format IS NOT NULL").groupBy("file", "format").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("i"))
    won = by.groupBy("file").agg(F.max_by("format", F.struct("n", -F.col("i"))).alias("format"))
    return first.select("file").distinct().join(won, "file", "left")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every JSON file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
