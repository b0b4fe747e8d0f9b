"""A corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, line_dedup, minhash, mixing, quality_rules
from tracemill.llm.common import documents, stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; texts and n_chars follow. A text of such lines only is left empty."""
    docs = docs.select(*COLUMNS)
    out = line_dedup.drop_lines(docs, line_dedup.index(docs).found())
    return out.select("doc_id", F.col("__tm_kept").alias("text"), "lang", "source", F.length("__tm_kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: its least doc_id."""
    return minhash.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one document of each source may be cut where its target ends."""
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the sha256 of the decoded bytes, which are the text's."""
    out = bpe.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("__tm_ids").cast("long").alias("n_tokens"), F.col("__tm_ids").alias("ids"), F.sha2("__tm_decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]

#: The stages aren't expressible in SQL together; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet in the shared folder and read back."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, name.replace(" ", "-"))
    return docs
