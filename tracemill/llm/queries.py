"""Queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html_extract, language_id, line_dedup, minhash, mixing, quality_rules, sharding, substring_dedup
from .common import documents


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _documents(quality_rules.op1_quality_rules),
        "op2_mixing": _documents(mixing.op2_mixing),
        "op3_minhash": _documents(minhash.op3_minhash),
        "op4_html_extraction": lambda spark, sf_dir: html_extract.op4_html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op5_bpe": _documents(bpe.op5_bpe),
        "op6_sharding": _documents(sharding.op6_sharding),
        "op7_line_dedup": _documents(line_dedup.op7_line_dedup),
        "op8_language_id": _documents(language_id.op8_language_id),
        "op9_fingerprints": _documents(fingerprints.op9_fingerprints),
        "op10_substring_dedup": _documents(substring_dedup.op10_substring_dedup),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op3_minhash": minhash.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
    }
