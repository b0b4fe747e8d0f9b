"""Running flips of judges over a stream of judgments (an addition to the batch statistics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.judging import labelled


def running_labels(judgments: DataFrame, late: str = "1 hour") -> DataFrame:
    """judge, case_id, label, n of plain trials so far; a request that arrives again within `late` counts once.

    judgments: a stream with request_id, judge, case_id, mode, probe, verdict, ts. State is one count for each label.
    """
    once = judgments.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    return labelled(once).filter("probe = 'none'").groupBy("judge", "case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def flipped(counts: DataFrame) -> DataFrame:
    """judge, case_id, trials, flipped from running_labels() results."""
    return counts.groupBy("judge", "case_id").agg(F.sum("n").alias("trials"), (F.count(F.lit(1)) > 1).alias("flipped"))
