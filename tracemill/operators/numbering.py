"""Numbers 0, 1, .. over a whole table in an order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage


def numbered(df: DataFrame, by: str, out: str = "index") -> DataFrame:
    """df with `out`, the number of rows before it by `by` (null first; ties in any order, each with a number of its own).

    Rows are dealt by ranges and written, so that a range keeps its rows; a range is a window group, and starts where the
    ranges before it end. An empty table gives no rows.
    """
    dealt = stage(df.repartitionByRange(F.col(by)).withColumn("__r", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    # one row a range
    starts = sizes.select(F.col("__r").alias("__s"), (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy(by)) - 1
    return dealt.withColumn("__k", rank).join(starts, F.col("__r") == F.col("__s")).withColumn(out, (F.col("__k") + F.col("__start")).cast("long")).drop("__r", "__s", "__k", "__start")
