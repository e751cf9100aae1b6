"""Running sums over a whole table in an order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.llm.common import written


def sums_before(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over all rows before, in ascending order (nulls first).

    Rows are dealt into ranges once, as a written table; a row a range gives the ranges' starts.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    starts = totals.select("_range", (F.sum("_total").over(W.orderBy("_range")) - F.col("_total")).alias("_start"))
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.coalesce(inside, F.lit(0))).cast("long")).drop("_range", "_start")
