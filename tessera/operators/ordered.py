"""Running values over a total order, without a window that one task must hold.

Rows are range-partitioned; windows run within partitions, and what the partitions before
contribute comes from a table with one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def _earlier():
    """The partitions before a partition."""
    return Window.partitionBy(F.lit(0)).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)


def _dealt(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return staged(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__pid")), "ordered")


def sum_before(df: DataFrame, order: list[Column | str], value: str, out: str) -> DataFrame:
    """df with the sum of value over all rows before this one; 0 for the first. The order is total."""
    d = _dealt(df, order)
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("__pid").agg(F.sum(value).alias("__t")).select("__pid", F.coalesce(F.sum("__t").over(_earlier()), F.lit(0)).alias("__carried"))
    return d.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, "__pid").withColumn(out, F.col(out) + F.col("__carried")).drop("__pid", "__carried")


def last_up_to(df: DataFrame, order: list[Column | str], value: str, out: str, before: bool = False) -> DataFrame:
    """df with the last value that isn't null in the rows up to this one, or, with before, in those before it."""
    d = _dealt(df, order)
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    tops = d.groupBy("__pid").agg(F.max_by(value, at).alias("__t")).select("__pid", F.last("__t", True).over(_earlier()).alias("__carried"))
    return d.withColumn(out, F.last(value, True).over(inside)).join(tops, "__pid").withColumn(out, F.coalesce(out, "__carried")).drop("__pid", "__carried")
