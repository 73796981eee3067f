"""Positions and running totals in an order, without a window over a whole table.

Rows are dealt by ranges of the order; a window stays within its range and is
offset by the totals of the ranges before, which are a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import kept

BEFORE = (W.Window.unboundedPreceding, -1)


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    # written, because range bounds are sampled: both uses must see the same ranges,
    # also after an executor is lost
    return kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, order: str | Column | list[str | Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row; rows equal in the order are
    taken in any order, so name enough columns.
    """
    order = order if isinstance(order, list) else [order]
    parts = _ranged(df, order)
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    zero = F.lit(0)
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(W.Window.orderBy("_part").rowsBetween(*BEFORE)), zero).alias("_before"))
    inner = F.coalesce(F.sum(value).over(W.Window.partitionBy("_part").orderBy(*order).rowsBetween(*BEFORE)), zero)
    rows = parts.withColumn("_in", inner).join(F.broadcast(before), "_part")
    return rows.withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_part")


def numbered(df: DataFrame, order: list[str | Column], out: str = "idx") -> DataFrame:
    """Dense zero-based positions in order."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def numbered_per(df: DataFrame, by: str, order: str, out: str, count: str) -> DataFrame:
    """Zero-based positions within each group, and the group's rows.

    A group that holds most rows is spread over ranges like any other run of rows.
    """
    rows = numbered(df, [by, order], "_at")
    groups = rows.groupBy(by).agg(F.min("_at").alias("_first"), F.count("*").alias(count))
    return rows.join(groups, by).withColumn(out, F.col("_at") - F.col("_first")).drop("_at", "_first")
