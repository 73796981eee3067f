"""Sort, limit and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .ranges import numbered


def smallest(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k smallest rows: each task keeps k, and only those meet."""
    return df.orderBy(by, tie).limit(k)


def smallest_per(df: DataFrame, k: int, group: str, by: str, tie: str) -> DataFrame:
    rank = F.row_number().over(W.Window.partitionBy(group).orderBy(by, tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def argsort(a: Column) -> Column:
    """Zero-based positions of an array's elements in ascending order."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def argsorted(df: DataFrame, group: str, by: str, order: str) -> DataFrame:
    """(group, rank, position): the position of each group's rows in order of a value.

    The same as ``argsort``, with a row for each element, so no group is held whole.
    """
    rows = df.withColumn("position", (F.row_number().over(W.Window.partitionBy(group).orderBy(order)) - 1).cast("long"))
    rank = F.row_number().over(W.Window.partitionBy(group).orderBy(by, "position")) - 1
    return rows.select(group, rank.cast("long").alias("rank"), "position")


def dense_index(df: DataFrame, value: str, out: str = "index") -> DataFrame:
    """Zero-based rank of each value among the distinct ones.

    Only distinct values are ranked; the ranks are joined back.
    """
    ranks = numbered(df.select(value).distinct(), [value], out)
    return df.join(ranks.withColumn(out, F.col(out).cast("int")), value)
