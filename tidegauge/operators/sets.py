"""Set operations over one-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, once each, by column name."""
    return a.unionByName(b).dropDuplicates()


def contains(a: DataFrame, column: str, value) -> bool:
    return not a.filter(a[column] == value).limit(1).isEmpty()
