"""Projections and filters over points, in the domain of a codec.

Rows are points (idx, value, ...); positions are an explicit column. A predicate
is encoded once, like the values, so comparisons hold in the codec's domain.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import Domain, Raw

# Key lists up to this many rows are broadcast; Spark measures larger ones itself.
KEY_BROADCAST_ROWS = 1_000_000


def keyed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``; a key list of checked size is broadcast."""
    keys = keys.select(key).distinct()
    if keys.limit(KEY_BROADCAST_ROWS + 1).count() <= KEY_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_semi")


def materialize(points: DataFrame, domain: Domain = Raw(), value: str = "value") -> DataFrame:
    """Decoded values of a whole column."""
    return points.withColumn(value, domain.decode(F.col(value)))


def compare(column: Column, op: str, pred: float, domain: Domain = Raw()) -> Column:
    """``column op pred`` with both sides in the domain's codes."""
    a, b = domain.code(column), domain.code(F.lit(float(pred)))
    return {">": a > b, "<": a < b, "=": a == b, ">=": a >= b, "<=": a <= b}[op]


def range_filter(points: DataFrame, pred: float, domain: Domain = Raw(), value: str = "value") -> DataFrame:
    """Rows strictly greater than the predicate."""
    return points.filter(compare(F.col(value), ">", pred, domain))


def equal_filter(points: DataFrame, pred: float, domain: Domain = Raw(), value: str = "value") -> DataFrame:
    return points.filter(compare(F.col(value), "=", pred, domain))


def at_positions(points: DataFrame, positions: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows at given positions: late materialisation by a semi-join."""
    return keyed(points, positions, idx)


def conditional_filter(points: DataFrame, positions: DataFrame, op: str, pred: float, domain: Domain = Raw(), value: str = "value", idx: str = "idx") -> DataFrame:
    """Rows at given positions whose value also meets the predicate."""
    return keyed(points.filter(compare(F.col(value), op, pred, domain)), positions, idx)


def between(points: DataFrame, column: str, lo, hi) -> DataFrame:
    """Rows with lo <= column < hi; a missing bound is open."""
    if lo is not None:
        points = points.filter(F.col(column) >= F.lit(lo))
    if hi is not None:
        points = points.filter(F.col(column) < F.lit(hi))
    return points


def binarize(x: Column, threshold: float) -> Column:
    return F.when(x > threshold, 1).otherwise(0)


def key_in(points: DataFrame, key: str, values: Iterable[int]) -> DataFrame:
    return points.filter(F.col(key).isin(list(values)))
