"""Compression ratios predicted from the first rows of a column.

BUFF, dictionary and Sprintz have closed forms, which are aggregates; byte codecs
compress the sample itself, which is bounded by its row count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import fraction_bits
from ..functions.scalar import bit_width, zigzag_positive_odd
from ..operators.window import previous
from . import size

SAMPLE_ROWS = 1_000_000  # rows at most that byte codecs compress on the driver


def prefix(points: DataFrame, rows: int, idx: str = "idx") -> DataFrame:
    return points.filter(F.col(idx) < rows)


def buff_ratio(sample: DataFrame, precision: int, value: str = "value") -> DataFrame:
    spread = F.floor(F.max(value) - F.min(value)).cast("long")
    return sample.agg(spread.alias("s")).select(((bit_width(F.col("s")) + fraction_bits(precision)) / 64.0).alias("ratio"))


def dictionary_ratio(sample: DataFrame, value: str = "value") -> DataFrame:
    a = sample.agg(F.count_distinct(value).alias("d"), F.count("*").alias("n"))
    return a.select(((bit_width(F.col("d")) * F.col("n") + F.col("d") * 64) / (64.0 * F.col("n"))).alias("ratio"))


def sprintz_ratio(sample: DataFrame, precision: int, value: str = "value", idx: str = "idx") -> DataFrame:
    """Widest zigzag of differences of truncated codes; the first is against 0."""
    codes = sample.select(idx, (F.col(value) * float(10**precision)).cast("long").alias("code"))
    deltas = previous(codes, "code", idx).select(zigzag_positive_odd(F.col("code") - F.coalesce("prev", F.lit(0))).alias("z"))
    return deltas.agg(F.max("z").alias("z")).select((bit_width(F.col("z")) / 64.0).alias("ratio"))


def measured_ratio(sample: DataFrame, name: str, scale: int, value: str = "value", idx: str = "idx") -> float:
    """Ratio of a method on the sample, in order."""
    rows = sample.select(idx, value).orderBy(idx).limit(SAMPLE_ROWS).toArrow()
    x = rows.column(value).to_numpy()
    return size.LOSSLESS[name](np.asarray(x, float), scale) / max(1, size.raw_size(len(x)))


def best_method(sample: DataFrame, scale: int, names: list[str] | None = None) -> str:
    """The method with the least predicted ratio; ties go to the first named."""
    ratios = {n: measured_ratio(sample, n, scale) for n in names or list(size.LOSSLESS)}
    return min(ratios, key=ratios.get)
