"""Joins: latest reading per key, positions, and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import keyed


def latest_per_key(points: DataFrame, keys: DataFrame | None = None, key: str = "signal_id", idx: str = "idx") -> DataFrame:
    """For each key (of ``keys``) the row at its largest position.

    The maximum is combined before the shuffle: a key has one row for each task.
    Keys without a row are absent.
    """
    rows = points if keys is None else keyed(points, keys, key)
    rest = [c for c in points.columns if c not in (key, idx)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(idx, *rest), idx).alias("r"))
    return last.select(key, "r.*").select(points.columns)


def positional(*columns: DataFrame, idx: str = "idx") -> DataFrame:
    """Columns that share their row order, as one wide table."""
    out = columns[0]
    for c in columns[1:]:
        out = out.join(c, idx)
    return out


def with_previous(segments: DataFrame) -> DataFrame:
    """Segments beside their predecessors, by the offset each one stores."""
    prev = segments.select("signal_id", F.col("ts").alias("prev_ts"), F.col("seg_id").alias("prev_seg"))
    return segments.join(prev, ["signal_id", "prev_ts"], "left")
