"""Count windows, segmentation and differences along a signal.

Windows partition by signal. A single global signal is joined by position
instead, so that no window gathers a whole column in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalar import zigzag
from .ranges import numbered_per


def count_window_max(points: DataFrame, start: int, end: int | None, size: int, value: str = "value", idx: str = "idx") -> DataFrame:
    """Greatest value of each run of ``size`` positions in start <= idx < end (None: to the last)."""
    rows = points.filter(F.col(idx) >= start)
    rows = rows if end is None else rows.filter(F.col(idx) < end)
    return rows.groupBy(F.floor((F.col(idx) - start) / size).cast("long").alias("window")).agg(F.max(value).alias("max"))


def chunk_means(points: DataFrame, size: int, full_divisor: bool = False, by: list[str] | None = None, value: str = "value", idx: str = "idx") -> DataFrame:
    """Piecewise averages; a short last chunk divides by its length, or by ``size``."""
    mean = F.sum(value) / F.lit(float(size)) if full_divisor else F.avg(value)
    return points.groupBy(*(by or []), F.floor(F.col(idx) / size).cast("long").alias("chunk")).agg(mean.alias("mean"))


def reconstruct_means(points: DataFrame, size: int, value: str = "value", idx: str = "idx") -> DataFrame:
    """Every value replaced by its chunk's mean."""
    w = W.Window.partitionBy(F.floor(F.col(idx) / size))
    return points.withColumn(value, F.avg(value).over(w))


def previous(points: DataFrame, value: str = "value", idx: str = "idx", by: str | None = None, out: str = "prev") -> DataFrame:
    """The value before each: within a signal in order, or at the position before."""
    if by is not None:
        return points.withColumn(out, F.lag(value).over(W.Window.partitionBy(by).orderBy(idx)))
    return points.join(points.select((F.col(idx) + 1).alias(idx), F.col(value).alias(out)), idx, "left")


def first_difference(points: DataFrame, value: str = "value", idx: str = "idx", by: str | None = None) -> DataFrame:
    """x[i] - x[i-1]; the first element stays."""
    return previous(points, value, idx, by).withColumn("diff", F.col(value) - F.coalesce("prev", F.lit(0))).drop("prev")


def zigzag_delta(points: DataFrame, code: str, idx: str = "idx", by: str | None = None) -> DataFrame:
    """Zigzag of the difference of codes; the first difference is 0."""
    out = previous(points, code, idx, by)
    return out.withColumn("zz", zigzag(F.col(code) - F.coalesce("prev", code))).drop("prev")


def frame_of_reference(points: DataFrame, code: str, zero_based: bool = False) -> DataFrame:
    """Codes less the column's minimum (at most 0 with ``zero_based``), and the bit width."""
    low = F.least(F.min(code), F.lit(0).cast("long")) if zero_based else F.min(code)
    base = points.agg(low.alias("base"), (F.max(code) - low).alias("spread"))
    width = F.when(F.col("spread") == 0, 0).otherwise(F.length(F.bin("spread"))).cast("int")
    base = base.select("base", width.alias("width"))
    return points.join(F.broadcast(base)).withColumn("offset", F.col(code) - F.col("base"))


def segmentize(points: DataFrame, size: int, by: str = "signal_id", order: str = "idx", flush_tail: bool = False, skewed: bool = False) -> DataFrame:
    """Segments of ``size`` consecutive points of a signal.

    A segment leaves when the next point arrives, so the last buffer, even a full
    one, stays behind unless ``flush_tail``: floor((n - 1) / size) leave. With
    ``skewed`` positions are taken by ranges of all points, so that a signal with
    most of the points is no task's own.
    """
    if skewed:
        rows = numbered_per(points, by, order, "_rn", "_n")
    else:
        w = W.Window.partitionBy(by)
        rows = points.withColumns({"_rn": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    rows = rows.withColumn("seg_id", F.floor(F.col("_rn") / size).cast("long"))
    if not flush_tail:
        rows = rows.filter(F.col("seg_id") < F.floor((F.col("_n") - 1) / size))
    cells = F.sort_array(F.collect_list(F.struct(order, "ts", "value")))
    out = rows.groupBy(by, "seg_id").agg(cells.alias("cells"))
    return out.select(by, "seg_id", F.element_at("cells.ts", 1).alias("ts"), F.size("cells").alias("size"), F.col("cells.value").alias("data"))


def chain(segments: DataFrame, by: str = "signal_id") -> DataFrame:
    """Each segment with the time and number of the one before it."""
    w = W.Window.partitionBy(by).orderBy("ts", "seg_id")
    return segments.withColumns({"prev_seg": F.lag("seg_id").over(w), "prev_ts": F.lag("ts").over(w)})


def latest_segments(segments: DataFrame, n: int, by: str = "signal_id") -> DataFrame:
    """The latest ``n`` segments of each signal, newest first."""
    w = W.Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("seg_id"))
    return segments.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def time_lapse(points: DataFrame, size: int, by: str = "signal_id", order: str = "idx") -> DataFrame:
    """Microseconds since the start of each point's segment."""
    rn = F.row_number().over(W.Window.partitionBy(by).orderBy(order))
    rows = points.withColumn("seg_id", F.floor((rn - 1) / size).cast("long"))
    first = F.min("ts").over(W.Window.partitionBy(by, "seg_id"))
    return rows.withColumn("lapse", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp")))


def context_prediction(points: DataFrame, code: str, level: int, by: str = "signal_id", order: str = "idx") -> DataFrame:
    """The code that last followed the same ``level`` codes; 0 where none did."""
    w = W.Window.partitionBy(by).orderBy(order)
    history = F.concat_ws(",", *[F.coalesce(F.lag(code, k).over(w), F.lit(0)).cast("string") for k in range(1, level + 1)])
    rows = points.withColumn("_ctx", history)
    last = W.Window.partitionBy(by, "_ctx").orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    return rows.withColumn("predicted", F.coalesce(F.last(code).over(last), F.lit(0))).withColumn("residual", F.col(code) - F.col("predicted")).drop("_ctx")


def bits_in_common(points: DataFrame, value: str = "value", by: str = "signal_id", order: str = "idx") -> DataFrame:
    """Leading and trailing zeros of each value's bits xor those of the value before.

    Both are 64 where the value repeats; the first value of a signal has none. Rows
    stream through a task; none holds a signal.
    """
    before = fresh_name(points.columns, "before")

    def zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = [b.column(c).fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64) for c in (value, before)]
            first = pc.is_null(b.column(before)).to_numpy(zero_copy_only=False)
            found = [pa.array(n.astype(np.int32), mask=first) for n in zero_bits(pair[0] ^ pair[1])]
            at = b.schema.get_field_index(before)
            columns = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[n for n in b.schema.names if n != before] + ["leading", "trailing"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", leading int, trailing int"
    return previous(points, value, order, by, before).mapInArrow(zeros, schema)


def fresh_name(columns: list[str], name: str) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def zero_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading and trailing zeros of 64-bit words; 64 where there is no bit."""
    width = lambda v: np.frexp(v.astype(np.float64))[1]  # noqa: E731  exact for 32 bits
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    bits = lambda v: np.where(v >> half, 32 + width(v >> half), width(v & low))
    last = x & (~x + np.uint64(1))
    return 64 - bits(x), np.where(x == 0, 64, bits(last) - 1)
