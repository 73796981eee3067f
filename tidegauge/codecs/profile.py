"""Profiles of codecs: what each stores, and what queries answer on its values.

One row for a method: ratio, rows above and equal to a predicate, sum, greatest
value and the rows that attain it, all in the method's value domain. Times are
wall-clock seconds of the jobs behind encode and each operator.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import Ceil, Domain, Fixed, Raw, precision_of
from ..operators.aggregate import top_rows
from ..operators.filters import compare, materialize
from . import size
from .transforms import Codec, Fourier, LeadingFourier, Paa, Pla, reconstruct

# Methods by name, grouped by what they make of a value.
RAW = ("gorilla", "gzip", "zlib", "deflate", "snappy", "plain", "dict", "pqgzip", "pqsnappy", "btr")
FIXED = ("buff", "byteall", "bytedec", "bpsplit", "splitdouble", "fixed", "bp", "RAPG", "RAPG-major", "buff-simd", "buff-slice", "buff-slice-scalar", "buff-major")
CEILED = ("sprintz", "scaled-slice", "scaled-slice-scalar")
INTEGERS = ("bp_int", "deltabp", "split", "fcm", "dfcm")
NAMES = RAW + FIXED + CEILED + INTEGERS


def domain_of(name: str, scale: int) -> Domain:
    """The value domain of a method."""
    if name in RAW:
        return Raw()
    if name in FIXED:
        return Fixed.of(precision_of(scale))
    if name in CEILED:
        return Ceil(scale)
    if name in INTEGERS:
        return Ceil(scale)
    raise ValueError(f"no method {name}")


def predictor_bytes(codes: np.ndarray, level: int, differences: bool) -> int:
    """Bytes of residuals against the code that last followed the same history."""
    x = np.diff(codes, prepend=0) if differences else codes
    seen: dict[tuple, int] = {}
    history, residuals = (0,) * level, []
    for v in x.tolist():
        residuals.append(v - seen.get(history, 0))
        seen[history] = v
        history = (*history[1:], v)
    r = np.array(residuals, np.int64)
    return size.bit_packed((r << 1) ^ (r >> 63))


def stored_bytes(x: np.ndarray, name: str, scale: int) -> int:
    """Bytes that a method takes for a run of values."""
    if name in size.LOSSLESS:
        return size.LOSSLESS[name](x, scale)
    if name in ("snappy", "pqsnappy"):
        return size.byte_codec(x, "snappy")
    if name in ("gzip", "pqgzip"):
        return size.byte_codec(x, "gzip")
    if name in ("zlib", "deflate"):
        return size.byte_codec(x, name)
    if name in ("plain", "btr"):
        return size.raw_size(len(x))
    if name == "dict":
        distinct = len(np.unique(x))
        return -(-(distinct.bit_length() * len(x) + 64 * distinct) // 8)
    if name in CEILED:
        return size.sprintz(x, scale) if name == "sprintz" else 20 + len(x) * -(-_width(np.ceil(x * scale)) // 8)
    if name in INTEGERS:
        codes = np.ceil(x * scale).astype(np.int64)
        if name == "deltabp":
            return size.delta_packed(codes)
        if name in ("fcm", "dfcm"):
            return predictor_bytes(codes, 2, name == "dfcm")
        return size.bit_packed(codes)
    if name in ("fixed", "bp", "bpsplit", "splitdouble", "bytedec"):
        bits = Fixed.of(precision_of(scale)).bits
        return size.bit_packed((np.sign(x) * np.floor(np.abs(x) * 2.0**bits)).astype(np.int64))
    return size.fixed_point(x, scale)


def _width(codes: np.ndarray) -> int:
    c = codes.astype(np.int64)
    return int(c.max() - c.min()).bit_length() if len(c) else 0


def encode(points: DataFrame, name: str, scale: int, segment: int = 10_000, value: str = "value", idx: str = "idx") -> DataFrame:
    """Stored bytes of each run of ``segment`` positions: node, n, n_bytes."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(idx)[value].to_numpy(float)
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0])], "n": [len(x)], "n_bytes": [stored_bytes(x, name, scale)]})

    rows = points.select(idx, value, F.floor(F.col(idx) / segment).cast("long").alias("node"))
    return rows.groupBy("node").applyInPandas(run, "node long, n long, n_bytes long")


def answers(points: DataFrame, domain: Domain, pred: float, value: str = "value") -> DataFrame:
    """What the operators answer in a domain, as one row, from two scans."""
    v: Column = F.col(value)
    out = points.agg(
        F.count("*").alias("n"), F.sum(domain.decode(v)).alias("sum"), F.max(domain.decode(v)).alias("max"),
        F.count_if(compare(v, ">", pred, domain)).alias("above"), F.count_if(compare(v, "=", pred, domain)).alias("equal"),
    )
    top = top_rows(materialize(points.select(v), domain, value), value).agg(F.count("*").alias("max_rows"))
    return out.join(F.broadcast(top))


def profile(points: DataFrame, names: list[str], scale: int, pred: float, segment: int = 10_000) -> DataFrame:
    """A row for each method with its ratio, answers and times."""
    rows = []
    for name in names:
        began = time.perf_counter()
        total = encode(points, name, scale, segment).agg(F.sum("n_bytes"), F.sum("n")).first()
        middle = time.perf_counter()
        a = answers(points, domain_of(name, scale), pred).first()
        done = time.perf_counter()
        ratio = total[0] / max(1, size.raw_size(total[1]))
        rows.append((name, ratio, a["n"], a["above"], a["equal"], a["sum"], a["max"], a["max_rows"], middle - began, done - middle))
    schema = "method string, ratio double, n long, above long, equal long, sum double, max double, max_rows long, encode_seconds double, query_seconds double"
    return points.sparkSession.createDataFrame(rows, schema)


def lossy_profile(segments: DataFrame, codecs: list[Codec]) -> DataFrame:
    """Ratio and mean absolute error of lossy codecs over segments."""
    parts = []
    for c in codecs:
        rebuilt = reconstruct(segments.select("signal_id", "seg_id", "data"), c).select("signal_id", "seg_id", "n_bytes", F.col("data").alias("rebuilt"))
        both = segments.join(rebuilt, ["signal_id", "seg_id"])
        gap = F.aggregate(F.zip_with("data", "rebuilt", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
        parts.append(both.agg(F.lit(c.name).alias("method"), (F.sum("n_bytes") / F.sum(8.0 * F.size("data"))).alias("ratio"), (F.sum(gap) / F.sum(F.size("data"))).alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def default_lossy() -> list[Codec]:
    return [Paa(4), Fourier(0.25), LeadingFourier(0.125), Pla(0.25)]
