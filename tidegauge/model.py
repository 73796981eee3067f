"""Schemas of the data model."""

from __future__ import annotations

POINTS = "signal_id long, idx long, ts timestamp, value double"
METHOD = "struct<name:string,scale:int,bits:int,window:int,ratio:double>"
SEGMENTS = (
    "signal_id long, seg_id long, ts timestamp, prev_ts timestamp, size int, "
    f"method {METHOD}, data array<double>, comp_times int, comp_runtime double, n_bytes long"
)
SEG_STATS = "level int, node long, start long, end long, max double, min double, count long, sum double, avg double"
SERIES = "series_id long, label int, pixels array<double>"
LOSSLESS = frozenset({"uncompressed", "gorilla", "sprintz", "gzip", "zlib", "snappy", "buff"})


def is_lossless(method: str) -> bool:
    """Whether a method gives values back up to its declared precision."""
    return method in LOSSLESS
