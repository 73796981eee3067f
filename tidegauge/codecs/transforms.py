"""Lossy transforms of a segment's values, and what decoding gives back.

Each codec encodes values to parameters and decodes them to an array of the same
length. ``reconstruct`` applies one to every segment of a table, a batch of rows
at a time; segments are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.domain import fraction_bits, precision_of


class Codec(Protocol):
    """The plug-in interface: a name, values back, and stored bytes."""

    name: str

    def decode(self, values: np.ndarray) -> np.ndarray: ...

    def size(self, values: np.ndarray) -> int: ...


def piecewise_means(x: np.ndarray, window: int, full_divisor: bool = False) -> np.ndarray:
    """Means of chunks; a short last chunk divides by its length, or by the window."""
    at = np.arange(0, len(x), window)
    sums = np.add.reduceat(x, at) if len(x) else np.zeros(0)
    return sums / (window if full_divisor else np.diff(np.r_[at, len(x)]))


class Paa:
    """Piecewise aggregate approximation: each chunk becomes its mean."""

    def __init__(self, window: int, full_divisor: bool = False):
        if window < 1:
            raise ValueError("window must be at least 1")
        self.window, self.full_divisor, self.name = window, full_divisor, "paa"

    def decode(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(piecewise_means(x, self.window, self.full_divisor), self.window)[: len(x)]

    def size(self, x: np.ndarray) -> int:
        return 8 * -(-len(x) // self.window)


class Fourier:
    """The leading coefficients of the transform: ``ratio`` counts stored numbers,
    two for each coefficient.
    """

    def __init__(self, ratio: float):
        self.ratio, self.name = ratio, "fourier"

    def kept(self, n: int) -> int:
        return int(n * self.ratio / 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        f = np.fft.rfft(x)
        f[self.kept(len(x)) :] = 0
        return np.fft.irfft(f, len(x)) if len(x) else x

    def size(self, x: np.ndarray) -> int:
        return 16 * self.kept(len(x))


class LeadingFourier(Fourier):
    """Zeroes the coefficients from floor(ratio * n) to its mirror image."""

    def __init__(self, ratio: float):
        super().__init__(ratio)
        self.name = "leading"

    def kept(self, n: int) -> int:
        return int(self.ratio * n)

    def decode(self, x: np.ndarray) -> np.ndarray:
        n, k = len(x), self.kept(len(x))
        f = np.fft.fft(x)
        f[k : n - k + 1] = 0
        return np.fft.ifft(f).real if n else x


def largest_triangles(y: np.ndarray, budget: int) -> np.ndarray:
    """Positions kept by largest-triangle-three-buckets: both ends and, of each
    bucket, the point that spans the largest triangle with the point kept before
    and the mean of the next bucket.
    """
    n = len(y)
    if budget >= n or budget < 3:
        return np.arange(n) if budget >= n else np.array([0, n - 1][: max(1, min(n, budget))])
    step = (n - 2) / (budget - 2)
    edge = (np.floor(np.arange(budget - 1) * step) + 1).astype(int)
    edge[-1] = n - 1
    edge = np.r_[edge, n]
    kept = [0]
    for b in range(budget - 2):
        inner = np.arange(edge[b], edge[b + 1])
        following = slice(edge[b + 1], edge[b + 2])
        mx, my = (edge[b + 1] + edge[b + 2] - 1) / 2, y[following].mean()
        a = kept[-1]
        area = np.abs((a - mx) * (y[inner] - y[a]) - (a - inner) * (my - y[a]))
        kept.append(int(inner[np.argmax(area)]))
    return np.array([*kept, n - 1])


class Pla:
    """Piecewise linear approximation through the points of a budget.

    Stored numbers count twice (position and value) unless ``whole_ratio``.
    """

    def __init__(self, ratio: float, whole_ratio: bool = False):
        self.ratio, self.whole, self.name = ratio, whole_ratio, "pla"

    def budget(self, n: int) -> int:
        return max(2, int(self.ratio * n)) if self.whole else max(4, int(self.ratio / 2 * n))

    def decode(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 3:
            return x
        at = largest_triangles(x, self.budget(len(x)))
        return np.interp(np.arange(len(x)), at, x[at])

    def size(self, x: np.ndarray) -> int:
        return 16 * min(len(x), self.budget(len(x)))


class FirstValue:
    """One sample, the first, stands for the whole segment."""

    name = "rrd"

    def decode(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), x[0]) if len(x) else x

    def size(self, x: np.ndarray) -> int:
        return 8


class TruncatedFixed:
    """Fixed point of which the top bits are kept; below 8 bits the first value."""

    def __init__(self, scale: int, bits: int):
        self.scale, self.bits, self.name = scale, bits, "bufflossy"
        self.fraction = fraction_bits(precision_of(scale))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (np.sign(x) * np.floor(np.abs(x) * 2.0**self.fraction)).astype(np.int64)

    def width(self, x: np.ndarray) -> int:
        """Bits of the column's offsets from its minimum."""
        c = self.codes(x)
        return int(c.max() - c.min()).bit_length() if len(c) else 0

    def decode(self, x: np.ndarray) -> np.ndarray:
        if self.bits < 8:
            return FirstValue().decode(x)
        c = self.codes(x)
        if not len(c):
            return x
        drop = max(0, self.width(x) - self.bits)
        return ((c - c.min() >> drop << drop) + c.min()) / 2.0**self.fraction

    def size(self, x: np.ndarray) -> int:
        return 8 if self.bits < 8 else -(-len(x) * min(self.bits, self.width(x)) // 8) + 17


def halved(codec: Codec) -> Codec:
    """The next, smaller form when space runs short."""
    if isinstance(codec, Paa):
        return Paa(codec.window * 2) if codec.window < 5000 else codec
    if isinstance(codec, Fourier):
        return type(codec)(codec.ratio / 2)
    if isinstance(codec, Pla):
        return Pla(codec.ratio / 2, codec.whole)
    if isinstance(codec, TruncatedFixed):
        return TruncatedFixed(codec.scale, (codec.bits - 1) // 8 * 8)
    return codec


def for_ratio(name: str, ratio: float, scale: int = 10_000) -> Codec:
    """The codec of a method that meets a target ratio of stored to raw size."""
    if name == "paa":
        return Paa(int(np.ceil(1 / ratio)))
    if name == "fourier":
        return Fourier(ratio)
    if name == "pla":
        return Pla(ratio)
    if name == "bufflossy":
        return TruncatedFixed(scale, max(8, int(64 * ratio) // 8 * 8))
    if name == "rrd":
        return FirstValue()
    raise ValueError(f"no lossy method {name}")


def reconstruct(segments: DataFrame, codec: Codec, data: str = "data") -> DataFrame:
    """Segments with ``data`` as decoded from the codec, and the stored bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = [np.asarray(v, float) for v in pdf[data]]
            yield pdf.assign(**{data: [codec.decode(v) for v in x], "n_bytes": np.array([codec.size(v) for v in x], np.int64)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema if f.name != "n_bytes")
    return segments.mapInPandas(run, f"{schema}, n_bytes long")


def per_series(f: Callable[[np.ndarray], np.ndarray], df: DataFrame, vector: str) -> DataFrame:
    """Apply a function of one array to every row's vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{vector: [f(np.asarray(v, float)) for v in pdf[vector]]})

    schema = ", ".join(f"`{x.name}` {'array<double>' if x.name == vector else x.dataType.simpleString()}" for x in df.schema)
    return df.mapInPandas(run, schema)
