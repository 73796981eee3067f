"""Shift-invariant similarity, and the features made from a dictionary of series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def cross_correlation(x: np.ndarray, y: np.ndarray, coefficients: int | None = None) -> np.ndarray:
    """Normalised cross-correlation at all shifts, through the Fourier transform.

    With ``coefficients`` only so many leading ones at either end are kept.
    """
    n = max(len(x), len(y))
    size = 1 << int(np.ceil(np.log2(max(1, 2 * n - 1))))
    fx, fy = np.fft.fft(x, size), np.fft.fft(y, size)
    if coefficients is not None:
        for f in (fx, fy):
            f[coefficients : size - coefficients] = 0
    c = np.fft.ifft(fx * np.conj(fy)).real
    c = np.r_[c[:n], c[size - n + 1 :]]
    return c / (np.linalg.norm(x) * np.linalg.norm(y))


def _mass(x: np.ndarray, y: np.ndarray, gamma: float, k: int | None) -> float:
    return float(np.exp(gamma * cross_correlation(x, y, k)).sum())


def sink(x: np.ndarray, y: np.ndarray, gamma: float, k: int | None = None) -> float:
    """Shift-invariant kernel: 1 for equal series."""
    return _mass(x, y, gamma, k) / np.sqrt(_mass(x, x, gamma, k) * _mass(y, y, gamma, k))


def embedding_distance(x: np.ndarray, y: np.ndarray) -> float:
    """1 less the greatest cross-correlation of two series, which have some values.

    Masked values are left out, and shifts at which no two values meet. The Fourier
    transform errs in the last bits, so it only tells which shifts may be the
    greatest; their products, and the norms, are summed in order.
    """
    with np.errstate(all="ignore"):
        meet = cross_correlation(~np.ma.getmaskarray(x), ~np.ma.getmaskarray(y)) * max(len(x), len(y)) > 0.5
        x, y = np.ma.filled(x, 0.0), np.ma.filled(y, 0.0)
        c = cross_correlation(x, y)
        shift = np.r_[0 : len(c) // 2 + 1, -(len(c) // 2) : 0]
        c, shift = c[meet], shift[meet]
        near = shift[~(c < c.max() - 1e-9)].tolist()  # all of them where it isn't a number
        top = np.max([np.cumsum(x[max(0, s) : len(y) + s] * y[max(0, -s) : len(x) - s])[-1] for s in near])
        return float(1.0 - top / (np.sqrt(np.cumsum(x * x)[-1]) * np.sqrt(np.cumsum(y * y)[-1])))


def half_away(x: float, digits: int) -> float:
    """``x`` in decimals as C rounds it: halves away from zero, and zero keeps its sign."""
    y = abs(x) * 10.0**digits
    if not np.isfinite(y):
        return x
    whole = np.floor(y)
    return float(np.copysign((whole + (y - whole >= 0.5)) / 10.0**digits, x))


class Landmarks:
    """Features from similarities to a dictionary of k series (k is a parameter):
    ``E V diag(1 / sqrt(lambda))`` of the dictionary's kernel matrix.
    """

    def __init__(self, dictionary: np.ndarray, gamma: float = 5.0, coefficients: int | None = None, floor: float = 1e-9):
        self.rows, self.gamma, self.k = np.asarray(dictionary, float), gamma, coefficients
        w = np.array([[sink(a, b, gamma, coefficients) for b in self.rows] for a in self.rows])
        values, vectors = np.linalg.eigh((w + w.T) / 2)
        keep = values > floor
        self.project = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.array([sink(x, d, self.gamma, self.k) for d in self.rows]) @ self.project

    def transform(self, df: DataFrame, vector: str, out: str = "features") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf.assign(**{out: [shared.value.features(np.asarray(v, float)) for v in pdf[vector]]})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{schema}, {out} array<double>")
