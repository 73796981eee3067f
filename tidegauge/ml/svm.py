"""Kernel support vectors on a bounded sample, by sequential minimal optimisation.

Linear models of any size are ``models.linear_svc``; kernels need pairs of rows,
so a fit takes at most ``SVM_ROWS`` rows and says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SVM_ROWS = 5000
CELLS = 1 << 18  # pairs of a row and a support row that are held at once
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _linear(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _polynomial(a: np.ndarray, b: np.ndarray, degree: float, gamma: float, coef: float) -> np.ndarray:
    return (gamma * (a @ b.T) + coef) ** degree


def _sigmoid(a: np.ndarray, b: np.ndarray, gamma: float, coef: float) -> np.ndarray:
    return np.tanh(gamma * (a @ b.T) + coef)


# kernels travel to executors, so they are functions of the module with settings bound
def linear() -> Kernel:
    return _linear


def rbf(gamma: float) -> Kernel:
    return partial(_rbf, gamma=gamma)


def polynomial(degree: float, gamma: float, coef: float) -> Kernel:
    return partial(_polynomial, degree=degree, gamma=gamma, coef=coef)


def sigmoid(gamma: float, coef: float) -> Kernel:
    return partial(_sigmoid, gamma=gamma, coef=coef)


class Svm:
    """Dual solution: support rows, their signed weights and the bias."""

    def __init__(self, kernel: Kernel, x: np.ndarray, weights: np.ndarray, bias: float):
        keep = np.abs(weights) > 1e-12
        self.kernel, self.x, self.weights, self.bias = kernel, x[keep], weights[keep], bias

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Of any number of rows: their pairs with the support rows are taken in blocks."""
        out, step = np.full(len(x), float(self.bias)), max(1, CELLS // max(1, len(self.x)))
        for at in range(0, len(x) if len(self.x) else 0, step):
            out[at : at + step] += self.kernel(x[at : at + step], self.x) @ self.weights
        return out


def _dual(k: np.ndarray, sign: np.ndarray, linear_term: np.ndarray, c: float, tol: float, max_iter: int) -> tuple[np.ndarray, float]:
    """min 1/2 a'Qa + p'a, 0 <= a <= c, sign'a = 0, by the most violating pair."""
    n = len(sign)
    a, grad = np.zeros(n), linear_term.astype(float).copy()
    for _ in range(max_iter):
        score = -sign * grad
        up = ((sign > 0) & (a < c)) | ((sign < 0) & (a > 0))
        low = ((sign > 0) & (a > 0)) | ((sign < 0) & (a < c))
        if not up.any() or not low.any():
            break
        i, j = int(np.argmax(np.where(up, score, -np.inf))), int(np.argmin(np.where(low, score, np.inf)))
        if score[i] - score[j] < tol:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else c - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        grad += step * sign * (k[i] - k[j])
    score = -sign * grad
    free = (a > 1e-9) & (a < c - 1e-9)
    if free.any():
        return a, float(score[free].mean())
    up = ((sign > 0) & (a < c)) | ((sign < 0) & (a > 0))
    low = ((sign > 0) & (a > 0)) | ((sign < 0) & (a < c))
    return a, float((score[up].max() + score[low].min()) / 2) if up.any() and low.any() else 0.0


def fit_classifier(x: np.ndarray, y: np.ndarray, kernel: Kernel, c: float = 1.0, tol: float = 1e-3, max_iter: int = 100_000) -> Svm:
    """Labels are -1 and 1."""
    k, y = kernel(x, x), np.asarray(y, float)
    a, bias = _dual(k, y, -np.ones(len(y)), c, tol, max_iter)
    return Svm(kernel, x, a * y, bias)


def fit_regressor(x: np.ndarray, y: np.ndarray, kernel: Kernel, c: float = 1.0, eps: float = 0.1, tol: float = 1e-3, max_iter: int = 100_000) -> Svm:
    """Epsilon-insensitive regression: each row has an upper and a lower side."""
    k, n = kernel(x, x), len(y)
    sign = np.r_[np.ones(n), -np.ones(n)]
    a, bias = _dual(np.tile(k, (2, 2)), sign, np.r_[eps - y, eps + y], c, tol, max_iter)
    return Svm(kernel, x, a[:n] - a[n:], bias)


def _sample(df: DataFrame, vector: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).orderBy(F.xxhash64("v")).limit(SVM_ROWS).collect()
    return np.array([r["v"] for r in rows]), np.array([r["y"] for r in rows])


def svc(df: DataFrame, vector: str, label: str, kernel: Kernel, c: float = 1.0) -> Svm:
    """Fit on a bounded sample; labels are 0 and 1."""
    x, y = _sample(df, vector, label)
    return fit_classifier(x, np.where(y > 0, 1.0, -1.0), kernel, c)


def svr(df: DataFrame, vector: str, target: str, kernel: Kernel, c: float = 1.0, eps: float = 0.1) -> Svm:
    return fit_regressor(*_sample(df, vector, target), kernel, c, eps)


def decide(df: DataFrame, vector: str, model: Svm, out: str = "decision") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: shared.value.decision(np.stack([np.asarray(v, float) for v in pdf[vector]])) if len(pdf) else np.zeros(0)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {out} double")
