"""Linear models from sufficient statistics: one pass over the rows gives the
Gram matrix, and the rest is a small dense problem on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, means and centred cross-products of features and target."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Means first, then products of deviations: no cancellation."""
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n, mean = row["n"], np.array([row[f"m{i}"] for i in range(len(columns))], float)
    dev = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    got = df.agg(*[F.sum(dev[i] * dev[j]).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]).first()
    cross = np.zeros((len(columns), len(columns)))
    for k, (i, j) in enumerate(pairs):
        cross[i, j] = cross[j, i] = got[f"p{k}"]
    return Moments(n, mean, cross)


@dataclass
class Linear:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients, strict=True):
            out = out + F.col(c) * float(w)
        return out


def _solved(m: Moments, features: list[str], w: np.ndarray) -> Linear:
    return Linear(features, w, float(m.mean[-1] - m.mean[:-1] @ w))


def least_squares(df: DataFrame, features: list[str], target: str) -> Linear:
    m = moments(df, [*features, target])
    return _solved(m, features, np.linalg.lstsq(m.cross[:-1, :-1], m.cross[:-1, -1], rcond=None)[0])


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, normalize: bool = True) -> Linear:
    """Penalty alpha on the coefficients of (standardised) features."""
    m = moments(df, [*features, target])
    scale = np.sqrt(np.diag(m.cross)[:-1] / m.n) if normalize else np.ones(len(features))
    a = m.cross[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(features))
    return _solved(m, features, np.linalg.solve(a, m.cross[:-1, -1] / scale) / scale)


def elastic_net(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, l1_ratio: float = 0.5, normalize: bool = True, tol: float = 1e-8, max_iter: int = 10_000) -> Linear:
    """Coordinate descent on 1/2 |y - Xw|^2 + n alpha (l1 |w| + (1 - l1)/2 |w|^2)."""
    m = moments(df, [*features, target])
    scale = np.sqrt(np.diag(m.cross)[:-1] / m.n) if normalize else np.ones(len(features))
    g, b = m.cross[:-1, :-1] / np.outer(scale, scale), m.cross[:-1, -1] / scale
    w, l1, l2 = np.zeros(len(features)), m.n * alpha * l1_ratio, m.n * alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        before = w.copy()
        for j in range(len(w)):
            r = b[j] - g[j] @ w + g[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - l1, 0) / (g[j, j] + l2)
        if np.abs(w - before).max() < tol:
            break
    return _solved(m, features, w / scale)


def lasso(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, **kw) -> Linear:
    return elastic_net(df, features, target, alpha, 1.0, **kw)


def logistic(df: DataFrame, features: list[str], label: str, max_iter: int = 100):
    """Binary or multinomial logistic regression without a penalty, fitted by Spark."""
    from pyspark.ml.classification import LogisticRegression

    rows = assembled(df, features).withColumn("label", F.col(label).cast("double"))
    return LogisticRegression(maxIter=max_iter, regParam=0.0).fit(rows)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def pca(df: DataFrame, columns: list[str], k: int = 2, correlation: bool = False) -> np.ndarray:
    """Projection matrix (columns x k) from the covariance or correlation matrix.

    A component's largest loading is positive.
    """
    m = moments(df, columns)
    cov = m.cross / (m.n - 1)
    if correlation:
        s = np.sqrt(np.diag(cov))
        cov = cov / np.outer(s, s)
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, np.argsort(-values, kind="stable")[:k]]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return v / s[:, None] if correlation else v


def project(columns: list[str], matrix: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """Rows times a matrix, as an array column."""
    shift = np.zeros(len(columns)) if mean is None else mean
    cells = []
    for j in range(matrix.shape[1]):
        out = F.lit(0.0)
        for c, w, m in zip(columns, matrix[:, j], shift, strict=True):
            out = out + (F.col(c) - float(m)) * float(w)
        cells.append(out)
    return F.array(*cells)


def truncated_svd(df: DataFrame, columns: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns x k) and values, from the uncentred Gram matrix."""
    m = moments(df, columns)
    gram = m.cross + m.n * np.outer(m.mean, m.mean)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")[:k]
    v = vectors[:, order]
    return v * np.sign(v[np.abs(v).argmax(axis=0), range(k)]), np.sqrt(np.maximum(values[order], 0))
