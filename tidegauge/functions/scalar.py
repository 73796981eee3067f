"""Scalar functions: bit widths, zigzag, distances, kernels and array arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def zigzag_positive_odd(x: Column) -> Column:
    """The other convention: positive values become odd."""
    return F.when(x <= 0, x * -2).otherwise(x * 2 - 1)


def bit_width(x: Column) -> Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("long")))).cast("int")


def split_bits(x: Column, low: int) -> tuple[Column, Column]:
    """High part and the ``low`` lowest bits."""
    return F.shiftright(x, low), x.bitwiseAND(F.lit((1 << low) - 1).cast("long"))


def second_wins_max(a: Column, b: Column) -> Column:
    """Greater of two; where either is NaN the second."""
    return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.when(a > b, a).otherwise(b))


def second_wins_min(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.when(a < b, a).otherwise(b))


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: over zero it is infinite, or NaN for zero itself."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def bits_to_int(bits: Column) -> Column:
    """Number of a string of binary digits, least significant first."""
    return F.conv(F.reverse(bits), 2, 10).cast("long")


# ----------------------------------------------------------------- arrays
def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f) -> Column:
    """``f`` over pairs; the longer array is cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: f(x.cast("double"), y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(zipped(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: int) -> Column:
    if p < 1:
        raise ValueError("p must be at least 1")
    return F.pow(_sum(zipped(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def hamming(a: Column, b: Column) -> Column:
    """Share of positions that differ."""
    return _sum(zipped(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(a)


def mahalanobis(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Distance under the sample covariance of ``data``."""
    d = np.asarray(x, float) - np.asarray(y, float)
    return float(np.sqrt(d @ np.linalg.solve(np.cov(np.asarray(data, float), rowvar=False), d)))


def dot(a: Column, b: Column) -> Column:
    return _sum(zipped(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def norm(a: Column, p: float) -> Column:
    """p-norm; infinities give the greatest and least magnitude."""
    size = F.transform(a, lambda x: F.abs(x.cast("double")))
    if p == float("inf"):
        return F.array_max(size)
    if p == float("-inf"):
        return F.array_min(size)
    return F.pow(_sum(F.transform(size, lambda x: F.pow(x, F.lit(p)))), F.lit(1.0 / p))


def normalize(a: Column) -> Column:
    n = norm2(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def elementwise(a: Column, b: Column, op: str) -> Column:
    """add, sub, mul or div of two arrays."""
    f = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}[op]
    return zipped(a, b, f)


def scaled(a: Column, op: str, c: float) -> Column:
    """add, sub, mul, div or pow of an array and a number."""
    c = F.lit(float(c))
    f = {"add": lambda x: x + c, "sub": lambda x: x - c, "mul": lambda x: x * c, "div": lambda x: x / c, "pow": lambda x: F.pow(x, c)}[op]
    return F.transform(a, lambda x: f(x.cast("double")))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(e))


def max_diff(a: Column, b: Column) -> Column:
    return F.array_max(zipped(a, b, lambda x, y: F.abs(x - y)))


def approximately_equal(a: Column, b: Column, error: float) -> Column:
    return (F.size(a) == F.size(b)) & (max_diff(a, b) <= F.lit(error))


def argmax(a: Column) -> Column:
    """Zero-based position of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# ---------------------------------------------------------------- kernels
def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def rbf_kernel(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * squared_distance(a, b))


def polynomial_kernel(a: Column, b: Column, degree: float, gamma: float, coef: float) -> Column:
    return F.pow(F.lit(gamma) * dot(a, b) + F.lit(coef), F.lit(degree))


def sigmoid_kernel(a: Column, b: Column, gamma: float, coef: float) -> Column:
    return F.tanh(F.lit(gamma) * dot(a, b) + F.lit(coef))


def shape_kernel(a: Column, b: Column, sigma: float) -> Column:
    """exp(-(norm / 2) * sigma^2): the norm is not squared."""
    return F.exp(-euclidean(a, b) / 2.0 * F.lit(sigma) * F.lit(sigma))


def sigmoid(x: Column) -> Column:
    """Logistic function, clipped beyond 40."""
    return F.when(x < -40, 0.0).when(x > 40, 1.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def ln_1pe(x: Column) -> Column:
    return F.when(x > 15, x).otherwise(F.log1p(F.exp(x)))


def copysign(x: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(x)).otherwise(F.abs(x))
