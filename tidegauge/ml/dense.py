"""Small dense problems on the driver: factorisations and optimisers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with P a = L U, by partial pivoting."""
    u = np.array(a, float)
    n = len(u)
    p, low = np.eye(n), np.eye(n)
    for k in range(n):
        r = k + int(np.abs(u[k:, k]).argmax())
        u[[k, r]], p[[k, r]] = u[[r, k]], p[[r, k]]
        low[[k, r], :k] = low[[r, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return p, low, np.triu(u)


qr, cholesky, svd, inverse = np.linalg.qr, np.linalg.cholesky, np.linalg.svd, np.linalg.inv


def solve(a: np.ndarray, b: np.ndarray, by: str = "lu") -> np.ndarray:
    """a x = b by lu, qr, cholesky or svd (least squares)."""
    if by == "qr":
        q, r = np.linalg.qr(a)
        return np.linalg.solve(r, q.T @ b)
    if by == "cholesky":
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    if by == "svd":
        return np.linalg.lstsq(a, b, rcond=None)[0]
    return np.linalg.solve(a, b)


def eigen(a: np.ndarray, symmetric: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order, and their vectors as columns."""
    values, vectors = (np.linalg.eigh if symmetric else np.linalg.eig)(a)
    order = np.argsort(-values.real, kind="stable")
    return values[order], vectors[:, order]


def line_search(f: Callable, df: Callable, x: np.ndarray, step: np.ndarray, shrink: float = 0.5, slope: float = 1e-4) -> float:
    """Backtracking until the decrease is a share of what the slope promises."""
    t, fx, g = 1.0, f(x), df(x) @ step
    while f(x + t * step) > fx + slope * t * g and t > 1e-16:
        t *= shrink
    return t


def gradient_descent(f: Callable, df: Callable, x0: np.ndarray, max_iter: int = 10_000, tol: float = 1e-8) -> np.ndarray:
    x = np.array(x0, float)
    for _ in range(max_iter):
        g = df(x)
        if np.abs(g).max() < tol:
            break
        x = x - line_search(f, df, x, -g) * g
    return x


def lbfgs(f: Callable, df: Callable, x0: np.ndarray, memory: int = 10, max_iter: int = 1000, tol: float = 1e-8) -> np.ndarray:
    x, pairs = np.array(x0, float), []
    g = df(x)
    for _ in range(max_iter):
        if np.abs(g).max() < tol:
            break
        d, coefs = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            coefs.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(coefs), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        t = line_search(f, df, x, d)
        nx = x + t * d
        ng = df(nx)
        if (nx - x) @ (ng - g) > 1e-12:
            pairs = [*pairs, (nx - x, ng - g)][-memory:]
        x, g = nx, ng
    return x


def biconjugate_gradient(a: np.ndarray, b: np.ndarray, max_iter: int = 1000, tol: float = 1e-10) -> np.ndarray:
    x = np.zeros_like(b, float)
    r = b - a @ x
    s, p, q = r.copy(), r.copy(), r.copy()
    rho = s @ r
    for _ in range(max_iter):
        if np.linalg.norm(r) < tol:
            break
        ap = a @ p
        alpha = rho / (q @ ap)
        x, r, s = x + alpha * p, r - alpha * ap, s - alpha * (a.T @ q)
        new = s @ r
        p, q, rho = r + new / rho * p, s + new / rho * q, new
    return x
