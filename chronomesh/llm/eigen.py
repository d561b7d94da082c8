"""Leading eigenvectors of a small symmetric matrix.

Householder reflections make the matrix tridiagonal; Sturm counts (how many eigenvalues lie below a shift) bracket
the leading eigenvalues by bisection; inverse iteration on the tridiagonal matrix gives their vectors, those of
neighbouring eigenvalues being made orthogonal to each other at every step; the reflections bring them back.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            mirrors.append(np.zeros(n - k - 1))
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        lower = a[k + 1:, k + 1:]
        p = lower @ v
        w = p - (v @ p) * v
        lower -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1:, k]
        column -= 2 * (v @ column) * v
        a[k, k + 1:] = column
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift."""
    tiny = EPS * max(np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0)) + np.finfo(float).tiny
    count, q = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for i, d in enumerate(diagonal):
        q = d - shifts - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling."""
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = EPS * len(diagonal) * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - margin, high + margin
    wanted = len(diagonal) - 1 - np.arange(k)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= EPS * np.abs(middle))).all():
            return middle
        left = below(diagonal, off, middle) <= wanted
        low, high = np.where(left, middle, low), np.where(left, high, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of the tridiagonal system, by elimination with row exchanges."""
    n = len(diagonal)
    d, u1, u2, b = diagonal.tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        below_ = off[i]
        if abs(below_) > abs(d[i]):  # exchange the two rows
            factor = d[i] / below_
            d[i], d[i + 1], u1[i] = float(below_), u1[i] - factor * d[i + 1], d[i + 1]
            if i + 1 < n - 1:
                u2[i], u1[i + 1] = u1[i + 1], -factor * u1[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            factor = below_ / (d[i] or tiny)
            d[i + 1] -= factor * u1[i]
            b[i + 1] -= factor * b[i]
    x = [0.0] * (n + 2)
    for i in reversed(range(n)):
        pivot = d[i] if abs(d[i]) > tiny else (tiny if d[i] >= 0 else -tiny)
        x[i] = (b[i] - u1[i] * x[i + 1] - u2[i] * x[i + 2]) / pivot
    return np.array(x[:n])


def leading(a: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    n = len(a)
    k = min(k, n)
    scale = np.abs(a).max(initial=0.0)
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(k, n)
    diagonal, off, mirrors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    tiny, draw, vectors, first, shift = EPS * norm, np.random.default_rng(0), np.zeros((k, n)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues get shifts that differ
        shift = value if j == first else min(value, shift - 10 * tiny)
        x, best = draw.standard_normal(n), np.inf
        for _ in range(rounds):
            x = x / np.abs(x).max()
            x = solved(diagonal - shift, off, x, tiny)
            x = x / np.abs(x).max()
            for _ in range(2):
                x = x - vectors[first:j].T @ (vectors[first:j] @ x)
            x /= np.linalg.norm(x)
            rest = diagonal * x - value * x
            rest[:-1] += off * x[1:]
            rest[1:] += off * x[:-1]
            miss = np.linalg.norm(rest)
            if miss < best:
                best, vectors[j] = miss, x
            elif best < 64 * tiny * np.sqrt(n):
                break
    for i in reversed(range(len(mirrors))):
        v = mirrors[i]
        vectors[:, i + 1:] -= 2 * np.outer(vectors[:, i + 1:] @ v, v)
    return values * scale, vectors
