"""Leading eigenpairs of a symmetric matrix: Householder reduction, Sturm counts, inverse iteration.

The matrix is small (a covariance of the table's width) and lives on the driver. A zero matrix gives zeros and unit vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are kept orthogonal to each other


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors ``v`` that reduce the matrix, ``I - 2 v v'`` each."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.abs(v[1:]).max(initial=0) > 0:
            v[0] += length if v[0] >= 0 else -length
            v /= np.linalg.norm(v)
            below = a[k + 1 :, k + 1 :]
            p = below @ v
            w = p - (v @ p) * v
            below -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        else:
            v = np.zeros(n - k - 1)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each ``x``."""
    smallest = np.finfo(float).tiny / EPS

    def apart(q: np.ndarray) -> np.ndarray:
        return np.where(np.abs(q) < smallest, -smallest, q)

    q = apart(diagonal[0] - x)
    below = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = apart(diagonal[i] - x - off[i - 1] ** 2 / q)
        below += q < 0
    return below


def bisected(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until the interval cannot be halved."""
    n = len(diagonal)
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    slack = 1 + 4 * n * EPS
    low = np.full(k, (diagonal - reach).min()) - slack * np.abs(diagonal).max() * EPS * n - 1e-300
    high = np.full(k, (diagonal + reach).max()) + slack * np.abs(diagonal).max() * EPS * n + 1e-300
    place = n - np.arange(k)  # the j-th largest has n - j smaller ones
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = count_below(diagonal, off, middle) >= place
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)


def _factor(diagonal: np.ndarray, off: np.ndarray, value: float):
    """LU with partial pivoting of the tridiagonal matrix less ``value``: pivots, two upper bands, multipliers, swaps."""
    n = len(diagonal)
    d, up, second = (diagonal - value).tolist(), off.tolist() + [0.0], [0.0] * n
    factor, swap = [0.0] * n, [False] * n
    low = off.tolist()
    least = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny / EPS)
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            swap[i] = True
            m = d[i] / low[i]
            d[i], (up[i], d[i + 1]) = low[i], (d[i + 1], up[i] - m * d[i + 1])
            second[i] = up[i + 1]
            up[i + 1] = -m * up[i + 1]
        else:
            if d[i] == 0:
                d[i] = least
            m = low[i] / d[i]
            d[i + 1] -= m * up[i]
        factor[i] = m
    if abs(d[n - 1]) < least:
        d[n - 1] = least
    return d, up, second, factor, swap


def _solve(parts, b: np.ndarray) -> np.ndarray:
    d, up, second, factor, swap = parts
    x, n = b.tolist(), len(d)
    for i in range(n - 1):
        if swap[i]:
            x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
        else:
            x[i + 1] -= factor[i] * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= up[i] * x[i + 1]
        if i + 2 < n:
            rest -= second[i] * x[i + 2]
        x[i] = rest / d[i]
    return np.array(x)


def iterated(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column; those of near eigenvalues are made orthogonal again."""
    n = len(diagonal)
    norm = (np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max()
    rng = np.random.default_rng(7)
    vectors = np.zeros((n, len(values)))
    shift = first = 0
    for j, value in enumerate(values):
        near = j > 0 and values[j - 1] - value <= CLUSTER * norm
        first = first if near else j
        # Equal eigenvalues get shifts of their own, or the same vector would come again.
        shift = shift + 1 if j > 0 and values[j - 1] - value <= 10 * EPS * norm else 0
        parts = _factor(diagonal, off, value - shift * 10 * EPS * norm)
        x = rng.uniform(0.5, 1, n)
        for _ in range(rounds):
            x /= np.abs(x).max()
            x = _solve(parts, x)
            x /= np.abs(x).max()
            for _ in range(2):
                for i in range(first, j):
                    x -= (vectors[:, i] @ x) * vectors[:, i]
            length = np.linalg.norm(x)
            x = x / length if length > 0 else rng.uniform(-1, 1, n)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors, one a column."""
    scale = np.abs(matrix).max()
    if not scale > 0:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = bisected(diagonal, off, k)
    vectors = iterated(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values * scale, vectors
