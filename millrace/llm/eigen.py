"""Leading eigenvalues and eigenvectors of one symmetric matrix.

Householder reflections make it tridiagonal, Sturm counts bisect for the wanted eigenvalues and
inverse iteration gives their vectors, those of close eigenvalues made orthogonal to each other.
The matrix has as many rows as a vector has entries, however many vectors there are.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and q, with matrix = q t q' for the tridiagonal t."""
    a = np.array(matrix, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        x[0] += size if x[0] >= 0 else -size
        v = x / np.linalg.norm(x)
        # The reflection 1 - 2 v v' on both sides of what is left, as an update of rank two.
        rest = a[k + 1 :, k + 1 :]
        p = 2.0 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each x: the negative terms of its Sturm sequence."""
    tiny = _EPS * max(1e-290, float(np.abs(off).max(initial=0.0))) + 1e-300
    count = np.zeros(len(x), int)
    term = np.ones(len(x))
    for i, d in enumerate(diagonal):
        term = d - x - (off[i - 1] ** 2 / term if i else 0.0)
        term = np.where(np.abs(term) < tiny, -tiny, term)
        count += term < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection until the ends are neighbours."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    reach = max(1e-300, float(np.abs(diagonal).max() + radius.max()))
    wanted = n - 1 - np.arange(k)  # so many lie below
    low, high = np.full(k, -reach * 1.01), np.full(k, reach * 1.01)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high) & (high - low > 0.5 * _EPS * reach * 1e-2)
        if not open_.any():
            return middle
        under = below(diagonal, off, middle) <= wanted
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(t - value) y = right by elimination with row exchanges, where a zero pivot is a tiny one."""
    n = len(diagonal)
    rows = [[diagonal[0] - value, off[0] if n > 1 else 0.0, 0.0]]  # the row that eliminates next
    y = right.copy()
    upper = []
    for i in range(n - 1):
        here = rows.pop()
        below_ = [off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0]
        if abs(below_[0]) > abs(here[0]):
            here, below_ = below_, here
            y[i], y[i + 1] = y[i + 1], y[i]
        pivot = here[0] if here[0] != 0.0 else tiny
        factor = below_[0] / pivot
        upper.append((pivot, here[1], here[2]))
        rows.append([below_[1] - factor * here[1], below_[2] - factor * here[2], 0.0])
        y[i + 1] -= factor * y[i]
    last = rows.pop()[0]
    upper.append((last if last != 0.0 else tiny, 0.0, 0.0))
    for i in range(n - 1, -1, -1):
        pivot, one, two = upper[i]
        if abs(pivot) < tiny:
            pivot = tiny if pivot >= 0 else -tiny
        y[i] = (y[i] - (one * y[i + 1] if i + 1 < n else 0.0) - (two * y[i + 2] if i + 2 < n else 0.0)) / pivot
        if abs(y[i]) > 1e150:
            y *= 1e-150
    return y


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and unit eigenvectors as columns, each with its entry of greatest size positive."""
    n = len(matrix)
    k = min(k, n)
    if k == 0:
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(matrix).max())
    if scale == 0.0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    random = np.random.Generator(np.random.PCG64(7))
    vectors = np.zeros((n, k))
    start = 0  # of the cluster
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            start = i
        y = random.standard_normal(n)
        # Equal eigenvalues are told apart by a few rounding errors.
        shift = values[i] - (i - start) * 4 * _EPS * norm
        for _ in range(5):
            y = _solve(diagonal, off, shift, y / np.linalg.norm(y), _EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= vectors[:, start:i] @ (vectors[:, start:i].T @ y)
        vectors[:, i] = y / np.linalg.norm(y)
    vectors = q @ vectors
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, vectors
