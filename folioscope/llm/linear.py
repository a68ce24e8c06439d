"""Small dense linear algebra in plain numpy.

The driver's process starts threads and children of its own, in which a threaded BLAS can come to a standstill, so the
driver calls none.
"""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x`` with ``a @ x = b`` for a square ``a``, by elimination with row pivots."""
    n = len(a)
    rows = np.hstack([a.astype(float), b.reshape(n, -1).astype(float)])
    for i in range(n):
        p = i + int(np.argmax(np.abs(rows[i:, i])))
        if abs(rows[p, i]) < 1e-12:
            raise ValueError("the matrix is singular")
        if p != i:
            rows[[i, p]] = rows[[p, i]]
        rows[i] /= rows[i, i]
        factors = rows[:, i].copy()
        factors[i] = 0
        rows -= factors[:, None] * rows[i]
    return rows[:, n:].reshape(b.shape)


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrix times vector."""
    return np.einsum("ij,j->i", a, v)


class Sparse:
    """A matrix of zeros and ones, as the columns of the ones of each row. Columns of other numbers may stand beside it, and then
    a column of ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width = width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, on: np.ndarray) -> Sparse:
        at = np.flatnonzero(on) if on.dtype == bool else on
        edges = np.concatenate(([0], np.cumsum(self.sizes)))
        return Sparse([self.column[edges[i] : edges[i + 1]].tolist() for i in at.tolist()], self.width)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[self.row, self.column] = 1
        return out

    def times(self, w: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """Product with weights: those of the ones, of the columns beside, and of the column of ones."""
        k = self.width
        return np.bincount(self.row, w[self.column], len(self)) + times(beside, w[k : k + beside.shape[1]]) + w[-1]

    def back(self, v: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """Product of the transpose with ``v``."""
        return np.concatenate([np.bincount(self.column, v[self.row], self.width), times(beside.T, v), [v.sum()]])

    def back_squares(self, v: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """The same for the squares of all entries."""
        return self.back(v, beside * beside)
