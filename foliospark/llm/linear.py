"""Linear models on hashed features, fitted on a bounded sample with NumPy."""

from __future__ import annotations

import numpy as np

from foliospark.llm.textkernel import row_sums


def logistic(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray, steps: int = 300, decay: float = 1e-4, ones: tuple[np.ndarray, np.ndarray, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and bias of independent logistic regressions, one per column of y (0 or 1), by accelerated gradient.

    ones: rows, columns and their number of features that are 1 where named and 0 elsewhere; they follow those of x and are never held densely.
    """
    row, column, many = ones or (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    dense = x.shape[1]
    by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
    column_of, row_of = column[by_row], row[by_column]
    row_at, column_at = np.searchsorted(row[by_row], np.arange(len(x) + 1)), np.searchsorted(column[by_column], np.arange(many + 1))
    w, b = np.zeros((dense + many, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    share = (weights / weights.sum()).astype(np.float32)[:, None]
    squares = np.einsum("ij,ij->i", x, x) + np.diff(row_at)
    rate = 4.0 / max(float(share[:, 0] @ squares) + 1.0, 1e-9)
    at, at_b, before, before_b = w, b, w, b
    for i in range(steps):
        score = x @ at[:dense] + at_b
        score = score + row_sums(at[dense + column_of], row_at) if many else score
        miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * share
        slope = np.concatenate([x.T @ miss, row_sums(miss[row_of], column_at)]) if many else x.T @ miss
        w, b = at - rate * (slope + decay * at), at_b - rate * miss.sum(0)
        push = i / (i + 3)
        at, at_b = w + push * (w - before), b + push * (b - before_b)
        before, before_b = w, b
    return w, b
