"""Whole-number vectors: which rows have one, and exact products and distances in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to here are exact as doubles, and those that a long holds.
EXACT, LONG = 1 << 53, (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _peak(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _kind(most: int) -> type:
    """The fastest type in which sums up to ``most`` are exact; whole numbers of any size where a long is too small."""
    return np.float64 if most < EXACT else np.int64 if most < LONG else object


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``."""
    kind = _kind(_peak(a) * _peak(b) * a.shape[1])
    out = a.astype(kind) @ b.T.astype(kind)
    return out if kind is object else out.astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all of ``b``."""
    kind = _kind((_peak(a) + _peak(b)) ** 2 * a.shape[1])
    a, b = a.astype(kind), b.astype(kind)
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return out if kind is object else out.astype(np.int64)


def own_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` from the same row of ``b``."""
    kind = _kind((_peak(a) + _peak(b)) ** 2 * a.shape[1])
    gap = a.astype(kind) - b.astype(kind)
    out = (gap * gap).sum(axis=1)
    return out if kind is object else out.astype(np.int64)


def as_long(x: np.ndarray) -> np.ndarray:
    """Values beyond a long are held at its ends."""
    return np.array([min(max(int(v), -LONG - 1), LONG) for v in x.ravel()], np.int64).reshape(x.shape) if x.dtype == object else x
