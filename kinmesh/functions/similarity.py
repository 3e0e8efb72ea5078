"""Jaro-Winkler similarity in Arrow batches, vectorised over the pairs of a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(texts), width), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def jaro_winkler_batch(a: list[str], b: list[str], scale: float = 0.1, longest_prefix: int = 4, boost_above: float = 0.7) -> np.ndarray:
    """Similarities of two lists of non-empty texts, pair by pair."""
    if not a:
        return np.zeros(0)
    x, n = _matrix(a)
    y, m = _matrix(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    taken_x, taken_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    row = np.arange(len(a))
    for i in range(x.shape[1]):
        live = i < n
        free = live.copy()
        top = int(reach.max(initial=0))
        for j in range(max(0, i - top), min(y.shape[1], i + top + 1)):
            hit = free & (np.abs(i - j) <= reach) & (j < m) & ~taken_y[:, j] & (x[:, i] == y[:, j])
            taken_y[hit, j] = True
            taken_x[hit, i] = True
            free &= ~hit
    common = taken_x.sum(axis=1)
    # matched characters in order, padded with 0, to count those out of place
    width = int(common.max(initial=0))
    left, right = np.zeros((len(a), max(width, 1)), np.uint32), np.zeros((len(a), max(width, 1)), np.uint32)
    for src, taken, out in ((x, taken_x, left), (y, taken_y, right)):
        r, c = np.nonzero(taken)
        out[r, np.cumsum(taken, axis=1)[r, c] - 1] = src[r, c]
    moved = (left != right).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / n + common / m + (common - moved) / np.maximum(common, 1)) / 3.0, 0.0)
    width = min(longest_prefix, x.shape[1], y.shape[1])
    same = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1) if width else np.zeros(len(a), np.int64)
    del row
    return np.where(jaro > boost_above, jaro + prefix * scale * (1 - jaro), jaro)


@F.pandas_udf(T.DoubleType())
def _udf(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna() & (a != "") & (b != "")).to_numpy()
    out = np.zeros(len(a))
    out[both] = jaro_winkler_batch(a[both].tolist(), b[both].tolist())
    return pd.Series(out)


def jaro_winkler(a, b):
    """Similarity of two columns; 0 if either is null or empty. Equal values never reach Python's comparison."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    differ = a != b
    found = _udf(F.when(differ, a), F.when(differ, b))
    return F.when((a == b) & (a != ""), 1.0).otherwise(found)
