"""Global score within a band of diagonals that is widened until no path outside it can score more."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scheme import DEFAULT, ScoringScheme
from .kernels import LOW, codes

#: Diagonals on each side of the two ends' in the first band.
FIRST = 8


def _within(y: np.ndarray, x: np.ndarray, w: int, scheme: ScoringScheme) -> int:
    """The best score of paths that stay within w diagonals of those of both ends; x is at least as long as y.

    A row is kept by diagonal: position d of row i is column i + d - w."""
    o, e, n, m = scheme.gap_open, scheme.gap_extend, len(y), len(x)
    at = np.arange(m - n + 2 * w + 1) - w  # columns of row 0
    k = e * np.arange(len(at), dtype=np.int64)
    h = np.where(at > 0, o + e * at.astype(np.int64), LOW)
    h[at > m] = LOW
    h[w] = 0
    down = np.full(len(at), LOW, np.int64)
    for i in range(1, n + 1):
        j = at + i
        inside = (j >= 1) & (j <= m)
        up = np.full(len(at), LOW, np.int64)
        up[:-1] = np.maximum(down[1:], h[1:] + o) + e
        same = x[np.clip(j - 1, 0, max(0, m - 1))] == y[i - 1]
        g = np.maximum(up, np.where(inside, h + np.where(same, scheme.match, scheme.mismatch), LOW))
        g[j == 0] = o + e * i
        g[(j < 0) | (j > m)] = LOW
        new = g.copy()
        new[1:] = np.maximum(g[1:], np.maximum.accumulate(g - k)[:-1] + k[1:] + o)
        new[(j < 0) | (j > m)] = LOW
        h, down = new, np.where((j < 0) | (j > m), LOW, up)
    return int(h[m - n + w])


def _outside(n: int, m: int, w: int, scheme: ScoringScheme) -> int:
    """No path that leaves the band scores more: it has w + 1 symbols of the shorter string in gaps, and gaps in both."""
    bound = lambda pairs: pairs * max(scheme.match, scheme.mismatch) + (n + m - 2 * pairs) * scheme.gap_extend + 2 * scheme.gap_open
    return max(bound(0), bound(n - w - 1))


def score(a: str, b: str, scheme: ScoringScheme = DEFAULT, first: int = FIRST) -> tuple[int, int]:
    """global_score, exact, and the cells worked out for it, those of all bands."""
    x, y = codes(a), codes(b)
    if len(y) > len(x):
        x, y = y, x
    n, m, w, cells = len(y), len(x), first, 0
    while True:
        w = min(w, n)
        best = _within(y, x, w, scheme)
        cells += n * (m - n + 2 * w + 1)
        if w == n or best >= _outside(n, m, w, scheme):
            return best, cells
        w *= 2


def scores(a: Column, b: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """struct(global_score, cells); null if either is. Suits long strings that differ little: memory grows with the band."""

    @F.pandas_udf("global_score bigint, cells bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(p, q, scheme) for p, q in zip(x, y, strict=True)], columns=["global_score", "cells"])

    return F.when(a.isNotNull() & b.isNotNull(), run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
