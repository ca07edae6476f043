"""Alignment of pairs in Arrow batches: the NumPy kernels as column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scheme import DEFAULT, ScoringScheme
from .kernels import align, score_batch

#: Cells of the largest pair times pairs that are worked on in step.
CELLS = 4_000_000
ALIGNED = "global_score bigint, max_cell_score bigint, swapped boolean, row_a string, row_b string, ops string"


def _chunks(pairs: list[tuple[str, str]]) -> list[list[int]]:
    """Pairs of like length together, few enough that padding and memory stay small."""
    order = sorted(range(len(pairs)), key=lambda i: (max(map(len, pairs[i])), min(map(len, pairs[i]))))
    out: list[list[int]] = []
    for i in order:
        if out and len(out[-1]) < 1024 and (len(out[-1]) + 1) * (max(map(len, pairs[i])) + 1) <= CELLS:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def scores(a: Column, b: Column, scheme: ScoringScheme = DEFAULT, once: bool = False) -> Column:
    """struct(global_score, max_cell_score); memory grows with the length of the longer string. Null if either is.

    once keeps Spark from working it out a second time for a filter on the scores."""

    @F.pandas_udf("global_score bigint, max_cell_score bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = list(zip(x, y, strict=True))
        total, cell = [0] * len(pairs), [0] * len(pairs)
        for own in _chunks(pairs):
            g, c = score_batch([pairs[i] for i in own], scheme)
            for i, u, v in zip(own, g.tolist(), c.tolist(), strict=True):
                total[i], cell[i] = u, v
        return pd.DataFrame({"global_score": total, "max_cell_score": cell})

    kernel = run.asNondeterministic() if once else run
    return F.when(a.isNotNull() & b.isNotNull(), kernel(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def aligned(a: Column, b: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """struct of ALIGNED: scores, gapped rows and operations; memory grows with the product of the lengths, three bytes a cell."""

    @F.pandas_udf(ALIGNED)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [align(p, q, scheme) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["global_score", "max_cell_score", "swapped", "row_a", "row_b", "ops"])

    return F.when(a.isNotNull() & b.isNotNull(), run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
