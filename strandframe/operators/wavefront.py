"""The score of one very long pair, its matrix cut into tiles that many tasks work on.

Tiles on an anti-diagonal need only the borders of tiles before them, so each diagonal is one job over its tiles. What
goes between jobs are the scores along the border between done and open tiles, as many as the sequences are long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.kernels import LOW, boundary, codes
from ..scheme import CELL_FLOOR, DEFAULT, ScoringScheme

TILE = 4096
#: Symbols of both sequences together at most: they are broadcast, 4 bytes each, and so much again goes to the driver and back.
SYMBOLS = 1 << 26
_BORDER = ("top", "gaps_down", "left", "gaps_right")


def tile(x: np.ndarray, y: np.ndarray, top: np.ndarray, down: np.ndarray, left: np.ndarray, right: np.ndarray, scheme: ScoringScheme = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The lower and right borders of a tile and its largest cell.

    x, y: symbols of its columns and rows; top: scores above it, from the corner on; down: gaps that enter it from above;
    left: scores left of its rows; right: gaps that enter its first column.
    """
    o, e, w = scheme.gap_open, scheme.gap_extend, len(x)
    h, best = top.copy(), CELL_FLOOR
    last, leaving = np.empty(len(y), np.int32), np.empty(len(y), np.int32)
    steps = e * np.arange(w, dtype=np.int32)
    for i, symbol in enumerate(y):
        g = np.maximum(h[:-1] + np.where(x == symbol, np.int32(scheme.match), np.int32(scheme.mismatch)), down)
        # a gap in column j began in this row's tile before j, or came in from the left
        began = np.maximum.accumulate(np.concatenate([[np.int32(LOW)], g[:-1] - steps[:-1] + o]))
        f = np.maximum(began, right[i]) + steps
        new = np.maximum(g, f)
        h[0], h[1:] = left[i], new
        down = np.maximum(down, new + o) + e
        last[i], leaving[i] = new[-1], max(int(f[-1]), int(new[-1]) + o) + e
        best = max(best, int(new.max()))
    return h, down, last, leaving, best


def score_tiled(spark: SparkSession, a: str, b: str, scheme: ScoringScheme = DEFAULT, size: int = TILE) -> tuple[int, int]:
    """global_score and max_cell_score of one pair. An empty sequence needs no tile."""
    x, y = codes(a), codes(b)
    if len(x) + len(y) > SYMBOLS:
        raise ValueError(f"the sequences have more than {SYMBOLS} symbols together")
    if len(y) > len(x):
        x, y = y, x
    n, m = len(y), len(x)
    if not n:
        return int(boundary(m, scheme)[m]), CELL_FLOOR
    o, e = scheme.gap_open, scheme.gap_extend
    rows, cols = -(-n // size), -(-m // size)
    edge, side = boundary(m, scheme), boundary(n, scheme)
    top = {c: edge[c * size : (c + 1) * size + 1] for c in range(cols)}
    down = {c: top[c][1:] + o + e for c in range(cols)}
    left = {r: side[r * size + 1 : (r + 1) * size + 1] for r in range(rows)}
    right = {r: left[r] + o + e for r in range(rows)}
    both = spark.sparkContext.broadcast((x, y))
    kinds = [T.StructField(k, T.BinaryType()) for k in _BORDER]
    schema = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()), *kinds])
    result = T.StructType([*schema.fields, T.StructField("best", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = both.value
        for batch in batches:
            for row in batch.to_pylist():
                r, c = row["r"], row["c"]
                borders = [np.frombuffer(row[k], np.int32) for k in _BORDER]
                *out, best = tile(p[c * size : (c + 1) * size], q[r * size : (r + 1) * size], *borders, scheme)
                values = [[r], [c], *([v.astype(np.int32).tobytes()] for v in out), [best]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64()), strict=True)], names=result.fieldNames())

    cell = CELL_FLOOR
    for d in range(rows + cols - 1):
        own = [(r, d - r) for r in range(max(0, d - cols + 1), min(rows, d + 1))]
        open_ = [(r, c, *(v.astype(np.int32).tobytes() for v in (top[c], down[c], left[r], right[r]))) for r, c in own]
        done = spark.createDataFrame(open_, schema).repartition(len(open_)).mapInArrow(run, result).collect()
        for t in done:
            top[t.c], down[t.c], left[t.r], right[t.r] = (np.frombuffer(t[k], np.int32) for k in _BORDER)
            cell = max(cell, t.best)
    return int(top[cols - 1][-1]), cell
