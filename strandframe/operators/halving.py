"""Alignment of long pairs in linear space: a pair is cut where its best alignment crosses the middle, and its halves become
pairs of their own, for other tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import boundary, codes, horizontal
from ..scheme import DEFAULT, ScoringScheme
from .pairwise import rescored

#: Cells of a piece that is traced back whole, three bytes each.
LEAF = 1 << 22
#: Symbols of a task that has more than one piece.
SYMBOLS = 1 << 22
PIECE = "k bigint, i0 bigint, j0 bigint, a string, b string, top boolean, bottom boolean, ops string"
KEY = ["k", "i0", "j0"]


def _steps(y: np.ndarray, x: np.ndarray, top: bool, scheme: ScoringScheme) -> Iterator[tuple[np.ndarray, ...]]:
    """Row by row, at columns 0 to m: scores and those that end in a gap along the column, both of the row above, and
    scores that end in a gap along the row, at columns 1 to m.

    top: a gap along the column that begins in the first column goes on from above, so that opening it costs nothing."""
    o, e = scheme.gap_open, scheme.gap_extend
    h = boundary(len(x), scheme)
    down = np.full(len(x) + 1, -(1 << 29), np.int32)
    if top:
        down[0] = 0
    for c in y:
        up = np.maximum(down, h + o) + e
        g = up.copy()
        g[1:] = np.maximum(up[1:], h[:-1] + np.where(x == c, np.int32(scheme.match), np.int32(scheme.mismatch)))
        f = horizontal(g, scheme)
        new = np.concatenate([g[:1], np.maximum(g[1:], f)])
        yield new, up, h, down, f
        h, down = new, up


def border(a: str, b: str, top: bool, scheme: ScoringScheme = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all of a with each beginning of b, and the best of them that end in a gap in b. a isn't empty."""
    for h, down, *_ in _steps(codes(a), codes(b), top, scheme):
        pass
    return h, down


def crossing(above: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray], scheme: ScoringScheme = DEFAULT) -> tuple[int, bool]:
    """The column in which a best alignment crosses from the upper half to the lower, whose border is that of its strings
    reversed, and whether it does so within a gap. The first such column; between symbols if both are as good."""
    h = above[0].astype(np.int64) + below[0][::-1]
    gap = above[1].astype(np.int64) + below[1][::-1] - scheme.gap_open
    i, j = int(h.argmax()), int(gap.argmax())
    return (j, True) if gap[j] > h[i] else (i, False)


def leaf(a: str, b: str, top: bool, bottom: bool, scheme: ScoringScheme = DEFAULT) -> str:
    """Operations (= X D I) of a best alignment of a piece; bottom: a gap in b at its end goes on below and opens free."""
    n, m, o = len(a), len(b), scheme.gap_open
    if not n or not m:
        return "D" * n + "I" * m
    y, x = codes(a), codes(b)
    way, on, along = np.empty((n, m + 1), np.int8), np.empty((n, m + 1), bool), np.zeros((n, m + 1), bool)
    for i, (h, up, above, down, f) in enumerate(_steps(y, x, top, scheme)):
        d = above[:-1] + np.where(x == y[i], np.int32(scheme.match), np.int32(scheme.mismatch))
        way[i, 0], way[i, 1:] = 2, np.where(h[1:] == d, 1, np.where(h[1:] == up[1:], 2, 0))
        on[i] = down >= above + o  # a gap along the column goes on from the row above
        along[i, 2:] = f[:-1] >= h[1:-1] + o
    i, j, out = n, m, []
    stay = 2 if bottom and up[m] - o >= h[m] else -1
    while i and j:
        move = stay if stay >= 0 else int(way[i - 1, j])
        if move == 1:
            out.append("=" if y[i - 1] == x[j - 1] else "X")
            i, j, stay = i - 1, j - 1, -1
        elif move == 2:
            out.append("D")
            stay = 2 if on[i - 1, j] else -1
            i -= 1
        else:
            out.append("I")
            stay = 0 if along[i - 1, j] else -1
            j -= 1
    return "D" * i + "I" * j + "".join(reversed(out))


def _borders(halves: DataFrame, scheme: ScoringScheme) -> DataFrame:
    """Halves with the scores along the line between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [border(a[::-1], b[::-1], bottom, scheme) if lower else border(a, b, top, scheme) for a, b, top, bottom, lower in zip(p.a, p.b, p.top, p.bottom, p.lower, strict=True)]
            yield p.assign(h=[h.tobytes() for h, _ in found], e=[e.tobytes() for _, e in found])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in halves.schema)
    return halves.mapInPandas(run, f"{fields}, h binary, e binary")


def _cut(halves: DataFrame, scheme: ScoringScheme) -> DataFrame:
    """The pieces that two halves with their borders leave: two, and the symbols beside the line if a gap crosses it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        up, low = (p[p.lower == x].iloc[0] for x in (False, True))
        read = lambda r: (np.frombuffer(r.h, np.int32), np.frombuffer(r.e, np.int32))
        j, gap = crossing(read(up), read(low), scheme)
        n, g = len(up.a), int(gap)
        out = [(up.k, up.i0, up.j0, up.a[: n - g], up.b[:j], up.top, gap, None), (up.k, up.i0 + n + g, up.j0 + j, low.a[g:], up.b[j:], gap, up.bottom, None)]
        if gap:
            out.append((up.k, up.i0 + n - 1, up.j0 + j, up.a[n - 1] + low.a[0], "", False, False, "DD"))
        return pd.DataFrame([r for r in out if r[3] or r[4]], columns=["k", "i0", "j0", "a", "b", "top", "bottom", "ops"])

    return halves.groupBy(*KEY).applyInPandas(run, PIECE)


def _spread(df: DataFrame, rows: int, symbols: int) -> DataFrame:
    """Rows one a task while there are few, so that a long one doesn't wait for another."""
    few = 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, max(few, symbols // SYMBOLS))))


def _size(df: DataFrame) -> tuple[int, int]:
    n, symbols = df.agg(F.count(F.lit(1)), F.sum(F.char_length("a") + F.char_length("b"))).first()
    return n, symbols or 0


def _large(cells: int) -> Column:
    n = F.char_length("a").cast("bigint")
    return F.col("ops").isNull() & (n > 1) & (n * F.char_length("b") > cells)


def align_pieces(df: DataFrame, key: str, folder: str, a: str = "a", b: str = "b", scheme: ScoringScheme = DEFAULT, cells: int = LEAF) -> DataFrame:
    """A best global alignment of each pair in pieces: k (the pair's key), i0 and j0 (symbols of a and b before the piece), ops.

    key must differ between rows. Pairs that have a null are left out; those of two empty strings have no piece. Each round
    cuts every piece of more than `cells` cells at the middle of its a: two tasks score its halves towards the line between
    them, and where the sum is best the piece falls into two, of half as many cells together. A round's pieces and borders
    are Parquet tables in `folder`, which all executors must share; the driver sees their number only. A task holds a few
    rows of scores, or `cells` cells of a traceback: memory grows with the sum of the lengths, and all cells are worked out
    twice in all. The first round of one pair has two tasks, each further one twice as many. The score is that of
    pairwise.align_pairs(); which of equally good alignments is found may differ.
    """
    spark, cuts = df.sparkSession, 0
    none = F.lit(False)
    start = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("i0"), F.lit(0).cast("bigint").alias("j0"), F.col(a).alias("a"), F.col(b).alias("b"), none.alias("top"), none.alias("bottom"), F.lit(None).cast("string").alias("ops"))
    start.where((F.col("a") != "") | (F.col("b") != "")).write.parquet(f"{folder}/round=0")
    while True:
        large = spark.read.schema(PIECE).parquet(f"{folder}/round={cuts}").where(_large(cells))
        rows, symbols = _size(large)
        if not rows:
            break
        middle = F.floor(F.char_length("a") / 2).cast("int")
        sides = F.array(*(F.struct(F.lit(x).alias("lower"), part.alias("a")) for x, part in ((False, F.substr("a", F.lit(1), middle)), (True, F.substr("a", middle + 1)))))
        halves = large.withColumn("_s", F.explode(sides)).select(*KEY, "_s.a", "b", "top", "bottom", "_s.lower")
        _borders(_spread(halves, 2 * rows, 2 * symbols), scheme).write.parquet(f"{folder}/borders/round={cuts}")
        cuts += 1
        _cut(spark.read.parquet(f"{folder}/borders/round={cuts - 1}"), scheme).write.parquet(f"{folder}/round={cuts}")
    pieces = spark.read.schema(PIECE).parquet(*(f"{folder}/round={i}" for i in range(cuts + 1))).where(~_large(cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ops = [o or leaf(x, y, t, u, scheme) for x, y, t, u, o in zip(p.a, p.b, p.top, p.bottom, p.ops, strict=True)]
            yield pd.DataFrame({"k": p.k, "i0": p.i0, "j0": p.j0, "ops": ops})

    return _spread(pieces, *_size(pieces)).mapInPandas(run, "k bigint, i0 bigint, j0 bigint, ops string")


def align_long(df: DataFrame, key: str, folder: str, a: str = "a", b: str = "b", scheme: ScoringScheme = DEFAULT, cells: int = LEAF) -> DataFrame:
    """df with global_score and ops of a best alignment, put together from align_pieces(); null where a string is."""
    pieces = align_pieces(df, key, folder, a, b, scheme, cells)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("i0") + F.col("j0")).alias("at"), "ops"))), lambda p: p["ops"]), "")
    found = pieces.groupBy(F.col("k").alias("_k")).agg(whole.alias("_o"))
    out = df.join(found, df[key].cast("bigint") == F.col("_k"), "left")
    ops = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.coalesce("_o", F.lit("")))
    return out.withColumn("ops", ops).withColumn("global_score", rescored(F.col("ops"), scheme)).drop("_k", "_o")
