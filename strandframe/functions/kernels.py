"""NumPy kernels for pairwise global alignment. Symbols are code points, scores 32-bit integers."""

from __future__ import annotations

import numpy as np

from ..scheme import CELL_FLOOR, DEFAULT, ScoringScheme

LOW = -(1 << 29)
#: Cells of a traceback that are kept whole; three bytes each.
CELLS = 1 << 27


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundary(m: int, scheme: ScoringScheme = DEFAULT) -> np.ndarray:
    """Scores of aligning 0 to m symbols with nothing."""
    row = scheme.gap_open + scheme.gap_extend * np.arange(m + 1, dtype=np.int32)
    row[0] = 0
    return row


def horizontal(g: np.ndarray, scheme: ScoringScheme) -> np.ndarray:
    """For rows g[..., 0..m] of scores without horizontal gaps: the best score that ends in one, at columns 1..m.

    A gap that opens from a gap never beats its extension, as opening isn't rewarded, so one running maximum will do.
    """
    k = scheme.gap_extend * np.arange(g.shape[-1], dtype=np.int32)
    best = np.maximum.accumulate(g[..., :-1] - k[:-1], axis=-1)
    return best + k[1:] + scheme.gap_open


def score_batch(pairs: list[tuple[str, str]], scheme: ScoringScheme = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Global score and largest interior cell (CELL_FLOOR at least) of each pair, all pairs of the batch row by row.

    The longer sequence lies along the columns. Pairs are in order of falling row count, so that the pairs that still
    have rows are a prefix; memory is a few rows for each pair.
    """
    n_pairs = len(pairs)
    if not n_pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in pairs), strict=True)
    order = sorted(range(n_pairs), key=lambda i: -len(b[i]))
    rows = np.array([len(b[i]) for i in order])
    cols = np.array([len(a[i]) for i in order])
    m, n = int(cols.max()), int(rows.max())
    top, side = np.zeros((n_pairs, m), np.uint32), np.zeros((n_pairs, n), np.uint32)
    for k, i in enumerate(order):
        top[k, : cols[k]], side[k, : rows[k]] = codes(a[i]), codes(b[i])
    inside = np.arange(1, m + 1) <= cols[:, None]
    h = np.repeat(boundary(m, scheme)[None, :], n_pairs, axis=0)
    e = h[:, 1:] + scheme.gap_open + scheme.gap_extend
    best = np.full(n_pairs, CELL_FLOOR, np.int64)
    for i in range(n):
        k = int(np.searchsorted(-rows, -i, side="left"))  # pairs with more than i rows
        s = np.where(top[:k] == side[:k, i, None], np.int32(scheme.match), np.int32(scheme.mismatch))
        g = np.empty((k, m + 1), np.int32)
        g[:, 0] = scheme.gap_open + (i + 1) * scheme.gap_extend
        np.maximum(h[:k, :-1] + s, e[:k], out=g[:, 1:])
        new = np.maximum(g[:, 1:], horizontal(g, scheme))
        h[:k, 0], h[:k, 1:] = g[:, 0], new
        e[:k] = np.maximum(e[:k] + scheme.gap_extend, new + scheme.gap_open + scheme.gap_extend)
        if m:
            best[:k] = np.maximum(best[:k], np.where(inside[:k], new, LOW).max(axis=1))
    out, cell = np.empty(n_pairs, np.int64), np.empty(n_pairs, np.int64)
    out[order], cell[order] = h[np.arange(n_pairs), cols], best
    return out, cell


def _row(x: np.ndarray, symbol: np.uint32, i: int, h: np.ndarray, e: np.ndarray, scheme: ScoringScheme) -> tuple[np.ndarray, ...]:
    """From the scores above a row (h) and the gaps that enter it (e): its scores, the gaps that leave it, and its planes."""
    o = scheme.gap_open
    d = h[:-1] + np.where(x == symbol, np.int32(scheme.match), np.int32(scheme.mismatch))
    g = np.empty(len(x) + 1, np.int32)
    g[0] = o + (i + 1) * scheme.gap_extend
    np.maximum(d, e, out=g[1:])
    f = horizontal(g, scheme)
    new = np.maximum(g[1:], f)
    way = np.where(new == d, 1, np.where(new == f, 0, 2)).astype(np.int8)
    row_gap, col_gap = np.sign(f - new - o).astype(np.int8), np.sign(e - new - o).astype(np.int8)
    return np.concatenate([g[:1], new]), np.maximum(e, new + o) + scheme.gap_extend, way, row_gap, col_gap


class Planes:
    """Score, largest cell, and for each cell the direction of its best score and how its gaps may go on.

    Directions: 1 diagonal, 0 along the row, 2 along the column, in this order of preference among equals. The two
    other planes compare, in each cell, extending a gap with opening one: 1 extending is better, 0 both are equal, -1.

    Up to CELLS cells everything is kept. Beyond, every so-manieth row of scores is kept and a block of planes is worked
    out again when the walk comes to it, two blocks at a time: memory grows with the longer length times the root of the
    shorter one, for twice the time, and the planes are the same.
    """

    def __init__(self, a: str, b: str, scheme: ScoringScheme = DEFAULT, cells: int = CELLS):
        self.x, self.y, self.scheme = codes(a), codes(b), scheme
        n, m = len(self.y), len(self.x)
        self.every = max(1, n if n * m <= cells else int(n**0.5))
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks: dict[int, list[tuple[np.ndarray, ...]]] = {}
        h = boundary(m, scheme)
        e = h[1:] + scheme.gap_open + scheme.gap_extend
        self.cell = CELL_FLOOR
        whole = []
        for i in range(n):
            if i % self.every == 0:
                self.kept.append((h, e))
            h, e, *own = _row(self.x, self.y[i], i, h, e, scheme)
            if self.every == n:
                whole.append(own)
            if m:
                self.cell = max(self.cell, int(h[1:].max()))
        self.total = int(h[m])
        if self.every == n:
            self.blocks[0] = whole

    def row(self, i: int) -> tuple[np.ndarray, ...]:
        """way, row_gap and col_gap of a row."""
        k = i // self.every
        if k not in self.blocks:
            self.blocks = {q: v for q, v in self.blocks.items() if q == k + 1}
            h, e = self.kept[k]
            out = []
            for j in range(k * self.every, min(len(self.y), (k + 1) * self.every)):
                h, e, *own = _row(self.x, self.y[j], j, h, e, self.scheme)
                out.append(own)
            self.blocks[k] = out
        return self.blocks[k][i - k * self.every]


def align(first: str, second: str, scheme: ScoringScheme = DEFAULT, cells: int = CELLS) -> tuple[int, int, bool, str, str, str]:
    """global_score, max_cell_score, swapped, gapped first, gapped second, ops (= X D I, from the first's point of view).

    swapped: the second is longer and lies along the columns. Among equally good alignments the walk back prefers the
    diagonal, then a gap along the row. It stays in a gap that could only be extended, and, where extending and opening
    are equal, if the gap one step further could have been opened.
    """
    swapped = len(second) > len(first)
    a, b = (second, first) if swapped else (first, second)
    p = Planes(a, b, scheme, cells)
    i, j, forced = len(b), len(a), -1
    top: list[str] = []
    side: list[str] = []
    ops: list[str] = []
    along, across = ("I", "D") if swapped else ("D", "I")
    while i and j:
        way, row_gap, _ = p.row(i - 1)
        move = forced if forced >= 0 else int(way[j - 1])
        forced = -1
        if move == 1:
            top.append(a[j - 1])
            side.append(b[i - 1])
            ops.append("=" if a[j - 1] == b[i - 1] else "X")
            i, j = i - 1, j - 1
        elif move == 0:
            top.append(a[j - 1])
            side.append("-")
            ops.append(along)
            if j > 1:
                s = row_gap[j - 2]  # of the cell to the left; the gap from column 0 is only ever opened
                if s > 0 or s == 0 and (j == 2 or row_gap[j - 3] <= 0):
                    forced = 0
            j -= 1
        else:
            top.append("-")
            side.append(b[i - 1])
            ops.append(across)
            if i > 1:
                s = p.row(i - 2)[2][j - 1]
                if s > 0 or s == 0 and (i == 2 or p.row(i - 3)[2][j - 1] <= 0):
                    forced = 2
            i -= 1
    top += [*a[:j][::-1], *"-" * i]
    side += [*"-" * j, *b[:i][::-1]]
    ops += [*along * j, *across * i]
    x, y = "".join(reversed(top)), "".join(reversed(side))
    return p.total, p.cell, swapped, *((y, x) if swapped else (x, y)), "".join(reversed(ops))


def rescore(ops: str, scheme: ScoringScheme = DEFAULT) -> int:
    """The score of an alignment from its operations."""
    total, before = 0, ""
    for op in ops:
        if op in "=X":
            total += scheme.match if op == "=" else scheme.mismatch
        else:
            total += scheme.gap_extend + (scheme.gap_open if op != before else 0)
        before = op
    return total
