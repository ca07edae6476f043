import os
import random
from pathlib import Path

import pytest

from strandframe.functions.kernels import align, rescore, score_batch
from strandframe.scheme import DEFAULT, ScoringScheme

SCHEMES = [DEFAULT, ScoringScheme(0, -1, -1, 0), ScoringScheme(1, -1, -1, 0), ScoringScheme(2, -3, -2, -4), ScoringScheme(5, -1, -1, -1)]
#: Sequence files with documented results, in the folder SEQUENCE_EXAMPLES, are known by what they hold: a pair of 10,000 symbols, and five of 5,000.
FILES = sorted(Path(os.environ["SEQUENCE_EXAMPLES"]).glob("**/*.fa")) if "SEQUENCE_EXAMPLES" in os.environ else []


def cell_by_cell(a, b, s):
    """Score and largest interior cell by the recurrence, one cell at a time."""
    n, m, low, o, e = len(b), len(a), -(10**9), s.gap_open, s.gap_extend
    h = [[0] * (m + 1) for _ in range(n + 1)]
    down = [[low] * (m + 1) for _ in range(n + 2)]
    best = -100
    for j in range(1, m + 1):
        h[0][j] = o + j * e
        down[1][j] = h[0][j] + o + e
    for i in range(1, n + 1):
        h[i][0] = o + i * e
        side = h[i][0] + o + e
        for j in range(1, m + 1):
            h[i][j] = max(h[i - 1][j - 1] + (s.match if a[j - 1] == b[i - 1] else s.mismatch), down[i][j], side)
            best = max(best, h[i][j])
            down[i + 1][j] = max(down[i][j], h[i][j] + o) + e
            side = max(side, h[i][j] + o) + e
    return h[n][m], best


def pairs(seed, n=250):
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 13)))
    return [(word("ab"), word("abc")) for _ in range(n)] + [("", ""), ("a", ""), ("", "abc"), ("é日", "日é😀"), ("a-b", "-"), ("a", "b")]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_scores_and_walks(scheme):
    p = pairs(1)
    for (a, b), total, cell in zip(p, *map(list, score_batch(p, scheme)), strict=True):
        assert (total, cell) == cell_by_cell(a, b, scheme)
        t, c, swapped, x, y, ops = align(a, b, scheme)
        assert (t, c, swapped) == (total, cell, len(b) > len(a))
        assert rescore(ops, scheme) == total
        assert align(a, b, scheme, cells=0) == (t, c, swapped, x, y, ops)
        assert "".join(q for q, o in zip(x, ops, strict=True) if o != "I") == a
        assert "".join(q for q, o in zip(y, ops, strict=True) if o != "D") == b
    back, _ = score_batch([(b, a) for a, b in p], scheme)
    assert back.tolist() == score_batch(p, scheme)[0].tolist()


def test_scheme_is_validated():
    for bad in ({"match": 300}, {"gap_open": 1}, {"mismatch": 1.5}, {"gap_extend": True}):
        with pytest.raises(ValueError):
            ScoringScheme(**bad)
    assert ScoringScheme(0, -1, -1, 0).is_edit_distance and not DEFAULT.is_edit_distance


def examples(lengths):
    """The sequences of all files whose records have these lengths, in the order of the files' names."""
    found = [["".join(r.split("\n")[1:]) for r in p.read_text().split(">")[1:]] for p in FILES]
    return [s for own in found if list(map(len, own)) == lengths for s in own]


@pytest.mark.skipif(len(examples([10_000])) != 2, reason="no example files here")
def test_documented_pair():
    a, b = examples([10_000])
    assert [x.tolist() for x in score_batch([(a, b)])] == [[-10985], [-5]]
    assert [x.tolist() for x in score_batch([(a, b)], ScoringScheme(2, -3, -2, -4))] == [[-6854], [-3]]
    total, cell, _, x, y, ops = align(a, b)
    assert (total, cell, rescore(ops)) == (-10985, -5, -10985) and x.replace("-", "") == a and y.replace("-", "") == b
