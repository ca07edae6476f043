import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions.kernels import align, rescore, score_batch
from strandframe.operators.halving import align_long, align_pieces, border, crossing, leaf
from strandframe.scheme import DEFAULT, ScoringScheme

SCHEMES = [DEFAULT, ScoringScheme(2, -5, -2, 0), ScoringScheme(0, -1, -1, 0), ScoringScheme(1, -1, -1, -10), ScoringScheme(5, -4, 0, -8), ScoringScheme(3, -2, -3, -1)]


def mutated(rng, s):
    out = []
    for c in s:
        x = rng.random()
        out.append(c if x < 0.8 else rng.choice("acgt") if x < 0.88 else "" if x < 0.94 else c + rng.choice("acgt") * rng.randint(1, 9))
    return "".join(out)


def pairs(rng, n, size):
    out = []
    for _ in range(n):
        a = "".join(rng.choice("acgt") for _ in range(rng.randint(0, size)))
        b = mutated(rng, a) if rng.random() < 0.7 else "".join(rng.choice("ac") for _ in range(rng.randint(0, size)))
        k = rng.randint(0, len(b))
        out.append((a, b[:k] + b[min(len(b), k + size // 3) :] if rng.random() < 0.4 else b))
    return out


def halved(a, b, top, bottom, scheme):
    """The cuts without tables, down to pieces of one row."""
    n = len(a) // 2
    if not n or not b:
        return leaf(a, b, top, bottom, scheme)
    j, gap = crossing(border(a[:n], b, top, scheme), border(a[n:][::-1], b[::-1], bottom, scheme), scheme)
    g = int(gap)
    return halved(a[: n - g], b[:j], top, gap, scheme) + "DD" * g + halved(a[n + g :], b[j:], gap, bottom, scheme)


@pytest.mark.parametrize("scheme", SCHEMES)
def test_cuts_leave_a_best_alignment(scheme):
    for a, b in pairs(random.Random(3), 150, 40):
        want = score_batch([(a, b)], scheme)[0][0]
        for ops in (leaf(a, b, False, False, scheme), halved(a, b, False, False, scheme)):
            assert len(a) == sum(o in "=XD" for o in ops) and len(b) == sum(o in "=XI" for o in ops)
            assert rescore(ops, scheme) == want


@pytest.mark.parametrize("scheme", SCHEMES[2:4])
def test_tables(spark, tmp_path, scheme):
    rows = [(i, a, b, "x") for i, (a, b) in enumerate(pairs(random.Random(5), 12, 150))]
    df = spark.createDataFrame([*rows, (90, "", "", "x"), (91, None, "a", "x"), (92, "a", None, "x"), (93, "é日a", "é日日a", None)], "id long, a string, b string, i0 string")
    got = {r.id: r for r in align_long(df, "id", str(tmp_path), scheme=scheme, cells=200).collect()}
    assert len(got) == 16 and got[91].ops is None and got[92].global_score is None and (got[90].ops, got[90].global_score) == ("", 0)
    for i, a, b, x in rows:
        r = got[i]
        assert r.i0 == x and r.global_score == rescore(r.ops, scheme) == align(a, b, scheme)[0]
        x, y = iter(a), iter(b)
        assert all((next(x) == next(y)) == (o == "=") if o in "=X" else next(x if o == "D" else y) for o in r.ops)
        assert next(x, None) is None and next(y, None) is None


def test_pieces_follow_each_other(spark, tmp_path):
    """One long pair falls into many pieces, each beginning where the one before it ends, none above the limit."""
    rng = random.Random(7)
    a = "".join(rng.choice("acgt") for _ in range(3000))
    b = mutated(rng, a)[:1200] + mutated(rng, a)[1900:]
    df = spark.createDataFrame([(1, a, b)], "id long, a string, b string")
    pieces = align_pieces(df, "id", str(tmp_path), cells=50_000).orderBy(F.col("i0") + F.col("j0")).collect()
    i = j = 0
    for p in pieces:
        assert (p.i0, p.j0) == (i, j)
        n, m = sum(o != "I" for o in p.ops), sum(o != "D" for o in p.ops)
        assert n * m <= 50_000
        i, j = i + n, j + m
    assert (i, j) == (len(a), len(b)) and len(pieces) > 10
    assert rescore("".join(p.ops for p in pieces)) == score_batch([(a, b)])[0][0]


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id long, a string, b string")
    assert align_long(df, "id", str(tmp_path)).collect() == []
