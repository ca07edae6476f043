import random

import pytest

from strandframe.functions import banded
from strandframe.functions.kernels import score_batch
from strandframe.operators import pairwise
from strandframe.scheme import DEFAULT, ScoringScheme

from .test_halving import SCHEMES, mutated, pairs


@pytest.mark.parametrize("scheme", [*SCHEMES, ScoringScheme(-3, 4, -1, -2), ScoringScheme(-1, -7, 3, -2), ScoringScheme(2, -5, 1, 0)])
def test_scores_are_exact(scheme):
    """Also where gaps or different symbols are rewarded, and from bands of one diagonal on."""
    rng = random.Random(11)
    for a, b in [*pairs(rng, 150, 45), ("", ""), ("", "acg"), ("a", "")]:
        for first in (1, 8):
            assert banded.score(a, b, scheme, first)[0] == score_batch([(a, b)], scheme)[0][0]


def test_near_copies_need_few_cells():
    rng = random.Random(2)
    a = "".join(rng.choice("acgt") for _ in range(4000))
    b = a[:1500] + "ttt" + a[1510:2800] + "g" + a[2801:]
    total, cells = banded.score(a, b)
    assert total == score_batch([(a, b)])[0][0] and cells < len(a) * len(b) // 20
    other = mutated(rng, a)[:900]
    assert banded.score(a, other)[0] == score_batch([(a, other)])[0][0]


def test_frame(spark):
    df = spark.createDataFrame([(1, "acgt", "agt", 0), (2, None, "a", 0), (3, "", "", 0), (4, "é日", "é", 0)], "id long, a string, b string, cells int")
    got = {r.id: r.global_score for r in pairwise.score_pairs(df, method="banded", scheme=DEFAULT).collect()}
    assert got == {1: score_batch([("acgt", "agt")])[0][0], 2: None, 3: 0, 4: 2 - 6}
