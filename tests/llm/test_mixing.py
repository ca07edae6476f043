import random

import pytest

from strandframe.llm import common
from strandframe.llm.mixing import EPOCHS, mix, mixed_documents


def fill(sizes):
    """Share by weight, clamp, and share the excess again until nothing is above its limit."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > EPOCHS * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: float(EPOCHS * sizes[s]) for s in over}


def rows(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", "", None, "big", "tiny"]
    out = [(i if i % 50 else None, " ".join(["w"] * rng.choice([0, 1, 5, 300])), sources[i % 8] if i % 3 else "big", "x", 1) for i in range(600)]
    return [*out, (7000, None, "void", "x", 1), (7001, "a b", "tiny", "x", 1), (7001, "a b", "tiny", "x", 1)]


SCHEMA = "doc_id long, text string, source string, size string, copies int"


@pytest.mark.parametrize("limit", [20_000, 2])  # broadcast, and salted keys
def test_targets_and_taken(spark, monkeypatch, limit):
    monkeypatch.setattr(common.lookup_join, "__defaults__", ("left", limit))
    data = rows(1)
    out = mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len(data)
    sizes = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= EPOCHS * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5 + 1e-6
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 300
    again = mix(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    docs = mixed_documents(spark.createDataFrame(data, SCHEMA))
    assert docs.columns == ["doc_id", "text", "source", "size", "copies"]
    want_rows = sorted((r.doc_id or -1, r.source or "-") for r in out for _ in range(r.copies))
    assert sorted((r.doc_id or -1, r.source or "-") for r in docs.collect()) == want_rows
    pick = lambda x: sorted((r.doc_id or -1, r.size, r.taken) for r in x)
    assert pick(again) == pick(out)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == mixed_documents(empty).count() == 0
    (r,) = mix(spark.createDataFrame([(1, "a b c", "s", "", 0)], SCHEMA)).collect()
    assert (r.size, r.target, r.taken) == (3, 3.0, 3)
    (r,) = mix(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA)).collect()
    assert (r.size, r.target, r.taken) == (0, 0.0, 0)
