import hashlib
import random

from strandframe.llm.exact_dedup import exact_dedup, keep_one_copy

SCHEMA = "doc_id long, text string, again int, bits string, sha string"


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "A", "a", "É", "é", "ÉA", "Éa", "x" * 70 + "A", "x" * 70 + "a", "x" * 70 + "b", "long " * 9000]
    rows = [(i if i % 17 else None, rng.choice(texts), 1, "b", None) for i in range(200)]
    rows += [(500, "same", 1, "", ""), (500, "same", 1, "", ""), (501, "other", 0, "", "")]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), digest=True).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    seen = {}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        seen[r.text_sha256] = seen.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(seen.values()) == {1} and len(seen) == len(by_hash)

    kept = keep_one_copy(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "again", "bits", "sha"]
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and keep_one_copy(empty).count() == 0
