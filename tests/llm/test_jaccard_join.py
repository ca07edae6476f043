import random

import numpy as np
import pytest

from strandframe.llm.jaccard_join import HOT, keep_one_of_group, near_duplicates, refined, scan, spots
from strandframe.llm.shingle_trie import LinkTrie
from strandframe.llm.shingles import shingle_sets

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    comp = {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((rows[i][0] is None, rows[i][0] or 0), len(sets[i]), comp[i]) for i in range(len(rows))), len(groups)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 4)
    passage = " ".join(word() for _ in range(40))
    base = [" ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 30, 120, 400]))) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = word()
        text = rng.choice([" ", "\n", "  ", "\x0b "]).join(w)
        out.append(rng.choice([text, text, text.upper(), f"{text} {passage}"]))
    return out + ["", None, " \n", "É é", "é é", "\x1c"]


def test_sets_are_those_of_the_definition():
    t = corpus(3)
    own = shingle_sets(t)
    ref = [shingles(x) for x in t]
    assert [len(s) for s in own] == [len(s) for s in ref]
    for i in range(0, len(t), 3):
        for j in range(0, len(t), 5):
            assert len(np.intersect1d(own[i], own[j])) == len(ref[i] & ref[j])


@pytest.mark.parametrize("seed", range(6))
def test_trie_connects_what_all_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(120):
        base = np.arange(rng.integers(1, 60)) + 100 * rng.integers(0, 4)
        sets.append(np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.05, 0.15, 0.3]), rng.integers(1000, 1100, len(base)), base)).astype(np.uint64))
    sets = [s for s in {s.tobytes(): s for s in sets}.values()]
    trie = LinkTrie(sets)
    pairs = trie.links()
    plain = [set(s.tolist()) for s in sets]
    assert all(linked(plain[a], plain[b]) for a, b in pairs)
    for i in range(len(sets)):
        for j in range(i):
            if linked(plain[i], plain[j]):
                assert trie.find(i) == trie.find(j)


def test_known_components_are_not_linked_again():
    sets = [np.arange(20, dtype=np.uint64) + np.uint64(k) for k in (0, 1, 2, 100, 101)]
    assert LinkTrie(sets, known=[b"a", b"a", b"a", b"b", b"b"]).links() == []
    assert len(LinkTrie(sets, known=[b"a", b"a", b"c", b"b", b"b"]).links()) == 1


@pytest.mark.parametrize(("seed", "block", "most_sets"), [(1, 100_000, 300), (4, 60, 300), (2, 100_000, 3)])
def test_components_match_brute_force(spark, seed, block, most_sets):
    rows = [(i * 3 if i % 40 else None, t) for i, t in enumerate(corpus(seed))] + [(2000, "same words again here now ok"), (2000, "same words again here now ok")]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(6)
    out = near_duplicates(df, block=block, most_sets=most_sets).collect()
    want, n_groups = brute(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out if True) == want
    assert sum(r.kept for r in out) == n_groups
    kept = keep_one_of_group(df)
    assert kept.columns == df.columns and kept.count() == n_groups
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in out if r.kept)


def common_passages(seed, n=240):
    """Every text has one passage, of a fifth to nearly all of its shingles; some texts are near copies of others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        if i % 6 == 5:
            w = out[rng.randrange(len(out))].split()
            w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join([*(word() for _ in range(rng.choice([2, 9, 14, 40, 200]))), passage, *(word() for _ in range(rng.choice([0, 3, 30])))]))
    return out


@pytest.mark.parametrize(("block", "most_sets"), [(100_000, 300), (400, 4)])
def test_an_element_that_all_sets_have(spark, block, most_sets):
    rows = list(enumerate(common_passages(8)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_duplicates(df, block=block, most_sets=most_sets).collect()
    want, n_groups = brute(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out) == want
    assert 1 < n_groups < len(rows) and sum(r.kept for r in out) == n_groups
    _, hot = scan(df, "doc_id", "text")
    assert hot.where(f"n >= {HOT}").count() > 50  # the passage's elements are known as common


def test_common_passages_tie_nothing_in_a_refined_cluster(spark):
    texts = common_passages(9)
    sets = [s.tobytes() for s in shingle_sets(texts)]
    rows = spark.createDataFrame([(1, str(i).encode(), s) for i, s in enumerate(sets)] * 2, "cluster long, sig binary, shingles binary")
    got = {}
    for r in refined(rows).collect():
        got.setdefault(r.cluster, set()).add(int(r.sig))
    own = [shingles(t) for t in texts]
    together = {i: c for c, g in got.items() for i in g}
    for i in range(len(texts)):
        for j in range(i):
            if linked(own[i], own[j]) and own[i] != own[j]:
                assert together[i] == together[j]
    assert max(map(len, got.values())) < len(texts) // 2  # those of which nearly all is the passage


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    near = [*long[:110_000], *(f"v{k}" for k in range(10_000))]
    far = [*long[:70_000], *(f"u{k}" for k in range(50_000))]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 500_000), (5, "x" * 500_000 + " a")]
    out = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert out[4].n_shingles == 1 and out[1].n_shingles == len(shingles(rows[0][1]))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_packets_go_one_to_each_partition(spark, parts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(x),) for x in spots(parts)], "p int")
    assert sorted(r[0] for r in df.select(F.pmod(F.hash("p"), F.lit(parts))).collect()) == list(range(parts))
