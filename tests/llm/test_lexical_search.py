import math
import random
import re
from collections import Counter

import pytest

from strandframe.llm import lexical_search
from strandframe.llm.lexical_search import TERM, build, pieces, search

SCHEMA = "doc_id long, text string, item_id string, score string, rank int, tier int"
ITEMS = "item_id long, text string, doc_id long, term string"


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r, i if has else None, -s) for r, (s, has, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    index = build(spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in docs], SCHEMA).repartition(3))
    return index, search(index, spark.createDataFrame([(i, t, 5, "z") for i, t in items], ITEMS), k)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "日本", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for i in range(600)]
    docs += [(700 + i, "Passage of Rare words, seldom-seen 42! " + docs[i][1]) for i in range(70)]
    docs += [(800, None), (801, ""), (802, " .,-! "), (None, "w0 w1 rare"), (803, "same w3"), (803, "same w3"), (803, "same w9"), (804, "W0 " * 30000 + "rare")]
    rng.shuffle(docs)
    items = [(1, "passage of rare words seldom seen 42"), (2, "w0 w1 w2 w3 w4 w5 w6"), (3, "w50 É w59"), (4, None), (5, "nothing-here"), (6, "w0"), (6, "W0, same"), (7, "日本 naïve a1 é"), (None, "rare rare")]
    return docs, items


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [50, 3])
def test_ranks_match_brute_force(spark, corpus, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 128)
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    docs, items = corpus
    df = run(spark, docs, items, k)[1]
    assert df.columns == ["item_id", "rank", "doc_id", "score", "tier"]
    single = [x for x in items if x[0] != 6]
    assert got(df.where("item_id is null or item_id <> 6")) == brute(docs, single, k)
    both = sorted(((6, r["rank"], r.doc_id, r.score) for r in df.where("item_id = 6").collect()), key=str)
    assert both == sorted(brute(docs, [(6, "w0")], k) + brute(docs, [(6, "W0, same")], k), key=str)


def test_items_fall_through_and_are_proven_early(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHORT", 2)
    monkeypatch.setattr(lexical_search, "LONG", 4)
    docs, items = corpus
    index, df = run(spark, docs, items, 3)
    assert got(df.where("item_id <> 6 or item_id is null")) == brute(docs, [x for x in items if x[0] != 6], 3)
    assert df.select("tier").distinct().count() > 1
    row = index.segments.first()
    assert len(row.s2) > 0 and len(row.s0) < len(row.s2)


def test_pieces_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = "Ab cdé-fghijklmnopqrstuvwxyz0123 x,, y " * 3 + "end" * 9
    assert [t.decode() for p in pieces(text.encode()) for t in p] == terms(text)


def test_a_very_long_term(spark):
    index, df = run(spark, [(1, "x" * 3_000_000 + " y"), (2, "y z"), (3, "q r s")], [(1, "x" * 3_000_000), (2, "y")])
    assert got(df) == brute([(1, "x" * 3_000_000 + " y"), (2, "y z"), (3, "q r s")], [(1, "x" * 3_000_000), (2, "y")])


def test_empty_tables(spark):
    assert run(spark, [(1, "a")], [])[1].count() == 0
    assert run(spark, [], [(1, "a")])[1].count() == 0
    assert run(spark, [(1, None)], [(1, "a")])[1].count() == 0
