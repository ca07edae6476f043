"""The learnt scorers: held-out accuracy, and rows at the edges."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import quality_ranking, toxicity
from strandframe.llm.common import labelled_sample

EDGES = [(None, None, 5), (90001, "", 5), (90001, "", 5), (90002, " \n\t", 5), (90003, "...", 5), (90004, "a " * 20_000, 5)]
SCHEMA = "doc_id long, text string, score int"


def words(rng, n):
    return " ".join("".join(rng.choice("aeiouklmnst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        own = [words(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 12))]
        if bad := i % 5 == 0:
            k = rng.randrange(len(own))
            own[k] = f"{own[k]} {rng.choice(['grumbler', 'grumble', 'Grumbling', 'zot'])} x"
        out.append((i, ". ".join(own), int(bad)))
    return out


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(4)
    known = {}
    weights, bias = toxicity.train(*zip(*((toxicity.bags(t, known), y) for _, t, y in toxic_rows(rng, 800)), strict=True))
    assert bias != toxicity.BIAS  # it is trained, too
    held = toxic_rows(rng, 300)
    df = spark.createDataFrame([(i, t, 0) for i, t, _ in held] + EDGES, SCHEMA)
    out = toxicity.toxicity(df, weights, bias).collect()
    assert len(out) == 300 + len(EDGES)
    by = {r.doc_id: r for r in out}
    assert np.mean([by[i].predicted == y for i, _, y in held]) > 0.98
    for i, t, y in held:
        if y and by[i].predicted:
            assert any("grumbl" in t[s.start : s.end].lower() or "zot" in t[s.start : s.end] for s in by[i].offending)
    assert all(by[i].score < 0.1 for i in (90001, 90002, 90003, None))
    assert toxicity.toxicity(df.limit(0), weights, bias).count() == 0


def test_toxicity_without_both_classes():
    bag = toxicity.bags("a b", {})
    assert toxicity.train([], []) == toxicity.train([bag], [0]) == toxicity.train([bag] * 9, [1] * 9) == ({}, toxicity.BIAS)


def test_bags_and_scores_match_brute_force():
    rng = random.Random(5)
    weights = {i: rng.normalvariate(0, 3) for w in ("ab", "abcd", "abcde", "zot") for i in toxicity.features(w)}
    texts = ["", ". .", "Ab abcd! zot", "abcde zot\nab ab. x", "a" * 300 + "? ab"]
    texts += [" ".join(rng.choice(["ab", "ABCD", "abcde.", "zot\n", "q!"]) for _ in range(30)) for _ in range(20)]
    for t in texts:
        own = [set(re.findall(r"\w+", s)) for s in re.split(r"[.!?\n]+", t.lower()) if s]
        ids, sizes = toxicity.bags(t, {})
        assert [sorted({zlib.crc32(f.encode()) % toxicity.BUCKETS for w in s for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]}) for s in own] == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] or not len(sizes)
        z = [sum(weights.get(f, 0) for w in s for f in toxicity.features(w)) - 2 for s in own]
        want = 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
        got, bad = toxicity.score(t, toxicity.Weights(weights), -2.0)
        assert abs(got - want) < 1e-9 and len(bad) == sum(1 / (1 + math.exp(-x)) >= toxicity.CUT for x in z)


def test_noisy_or_gradient_matches_differences():
    rng = np.random.default_rng(1)
    word, sentence, doc = rng.integers(0, 6, 60), np.sort(rng.integers(0, 15, 60)), np.sort(rng.integers(0, 5, 15))
    toxic, weight, w, b = np.array([True, False, True, False, True]), rng.random(5), rng.normal(size=6), -0.7
    f = lambda w, b: toxicity.loss_gradient(w, b, word, sentence, doc, toxic, weight)
    _, gw, gb = f(w, b)
    eps = 1e-6
    for i in range(6):
        step = eps * (np.arange(6) == i)
        assert abs((f(w + step, b)[0] - f(w - step, b)[0]) / (2 * eps) - gw[i]) < 1e-5
    assert abs((f(w, b + eps)[0] - f(w, b - eps)[0]) / (2 * eps) - gb) < 1e-5


def test_toxicity_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    got = toxicity.query(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert all(0 <= s.start < s.end <= len(rows[r.doc_id]) for s in r.offending)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    a, b = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (a[:, None] > b).mean() > 0.8


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, "copy", 0)] * 500 + [(1, f"other {i}", 0) for i in range(500)] + [(i, "x" * 100, 0) for i in range(2, 60)] + [(None, "null", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h int")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    found = labelled_sample(df, labels, "quality", F.lit(True), 40)
    assert found.count() == 40 and found.columns == ["doc_id", "text", "_label"]  # an id's rows don't go beyond the bound
    few = {tuple(r) for r in labelled_sample(df.where("doc_id > 1"), labels, "quality", F.lit(True), 10).collect()}
    assert len(few) == 10 and few == {tuple(r) for r in labelled_sample(df.where("doc_id > 1").repartition(5), labels, "quality", F.lit(True), 10).collect()}
    far = spark.createDataFrame([(i, 1) for i in range(5000, 9000)] + [(7, 1)], "doc_id long, quality int")  # labels of documents that aren't there take no place
    assert [r.doc_id for r in labelled_sample(df, far, "quality", F.lit(True), 10).collect()] == [7]


@pytest.mark.parametrize("huge", range(4))
def test_a_huge_text_shuts_out_nothing(spark, huge):
    """Whichever row comes first by its hash may be very long: all others are still learnt from."""
    df = spark.createDataFrame([(i, "x" * (2_000_000 if i == huge else 10)) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    assert labelled_sample(df, labels, "quality", F.lit(True), 4).count() == 4


def _written(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_queries_learn_beside_a_huge_text_and_repeats(spark, tmp_path):
    """Through op3 and op9: one labelled text of 400,000 characters, and a thousand repeats of another row."""
    rng = random.Random(8)
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in toxic_rows(rng, 400)]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(400)]
    docs = [(i, t if i % 3 else "##%% " * 40, *rest) if i % 5 else (i, t, *rest) for i, t, *rest in docs]
    for first in (401, 402, 403):
        docs.append((first, words(rng, 70_000), "en", "s", 0))
        labels.append((first, 1, 0))
    docs += [(1, docs[1][1], "en", "s", 0)] * 1000
    folder = _written(spark, tmp_path, docs, labels)
    scored = {r.doc_id: r.score for r in quality_ranking.query(spark, folder).collect()}
    assert len(set(scored.values())) > 100
    assert np.mean([scored[i] for i in range(400) if i % 5 and i % 3]) > np.mean([scored[i] for i in range(400) if i % 5 and i % 3 == 0]) + 0.2
    found = {r.doc_id: r.predicted for r in toxicity.query(spark, folder).collect()}
    assert np.mean([found[i] for i in range(0, 400, 5)]) > 0.8 and not any(found[i] for i in range(400) if i % 5)


def test_ranking_gradient_matches_differences():
    rng = np.random.default_rng(2)
    z, w = rng.normal(size=(9, 5)), rng.normal(size=5)
    first, second = rng.integers(0, 9, 30), rng.integers(0, 9, 30)
    _, g = quality_ranking.loss_gradient(w, z, first, second)
    for i in range(5):
        step = 1e-6 * (np.arange(5) == i)
        up, down = (quality_ranking.loss_gradient(w + k * step, z, first, second)[0] for k in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5
    gap = [w @ (z[a] - z[b]) for a, b in zip(first, second, strict=True)]
    want = sum(math.log1p(math.exp(-x)) for x in gap) / 30 + quality_ranking.RIDGE / 2 * w @ w
    assert abs(quality_ranking.loss_gradient(w, z, first, second)[0] - want) < 1e-9


def test_ranking_features_match_brute_force():
    text = "Ab, ab 12 | longestwordhere.\nAb, ab 12 | longestwordhere.\n\nx é9"
    got = dict(zip(quality_ranking.NAMES, quality_ranking.features(text), strict=True))
    words = text.split()
    assert got["log_words"] == math.log1p(len(words)) and got["distinct"] == len(set(words)) / len(words)
    assert got["top_word"] == max(map(words.count, words)) / len(words)
    assert got["word_length"] == sum(map(len, words)) / len(words) and got["long_words"] == 2 / len(words)
    assert got["upper"] == 2 / len(text) and got["digits"] == 5 / len(text) and got["pipes"] == 2 / len(words)
    assert got["dup_lines"] == 1 - 2 / 3 and got["ends"] == 2 / 3 and got["letters"] == sum(map(str.isalpha, text)) / len(text)


def test_ranking_query(spark):
    folder = "/root/testdata/sf0.01"
    ids = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").collect()}
    got = quality_ranking.query(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    a, b = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (a[:, None] > b).mean() > 0.95


def test_bounds_hold_where_lower_case_is_longer():
    text = "İİİ. zot zot zot!"
    _, bad = toxicity.score(text, toxicity.Weights({toxicity.features("zot")[0]: 20.0}), -9.0)
    assert [text[a:b] for a, b, _ in bad] == [" zot zot zot"]


def test_ranking_separates_good_from_bad(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        t = words(rng, rng.randint(20, 90))
        if i % 6 == 0:
            t = rng.choice([t.replace(" ", " | "), t.replace(" ", "%% "), (t.split(" ")[0] + " ") * 60])
        rows.append((i, t, 0))
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(600)] + [(5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(rows + EDGES, SCHEMA)
    sample = labelled_sample(df, labels, "quality", F.col("doc_id") >= 0, 500)
    assert sample.count() == 500
    x, good = quality_ranking.sample_features(sample)
    model = quality_ranking.train(x, good)
    out = {r.doc_id: r for r in quality_ranking.rank_quality(df, model).collect()}
    held = range(600, 900)
    assert np.mean([out[i].predicted == (i % 6 != 0) for i in held]) > 0.95
    a, b = (np.array([out[i].score for i in held if (i % 6 == 0) == bad]) for bad in (False, True))
    assert (a[:, None] > b).mean() > 0.98
    assert out[90001].score == out[None].score and 0 <= out[90001].score <= 1
    assert quality_ranking.rank_quality(df.limit(0), model).count() == 0


def test_ranking_with_one_class_keeps_all():
    x = np.array([quality_ranking.features(t) for t in ("", "a b", "é%%| \n a")])
    for good in (np.array([True] * 3), np.array([False] * 3)):
        assert (quality_ranking.train(x, good).score(x) >= quality_ranking.CUT).all()
    assert (quality_ranking.train(np.empty((0, 20)), np.array([], bool)).score(x) >= quality_ranking.CUT).all()


def test_ranking_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    """More labelled rows than a sample of 12,000 had: the bad ones' mark counts though few have it, and all are in the sums."""
    rng = np.random.default_rng(3)
    n = 13_000
    x = rng.normal(size=(n, len(quality_ranking.NAMES)))
    label = (x[:, 0] + 0.3 * rng.normal(size=n) > -0.8).astype(int)
    rows = spark.createDataFrame([(i, bytearray(x[i].tobytes()), int(label[i])) for i in range(n)], "id long, x binary, label int")
    seen = []
    terms = quality_ranking.minimise
    monkeypatch.setattr(quality_ranking, "minimise", lambda f, k: (seen.append(f(np.zeros(k))), terms(f, k))[1])
    model = quality_ranking.fit(rows.unionByName(rows.limit(50)))
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    assert seen[0][0] > 0.9 * label.sum() * (1 - label).sum() / 13  # pairs of 13 blocks
    assert abs((model.score(x) < quality_ranking.CUT).mean() - (1 - label.mean())) < 1e-3  # the cut is a quantile of all
    assert (model.score(x[label == 1])[:2000, None] > model.score(x[label == 0])[:2000]).mean() > 0.97


def test_ranking_second_derivatives_match_differences():
    rng = np.random.default_rng(4)
    z, w, good = rng.normal(size=(12, 4)), rng.normal(size=4), np.arange(12) % 3 > 0
    _, _, _, h = quality_ranking.block_terms(w, z, good)
    for i in range(4):
        step = 1e-6 * (np.arange(4) == i)
        up, down = (quality_ranking.block_terms(w + k * step, z, good)[2] for k in (1, -1))
        assert np.abs((up - down) / 2e-6 - h[i]).max() < 1e-4
