"""The pipeline against a brute-force version of its stages."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandframe.llm.mixing import EPOCHS

from .test_exact_dedup import normal
from .test_jaccard_join import linked, shingles
from .test_mixing import fill

SYLLABLES = {"aa": ["ba", "do", "ki"], "bb": ["lu", "me", "sni"]}


def table(seed=9):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(150):
        lang = rng.choice(["aa", "bb"])
        text = " ".join(word(lang) for _ in range(rng.choice([6, 30, 90])))
        if i % 7 == 0 and rows:
            lang, text = rows[-1][2], rows[-1][1].upper()
        elif i % 5 == 0 and rows:
            lang, text = rows[-1][2], f"{rows[-1][1]} {word(rows[-1][2])}"
        rows.append((i, text, lang, rng.choice(["s1", "s2", None]), len(text)))
    return rows + [(900, None, None, "s1", 0), (901, "", "aa", "s1", 0), (902, "12 34", "aa", "s2", 5)]


def test_run_matches_brute_force(spark, tmp_path):
    data = table()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "word_codec":
            assert out.columns == docs.columns
            kept.append(rows)
            docs = spark.createDataFrame(rows, docs.schema)
    a, b, c, d = kept
    assert {r.doc_id for r in data_rows(data)} - {r.doc_id for r in a} == {900, 901, 902}

    last = {}
    for r in a:
        last[normal(r.text)] = max(r.doc_id, last.get(normal(r.text), -1))
    assert sorted(r.doc_id for r in b) == sorted(last.values())

    sets = {r.doc_id: shingles(r.text) for r in b}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for i in sets:
            for j in sets:
                if root[i] != root[j] and linked(sets[i], sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert sorted(r.doc_id for r in c) == sorted(set(root.values()))

    sizes = Counter()
    for r in c:
        sizes[r.source] += len(r.text.split())
    target, taken = fill(dict(sizes)), Counter()
    for r in d:
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in c)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    assert max(Counter(r.doc_id for r in d).values()) <= EPOCHS

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in d}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in d)
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(whole.select("doc_id").toPandas().doc_id) == Counter(r.doc_id for r in rows)


def data_rows(data):
    from pyspark.sql import Row

    return [Row(doc_id=r[0]) for r in data]
