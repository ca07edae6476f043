import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm import token_counts
from strandframe.llm.token_counts import Counts, count_tokens, scan

from .test_tokens import foreign, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    rng = random.Random(1)
    alphabet = list(" \n'rstvelmd a1.%é|") + ["  ", "\n\n", "\t", "the", "ing"]
    out = texts() + foreign() + ["don't 're 'rx ''re 'l 'll 'lx 'v 've '", "a'b'c", "x'S", "\n\n\nabc\n \nd  e   f", "word " * 3000, "x" * 9000 + " y"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]


@pytest.mark.parametrize(("chunk", "cells"), [(256, 32_000_000), (7, 32_000_000), (64, 200_000)])
def test_counts_are_the_library_s(monkeypatch, chunk, cells):
    """Chunks that begin anywhere, also within words and characters, and a table that is compiled anew all the time."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "CELLS", cells)
    t = samples()
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(t, add_special_tokens=False)]
    counts = Counts(open(PATH).read())
    assert counts.run(["the cat sat", ""]) == [3, 0]
    assert [n for i in range(0, len(t), 700) for n in counts.run(t[i : i + 700])] == want
    assert counts.run([]) == [] and counts.run(["", ""]) == [0, 0]


def test_the_library_counts_nothing():
    """There is no way to the library: Latin, Cyrillic, Chinese and unknown characters are all read by the transducer."""
    counts = Counts(open(PATH).read())
    assert not any(isinstance(x, Tokenizer) for o in (counts, counts.transducer, counts.transducer.automaton, counts.kinds) for x in vars(o).values())
    t = ["Привет, мир! " * 50, "日本語のテキスト、漢字。" * 50, "the quick brown fox " * 50, "\U0001f600\u0378" * 20]
    assert counts.run(t) == [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(t, add_special_tokens=False)]


def test_scan_finds_what_enters_each_chunk():
    rng = np.random.default_rng(0)
    for n in (1, 2, 33, 1000):
        exits, constant = rng.integers(1, 99, n), rng.random(n) < 0.3
        constant[0] = True  # a text begins there
        rows, between = scan(exits, constant)
        row, gap, want = 0, 0, []
        for x, c in zip(exits, constant, strict=True):
            want.append((row, gap))
            row, gap = (x, 0) if c else (row, gap + 1)
        assert list(zip(rows, between, strict=True)) == want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = token_counts.query(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        n = len(t.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 512)


def test_frame(spark):
    rows = [(1, "héllo", 0), (1, "héllo", 0), (None, None, 0), (2, "", 0), (3, "a b c " * 400, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(tuple(r) for r in count_tokens(df.where("doc_id is not null"), PATH).collect())
    n = len(Tokenizer.from_file(PATH).encode("héllo", add_special_tokens=False).ids)
    assert out[:3] == [(1, 6, n, False)] * 2 + [(2, 0, 0, False)] and out[3][3]
    assert count_tokens(df.where("doc_id is null"), PATH).collect()[0][1:] == (0, 0, False)
    assert count_tokens(df.limit(0), PATH).count() == 0
