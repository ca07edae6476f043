import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm import token_files, word_codec
from strandframe.llm.bpe import FINAL, ByteCodec, PrefixBpe, WordCodec
from strandframe.llm.words import WordTable

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "'", "'s", "'re", "'R", "’", "a", "the", "THE", "é", "é", "ß", "İ", "Σ", "ς", "ΑΣ", "1", "23", "½", "²", "%", "|", "...", "日本", "𝒳", "😀", "՘", "<|endoftext|>", "<|startoftext|>", "<|", "\x00", "ing", "tion"]
    out = ["", " ", "  ", "\n", "a ", " a", "a  b", "a \nb", "a\n b", "\n \n x", "x" * 3000, "ab" * 2000, "w " * 20000]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def foreign():
    """Texts of scripts beyond Latin, and of characters that Python's Unicode may not know."""
    rng = random.Random(8)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    out = ["".join(chr(rng.choice(points)) for _ in range(25)) for _ in range(300)]
    out += [" ".join("".join(chr(rng.randrange(low, low + 90)) for _ in range(rng.randint(1, 7))) for _ in range(12)) for low in (0x370, 0x400, 0x5D0, 0x620, 0x905, 0xE01, 0x3041, 0x4E00, 0xAC00, 0x1F600) for _ in range(20)]
    return [*out, "ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "日本語" * 700, "e\u0301" * 50 + "\u1c89\ua7cb"]


@pytest.mark.parametrize("bits", [9, 16])
def test_codecs_give_what_the_library_gives(bits):
    """The small table is emptied again and again, and batches have more new words than it may hold."""
    w, b = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    own, other = WordCodec(open(WORDS).read(), bits), ByteCodec(open(BYTES).read(), bits)
    t = texts() + foreign()
    for k in range(0, len(t), 400):
        part = t[k : k + 400]
        ids, at, decoded = own.run(part)
        for i, (x, e) in enumerate(zip(part, w.encode_batch(part, add_special_tokens=False), strict=True)):
            assert e.ids == ids[at[i] : at[i + 1]].tolist(), x
            assert w.decode(e.ids, skip_special_tokens=False) == decoded[i].as_py(), x
        ids, at = other.encode(part)
        for i, (x, e) in enumerate(zip(part, b.encode_batch(part, add_special_tokens=False), strict=True)):
            assert e.ids == ids[at[i] : at[i + 1]].tolist(), x
    assert len(own.run([])[0]) == len(other.encode([])[0]) == 0


def test_the_trie_encodes_without_the_library():
    """Whatever the script, the library only normalises and tells the kinds of characters; it encodes nothing."""
    codec = WordCodec(open(WORDS).read())
    t = foreign()
    want = Tokenizer.from_file(WORDS).encode_batch(t, add_special_tokens=False)

    class Only:
        normalizer = codec.library.normalizer

    codec.library = Only()
    ids, at, _ = codec.run(t)
    assert [e.ids for e in want] == [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_word_table_keeps_all():
    rng = np.random.default_rng(4)
    table = WordTable(np.dtype("<u2"), 8)
    raw = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3990, 900)
    ends = starts + rng.integers(0, 10, 900)
    for _ in range(3):
        ids, sizes = table.ids(raw, starts, ends, lambda a, b: [raw[x:y].tolist() for x, y in zip(a, b, strict=True)])
        assert ids.tolist() == [c for x, y in zip(starts, ends, strict=True) for c in raw[x:y].tolist()] and sizes.tolist() == (ends - starts).tolist()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_prefix_states_give_the_merges(path):
    rng = random.Random(2)
    words = {"".join(rng.choice("aabeinstz\xe9'") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)} | {b"a" * n for n in range(1, 40)}
    bpe = PrefixBpe(open(path).read())
    a = bpe.automaton
    for w, ids in bpe.encode_words(words).items():
        symbols = [*w[:-1], w[-1] + FINAL * a.end]
        assert a.merge([a.one[s] for s in symbols]) == ids


def test_encode_decode_frame(spark):
    rows = [(1, "Hello it's", 3, 4), (1, "Hello it's", 3, 4), (None, None, 0, 0), (2, "", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, id int")
    t = Tokenizer.from_file(WORDS)
    out = word_codec.encode_decode(df, WORDS, outputs="values").collect()
    assert len(out) == 4
    for r in out:
        ids = t.encode("Hello it's", add_special_tokens=False).ids if r.doc_id == 1 else []
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    r = word_codec.encode_decode(df.where("doc_id = 2"), WORDS).first()
    assert r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert word_codec.encode_decode(df.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("block", [1, 7, 128, 256])
def test_blocks_round_trip(block):
    rng = np.random.default_rng(block)
    for high in (1, 2, 300, 50_257, 2**32 - 1):
        for n in (0, 1, block - 1, block, 3 * block + 1):
            x = rng.integers(0, high, n, dtype=np.uint32)
            if n > 2:
                x[n // 2] = 2**32 - 1
            f = token_files.TokenFile(token_files.write_file([5, None], [x[: n // 3], x[n // 3 :]], block))
            assert [(d, y.tolist()) for d, _, y in f.documents()] == [(5, x[: n // 3].tolist()), (None, x[n // 3 :].tolist())]
            assert f.range(n // 2, n // 2 + 5).tolist() == x[n // 2 : n // 2 + 5].tolist()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 64)


def test_query_of_the_word_codec(spark):
    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(WORDS)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = word_codec.query(spark, folder).collect()
    assert {r.doc_id for r in got} == set(rows)
    for r in got:
        ids = t.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_of_the_token_files(spark):
    folder = "/root/testdata/sf0.001"
    t, at = Tokenizer.from_file(BYTES), 0
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    for r, own in zip(rows, token_files.query(spark, folder).orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (own.doc_id, own.start, own.n_tokens, own.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)


def test_files_are_in_order_and_hold_the_ids(spark, tmp_path):
    t = [x for x in texts() if "\x00" not in x]
    rows = [(i * 7 % 1009, x, 1, "p") for i, x in enumerate(t)] + [(None, "null id", 0, ""), (3000, None, 0, ""), (3001, "twice", 0, ""), (3001, "twice", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, part string").repartition(7)
    files = token_files.write_tokens(df, BYTES, file_ids=2000)
    out = token_files.read_tokens(files, values=True).orderBy("start").collect()
    lib, at = Tokenizer.from_file(BYTES), 0
    want = sorted(((r[0] is not None, r[0] or 0), [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in out] == [k for k, _ in want]  # in order of id, nulls first
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in out) == want
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(array("I", r.ids).tobytes()))
        at += len(r.ids)
    names = token_files.export(files, str(tmp_path)).collect()
    found = [d for p in sorted(tmp_path.iterdir()) for d, _, _ in token_files.TokenFile(p.read_bytes()).documents()]
    assert len(names) == len(list(tmp_path.iterdir())) and found == [r.doc_id for r in out]
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), BYTES)).count() == 0
