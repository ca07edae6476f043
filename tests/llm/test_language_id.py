import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandframe.llm.language_id import UNKNOWN, WARM, WINDOW, Network, identify, learn, query, train

ALPHABETS = {"aa": "abcde ", "bb": "fghij ", "cc": "éüñklm "}


def text(rng, lang, n):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network.start(["a", "b", "c"], 3, hidden=3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, weight = rng.integers(0, 5, (4, 2)).astype(np.uint8), rng.normal(size=(4, 2, 3))
    value = lambda: float((net.forward(x)[0].astype(np.float64) * weight).sum())
    grads = net.backward(x, net.forward(x)[1], weight)
    for k, p in net.params.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape) if k != "tables" else (rng.integers(0, 2), rng.integers(0, 5), rng.integers(0, 9))
            old, eps = p[i], 1e-3
            p[i] = old + eps
            up = value()
            p[i] = old - eps
            down = value()
            p[i] = old
            assert abs((up - down) / (2 * eps) - grads[k][i]) < 2e-3 * max(1, abs(grads[k][i]))


def test_windows_read_in_step_equal_one_by_one():
    net = Network.start(["a", "b"], 1)
    rng = random.Random(1)
    texts = [text(rng, "aa", n) for n in (1, 5, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW + 7)] + [""]
    for t, p in zip(texts, net.probabilities(texts), strict=True):
        total, labels = np.zeros(2), []
        raw = np.frombuffer(t.encode(), np.uint8)
        for i in range(0, len(raw), WINDOW):
            # either direction enters the window in the state that the WARM bytes on its side have left
            a, own = max(0, i - WARM), min(WINDOW, len(raw) - i)
            stop = min(len(raw), i + own + WARM)
            forward, backward = sides(net, raw[a : i + own], raw[i:stop])
            e = np.exp(forward[i - a :] + backward[:own] + net.params["bias"])
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
            labels += [net.langs[k] for k in e.argmax(axis=1)]
        assert np.allclose(p, total / max(len(raw), 1) if t else [0.5, 0.5], atol=1e-4)
        assert net.positions(t) == labels


def sides(net, ahead, back):
    """What each direction alone adds to the logits, by the training network's forward()."""
    out = []
    for d, raw in enumerate((ahead, back)):
        alone = Network(net.langs, {**net.params, "readout": net.params["readout"].copy(), "bias": net.params["bias"] * 0})
        alone.params["readout"][1 - d] = 0
        out.append(alone.forward(raw[:, None])[0][:, 0])
    return out


def test_no_window_begins_within_a_character():
    for t in ("é" * 1000, "日本" * 700, "a" + "😀" * 400, "abc", ""):
        flat, doc, start, size, before, behind = Network.windows([t, "x" + t])
        assert flat.tobytes() == (t + "x" + t).encode() and size.sum() == len(flat)
        assert all((flat[s] & 0xC0) != 0x80 for s in start)
        assert (before <= WARM).all() and (behind <= WARM).all() and (before[1:] >= np.where(doc[1:] == doc[:-1], 1, 0)).all()


def test_query_learns_from_its_fold_and_tells_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = query(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and rows[r.doc_id].lang and len(rows[r.doc_id].text or "") > 20]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) > 0.97
    other = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")).otherwise(F.lit("zz")))
    net = learn(other, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert "zz" not in net.langs  # held-out labels aren't read


def test_learns_from_labelled_rows_only(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(1, 400)) + "x", lang, "s") for i in range(240) for lang in [sorted(ALPHABETS)[i % 3]]]
    edges = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 ½ _%\n", "bb", "s"), (None, text(rng, "bb", 300), None, "s"), (903, text(rng, "cc", 50_000), None, "s"), (0, rows[0][1], "aa", "s")]
    df = spark.createDataFrame(rows + edges, "doc_id long, text string, lang string, lang_pred string")
    net = learn(df, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False)))
    assert net.langs == sorted(ALPHABETS)
    out = identify(df, net).collect()
    assert len(out) == len(rows) + len(edges)
    by = {r.doc_id: r for r in out}
    assert np.mean([by[i].lang_pred == y for i, t, y, _ in rows if i % 4 == 0 and len(t) > 20]) > 0.97
    assert all((by[i].lang_pred, by[i].score) == (UNKNOWN, 0.0) for i in (900, 901, 902))
    assert by[None].lang_pred == "bb" and by[903].lang_pred == "cc" and 0.5 < by[903].score <= 1
    kept = identify(df, net, keep=True)
    assert kept.columns == [*df.columns, "_lang_pred", "_score"] and kept.count() == len(out)
    clash = df.withColumnRenamed("lang_pred", "_lang_pred").withColumn("__Score", F.lit(1))
    assert identify(clash, net, keep=True).columns == [*clash.columns, "___lang_pred", "___score"]
    assert identify(df.limit(0), net).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(df, learn(df, F.lit(True))).first().lang_pred == UNKNOWN
    assert train([b"abc"], ["aa"]).predict(["abc", None]) == (["aa", UNKNOWN], [1.0, 0.0])


def test_repeats_and_a_huge_text_shut_out_nothing(spark, tmp_path):
    rng = random.Random(7)
    langs = sorted(ALPHABETS)
    rows = [(i, text(rng, langs[i % 3], 200), langs[i % 3]) for i in range(90)]
    rows += [(1, rows[1][1], rows[1][2])] * 200 + [(500 + i, text(rng, langs[i], 300_000), langs[i]) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(df.where("doc_id < 500"), F.lit(True), most=60).langs == langs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    assert all(by[i].lang_pred == y for i, _, y in rows if i < 500) and all(by[500 + i].lang_pred == langs[i] for i in range(2))
