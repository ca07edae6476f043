"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence has a logistic score over the words in it and the first letters of each, hashed to numbers, and a document is
toxic unless none of its sentences is: its probability is the noisy-or 1 - prod(1 - p). Weights and bias are trained together
from document labels, by gradient descent through the noisy-or, on a bounded sample; the sentences whose own score passes
the cut are the offending ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, expose, fold, forget, labelled_sample

#: Labelled documents that are learnt from, at most, of any length; every document is scored.
SAMPLE = 8_000
#: Words whose weight a worker remembers.
CACHE = 500_000
#: Numbers that features are hashed to: the size of the model.
BUCKETS = 1 << 20
#: A feature is learnt from if so many documents of the sample have it, and such a share of it.
LEAST, SHARE = 5, 0.002
#: Letters of the beginnings that are features.
STARTS = (4, 5, 6, 7)
CUT = 0.7
STEPS, RATE, L1 = 150, 0.3, 2e-4
#: Where the bias starts from: a sentence is innocent unless something speaks against it.
BIAS = -9.0
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """The numbers of the word and of its beginnings."""
    return [zlib.crc32(f.encode(errors="replace")) % BUCKETS for f in (word, *(f"{word[:k]}*" for k in STARTS if len(word) > k))]


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences of a text: runs without a full stop, exclamation or question mark or line feed."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def bags(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each sentence, one after the other, and how many each has. known keeps those of words."""
    ids: list[int] = []
    sizes: list[int] = []
    for m in _SENTENCE.finditer(text.lower()):
        own: set[int] = set()
        for w in set(_WORD.findall(m[0])):
            if (f := known.get(w)) is None:
                f = known[w] = features(w)
            own.update(f)
        ids += sorted(own)
        sizes.append(len(own))
    return np.array(ids, np.int32), np.array(sizes, np.int32)


def loss_gradient(w: np.ndarray, b: float, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted cross entropy of the documents, and its gradients by the weights and the bias.

    Feature word[i] is in sentence[i], and sentence s in document doc[s].
    """
    z = np.bincount(sentence, w[word], len(doc)) + b
    p = 1 / (1 + np.exp(-z))
    innocent = np.maximum(-np.bincount(doc, np.logaddexp(0, z), len(toxic)), -500)  # log probability that no sentence is toxic
    none = np.exp(innocent)
    some = np.maximum(-np.expm1(innocent), 1e-9)
    loss = -float(np.sum(weight * np.where(toxic, np.log(some), innocent)))
    g = p * (np.where(toxic, -none / some, 1.0) * weight)[doc]
    return loss, np.bincount(word, g[sentence], len(w)), float(g.sum())


def train(sets: list[tuple[np.ndarray, np.ndarray]], toxic: list[int]) -> tuple[dict[int, float], float]:
    """Weights of features and the bias, from the bags of each document. With one class or no documents only the bias is
    left, which calls nothing toxic."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return {}, BIAS
    flat = np.concatenate([i for i, _ in sets])
    sizes = np.concatenate([s for _, s in sets])
    doc = np.repeat(np.arange(len(sets)), [len(s) for _, s in sets])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(flat.astype(np.int64) * len(sets) + doc[sentence])
    found = np.bincount(pairs // len(sets), minlength=BUCKETS)
    names = np.flatnonzero(found >= max(LEAST, SHARE * len(sets)))
    number = np.full(BUCKETS, -1, np.int32)
    number[names] = np.arange(len(names))
    word = number[flat]
    sentence, word = sentence[word >= 0], word[word >= 0]
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    x, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    x[-1] = BIAS
    for step in range(1, STEPS + 1):
        _, gw, gb = loss_gradient(x[:-1], x[-1], word, sentence, doc, y, weight)
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        x -= scale * m / (1 - 0.9**step)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - scale[:-1] * L1, 0)
    return {int(names[i]): float(x[i]) for i in np.flatnonzero(x[:-1])}, float(x[-1])


class Weights(dict):
    """Words -> the sum of their features' weights, worked out when first met; CACHE words are kept."""

    def __init__(self, weights: dict[int, float]):
        self.of = weights.get

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = v = sum(self.of(f, 0.0) for f in features(word))
        return v


def score(text: str, weights: Weights, bias: float, cut: float = CUT) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability, and bounds and score of its offending sentences."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer: bounds would shift
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    none, bad, get = 0.0, [], weights.__getitem__
    rest = math.log1p(math.exp(bias))
    for m in _SENTENCE.finditer(low):
        z = sum(map(get, set(_WORD.findall(m[0]))))
        if not z:
            none += rest
            continue
        z += bias
        none += math.log1p(math.exp(z)) if z < 30 else z
        if (p := 1 / (1 + math.exp(-max(z, -500)))) >= cut:
            bad.append((*m.span(), p))
    return -math.expm1(-none), bad


def toxicity(docs: DataFrame, weights: dict[int, float], bias: float, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """For each row of docs its id, score, predicted (score >= cut), offending (array of start, end, score of sentences).

    Null and empty texts have no sentence and score 0. Repeated rows score alike, extra columns are not read, an empty
    table gives no rows. The model has BUCKETS numbers at most and is broadcast. Nothing is shuffled.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("offending", spans)]
    model = expose(docs.sparkSession).sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, b = Weights(model.value[0]), model.value[1]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            got = [score(t, own, b, cut) for t in batch.column("text").to_pylist()]
            bad = [[{"start": x, "end": y, "score": p} for x, y, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p for p, _ in got], pa.float64()), pa.array(bad, kind)], names=["id", "score", "offending"])

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, T.StructType(fields))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "offending")


def sample_bags(rows: DataFrame, text_col: str = "text") -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """The bags and labels of rows with a column _label: numbers of features go to the driver, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            known: dict[str, list[int]] = {}
            got = [bags(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1))], names=["label", "ids", "sizes"])

    expose(rows.sparkSession)
    found = rows.select(F.col("_label").cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "label int, ids binary, sizes binary").toArrow()
    got = sorted(zip(found["ids"].to_pylist(), found["sizes"].to_pylist(), found["label"].to_pylist(), strict=True))  # whatever order tasks end in
    return [(np.frombuffer(i, np.int32), np.frombuffer(s, np.int32)) for i, s, _ in got], [y for *_, y in got]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), expose(spark).read.parquet(f"{sf_dir}/labels.parquet")
    rows = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, SAMPLE)
    weights, bias = train(*sample_bags(rows))
    return toxicity(docs, weights, bias).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "offending")
