"""Quality scores by Bradley-Terry pairwise ranking.

A document is a vector of text statistics x, and a good document is preferred to a bad one with probability
sigmoid(w * (x_good - x_bad)). All labelled documents are learnt from: they are dealt into blocks by a hash, and in a block
each good one is preferred to each bad one. w minimises the mean logistic loss of all these pairs by Newton's steps, whose terms
tasks add up, and w * x ranks any document. The cut is a quantile of all labelled documents' scores: the share of bad ones
among them. Scores are moved and squashed so that the cut lies at CUT.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, expose, fold, forget, stored

#: Documents of a block, or so; and where scores are cut.
BLOCK, CUT = 1000, 0.3
#: Passes over the blocks at most, and the share of the loss below which a step ends them.
STEPS, ENOUGH, RIDGE = 30, 1e-4, 1e-4
#: Bins of a histogram of scores, and how often the bin with the quantile is cut into as many again.
BINS, ZOOMS = 4096, 3
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")
NAMES = ("log_words", "word_length", "long_words", "distinct", "top_word", "letters", "upper", "digits", "marks", "pipes", "stops", "dup_lines", "line_words", "packed", "plain_words", "ends", "repeat_next", "commas", "distinct_long", "word_spread")


def features(text: str) -> list[float]:
    """The statistics of a text, NAMES; those of an empty text are 0."""
    words = [w for w in _SPACES.split(text) if w]
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(text)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _LETTERS.findall(text)))
    raw = text.encode(errors="replace")
    marks = size - letters - sum(map(text.count, " \n.,"))
    upper = sum(map(str.isupper, text))
    return [
        math.log1p(n),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        len(counts) / n,
        max(counts.values()) / n,
        letters / size,
        upper / size,
        sum(map(text.count, "0123456789")) / size,
        marks / size,
        text.count("|") / n,
        text.count(".") / n,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        len(zlib.compress(raw, 1)) / (len(raw) + 20),
        sum(map(str.isalpha, words)) / n,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        sum(map(str.__eq__, words, words[1:])) / n,
        text.count(",") / n,
        len(counts) / math.sqrt(n),
        float(lengths.std()),
    ]


class Ranking:
    """Scores from features; plain numbers, so that it goes along with a function."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    @staticmethod
    def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        i, j = np.triu_indices(z.shape[1])
        return np.concatenate([z, z[:, i] * z[:, j] / 6], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) * self.slope + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss_gradient(w: np.ndarray, z: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean logistic loss of preferring row first[i] of z to row second[i], with a ridge, and its gradient."""
    s = z @ w
    gap = s[first] - s[second]
    p = 1 / (1 + np.exp(gap))  # of the pair's wrong order
    pull = np.bincount(first, p, len(z)) - np.bincount(second, p, len(z))
    return float(np.logaddexp(0, -gap).mean() + RIDGE / 2 * w @ w), -(pull @ z) / len(first) + RIDGE * w


Terms = tuple[int, float, np.ndarray, np.ndarray]


def block_terms(w: np.ndarray, z: np.ndarray, good: np.ndarray) -> Terms | None:
    """Pairs of a block's good and bad rows, and sums over them of loss, gradient and second derivatives, without the ridge."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return None
    n = len(a) * len(b)
    loss, g = loss_gradient(w, z, np.repeat(a, len(b)), np.tile(b, len(a)))
    s = z @ w
    q = 1 / (1 + np.exp(np.clip(s[a][:, None] - s[b], -500, 500)))
    q *= 1 - q
    x, y = z[a], z[b]
    cross = x.T @ (q @ y)
    h = (x * q.sum(axis=1)[:, None]).T @ x + (y * q.sum(axis=0)[:, None]).T @ y - cross - cross.T
    return n, (loss - RIDGE / 2 * float(w @ w)) * n, (g - RIDGE * w) * n, h


def minimise(terms: Callable[[np.ndarray], Terms | None], k: int) -> np.ndarray | None:
    """The k weights of least loss, by Newton's steps that are halved where the loss would rise; None without a pair."""
    w, step, least = np.zeros(k), np.zeros(k), math.inf
    for _ in range(STEPS):
        found = terms(w + step)
        if found is None:
            return None
        n, loss, g, h = found
        new = w + step
        loss, g, h = loss / n + RIDGE / 2 * float(new @ new), g / n + RIDGE * new, h / n + RIDGE * np.eye(k)
        if loss > least:
            step = step / 2
            continue
        done = least - loss < ENOUGH * loss
        w, least, step = new, loss, -np.linalg.solve(h, g)
        if done:
            break
    return w


def _constant() -> Ranking:
    """All documents score above the cut."""
    k = len(NAMES)
    return Ranking(np.zeros(k), np.ones(k), np.zeros(k + k * (k + 1) // 2), -1.0, 1.0)


def train(x: np.ndarray, good: np.ndarray) -> Ranking:
    """Fit on rows at hand, as fit() does on a table; with one class only, or no rows, all documents score above the cut."""
    x = np.asarray(x, np.float64).reshape(-1, len(NAMES))
    if good.all() or not good.any():
        return _constant()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = Ranking.expand(x, mean, scale)
    blocks = max(1, -(-len(x) // BLOCK))
    w = minimise(lambda w: _added(block_terms(w, z[i::blocks], good[i::blocks]) for i in range(blocks)), z.shape[1])
    if w is None:
        return _constant()
    s = z @ w
    cut = float(np.quantile(s, 1 - good.mean()))
    return Ranking(mean, scale, w, cut, 2 / (float(np.median(np.abs(s - cut))) or 1.0))


def _added(terms: Iterable[Terms | None]) -> Terms | None:
    total: list | None = None
    for t in terms:
        if t is not None:
            total = list(t) if total is None else [a + b for a, b in zip(total, t, strict=True)]
    return None if total is None else tuple(total)


def _rows_of(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, good in zip(block.column("x").to_pylist(), block.column("good").to_pylist(), strict=True):
        yield np.frombuffer(x, np.float64).reshape(-1, len(NAMES)), np.frombuffer(good, np.bool_)


def _sums(blocks: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray | None]) -> np.ndarray:
    """Sums over all blocks of the numbers that a block gives; tasks send theirs by place, and places are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = None
        for batch in batches:
            for x, good in _rows_of(batch):
                if (own := of(x, good)) is not None:
                    total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    found = blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found["i"].to_numpy()] = found["v"].to_numpy()
    return out


def _quantile(values: DataFrame, share: float, n: int) -> float:
    """The value v below which share of all n rows lie, to a millionth of a millionth of their range or so: histograms, each of the bin with it in the one before."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    left = min(n - 1, int(share * n))
    for _ in range(ZOOMS):
        width = (high - low) / BINS
        if not width > 0:
            break
        own = values.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("b")).count()
        for b, c in sorted(map(tuple, own.collect())):
            if left < c:
                break
            left -= c
        low, high = low + b * width, low + (b + 1) * width
    return float(low)


def fit(rows: DataFrame) -> Ranking:
    """The ranking learnt from all rows of id, x (the features' bytes) and label; rows that repeat id and x count once.

    They are shuffled twice, 170 bytes each. What goes to the driver has the size of the model squared, whatever the table."""
    spark = rows.sparkSession
    rows = stored(rows.dropDuplicates(["id", "x"]))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("label") != 1), F.lit(0))).first()
    if not 0 < bad < n:
        return _constant()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(own: pa.Table) -> pa.Table:
        x, good = own["x"].to_pylist(), own["label"].to_numpy() == 1
        order = sorted(range(len(x)), key=x.__getitem__)  # sums do not hang on the order of rows
        return pa.table({"x": pa.array([b"".join(x[i] for i in order)], pa.binary()), "good": pa.array([good[order].tobytes()], pa.binary())})

    dealt = rows.select("x", "label", F.pmod(F.xxhash64("id", "x"), F.lit(-(-n // BLOCK))).alias("_b"))
    blocks = stored(dealt.repartition(parts, "_b").groupBy("_b").applyInArrow(packed, "x binary, good binary"))
    mean = _sums(blocks, lambda x, good: x.sum(axis=0)) / n
    scale = np.sqrt(_sums(blocks, lambda x, good: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-6
    k = len(NAMES) + len(NAMES) * (len(NAMES) + 1) // 2
    upper = np.triu_indices(k)

    def terms(w: np.ndarray) -> Terms | None:
        def of(x: np.ndarray, good: np.ndarray) -> np.ndarray | None:
            t = block_terms(w, Ranking.expand(x, mean, scale), good)
            return None if t is None else np.concatenate([[t[0], t[1]], t[2], t[3][upper]])

        v = _sums(blocks, of)
        if not len(v):
            return None
        h = np.zeros((k, k))
        h[upper] = v[2 + k :]
        return int(v[0]), float(v[1]), v[2 : 2 + k], h + np.triu(h, 1).T

    w = minimise(terms, k)
    if w is None:
        return _constant()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _ in _rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(Ranking.expand(x, mean, scale) @ w)], names=["v"])

    values = stored(blocks.mapInArrow(scores, "v double"))
    cut = _quantile(values, bad / n, n)
    spread = _quantile(values.select(F.abs(F.col("v") - cut).alias("v")), 0.5, n) or 1.0
    return Ranking(mean, scale, w, cut, 2 / spread)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    forget()
    for batch in batches:
        yield batch, np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(NAMES))


def sample_features(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a small table with a column _label, for train(); they, not the texts, go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _feature_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    expose(docs.sparkSession)
    rows = docs.select(F.col("_label").cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)  # the model does not hang on the order in which tasks end
    return x[order], rows["label"].to_numpy()[order] == 1


def rank_quality(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its id, score (0 to 1, higher: better) and predicted (score >= CUT).

    Null texts count as empty, and all empty texts score alike. Repeated rows score alike, extra columns are not read,
    an empty table gives no rows. Nothing is shuffled.
    """
    return scored(with_features(docs, id_col, text_col), model).withColumnRenamed("id", id_col)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the bytes of its features, of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _feature_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    expose(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def scored(features_of: DataFrame, model: Ranking) -> DataFrame:
    """id, score and predicted of rows of with_features()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x), pa.float64())], names=["id", "score"])

    out = features_of.mapInArrow(run, T.StructType([features_of.schema["id"], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), expose(spark).read.parquet(f"{sf_dir}/labels.parquet")
    found = stored(with_features(docs))  # read from texts once, for the ranking and for the scores
    ids = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("label"))
    model = fit(found.join(ids, "id"))
    return scored(found, model).select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted")
