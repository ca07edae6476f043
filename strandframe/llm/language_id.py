"""Language identification by a bidirectional gated recurrent network over bytes.

Each byte's input to the gates is a row of a table, one for either direction. Texts are cut into windows of WINDOW bytes or
a few less, so that no character is cut; in each window one unit reads forwards and one backwards, and both states give every
position a distribution over the languages. A unit reads the WARM bytes before its window first, or behind it where it
reads backwards, so that it enters the window in the state that the text around has left. A document's probabilities are
the mean over all its positions. The network is trained in numpy by backpropagation through time on places drawn from the
whole texts of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, documents, expose, fold, forget, groups, stored

#: Labelled documents that are learnt from, at most; their texts may have any length.
SAMPLE = 4_000
#: Bytes of a window, bytes that are read before it, units of a direction, windows that are read in step.
WINDOW, WARM, HIDDEN, LANES = 512, 32, 8, 2048
STEPS, BATCH, LENGTH, RATE, SEED = 500, 192, 64, 0.02, 5
#: Places that are drawn from each document of the sample.
PLACES = 48
UNKNOWN = "und"
#: Stands for a byte that isn't there.
NOTHING = 256
_LETTER = regex.compile(r"\p{L}").search


class Network:
    """tables (2, 256, 3H), loops (2, H, 3H), readout (2, H, C), bias (C). Gates are update, reset, candidate; the sigmoids
    of the first two are tanh of half their input, which the parameters have in them."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.params = langs, params

    @staticmethod
    def start(langs: list[str], seed: int = SEED, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return Network(langs, {"tables": draw(2, 256, 3 * hidden), "loops": draw(2, hidden, 3 * hidden), "readout": draw(2, hidden, len(langs)), "bias": np.zeros(len(langs), np.float32)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits (T, N, C) of bytes (T, N), and what backward() needs."""
        p, (steps, n) = self.params, x.shape
        h_size = p["loops"].shape[1]
        logits, kept = np.zeros((steps, n, len(self.langs)), np.float32) + p["bias"], []
        for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            h, past = np.zeros((n, h_size), np.float32), []
            for t in order:
                a, g = p["tables"][d][x[t]], h @ p["loops"][d]
                zr = np.tanh(a[:, : 2 * h_size] + g[:, : 2 * h_size]) * 0.5 + 0.5
                z, r = zr[:, :h_size], zr[:, h_size:]
                c = np.tanh(a[:, 2 * h_size :] + r * g[:, 2 * h_size :])
                new = c + z * (h - c)
                past.append((t, h, z, r, c, g[:, 2 * h_size :], new))
                logits[t] += new @ p["readout"][d]
                h = new
            kept.append(past)
        return logits, kept

    def backward(self, x: np.ndarray, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the logits."""
        p = self.params
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["bias"] = grad.sum(axis=(0, 1))
        for d in range(2):
            after = np.zeros_like(kept[d][0][1])
            for t, h, z, r, c, gc, new in reversed(kept[d]):
                out["readout"][d] += new.T @ grad[t]
                dh = grad[t] @ p["readout"][d].T + after
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z) * 2
                dr = dc * gc * r * (1 - r) * 2
                da = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(out["tables"][d], x[t], da)
                out["loops"][d] += h.T @ dg
                after = dh * z + dg @ p["loops"][d].T
        return out

    def read(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, behind: np.ndarray, labels: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over positions of the distributions for windows of `size` bytes of flat from `start` on, which have `before`
        and `behind` bytes to warm up on; on demand the language number at each position."""
        p, n, steps = self.params, len(start), int(size.max(initial=0))
        hs = p["loops"].shape[1]
        order = np.argsort(-size, kind="stable")
        at, size, before, behind = start[order], size[order], before[order], behind[order]
        nth = np.arange(-WARM, steps + WARM)[:, None]
        inside = (nth >= -before) & (nth < size + behind)
        x = np.where(inside, flat[np.clip(at + nth, 0, max(len(flat) - 1, 0))], np.uint16(NOTHING))
        live = np.searchsorted(-size, -np.arange(steps), side="left").tolist()  # windows longer than t
        near = np.searchsorted(-size, WARM - np.arange(steps + WARM), side="left").tolist()  # the same, with what is behind them
        states, total = np.zeros((steps, n, hs), np.float32), np.zeros((n, len(self.langs)), np.float32)
        best = np.zeros((n, steps), np.int16) if labels else None
        for d, turn in enumerate((range(-WARM, steps), range(steps + WARM - 1, -1, -1))):
            loops, h = p["loops"][d], np.zeros((n, hs), np.float32)
            tables = np.concatenate([p["tables"][d], np.zeros((1, 3 * hs), np.float32)])
            tables[NOTHING, :hs] = 1e6  # an update gate of 1 leaves the state as it is
            for t in turn:
                if not (k := near[t] if d else n if t < 0 else live[t]):
                    continue
                own, a = h[:k], tables.take(x[t + WARM, :k], axis=0)
                g = own @ loops
                zr = a[:, : 2 * hs]
                zr += g[:, : 2 * hs]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = g[:, 2 * hs :] * zr[:, hs:]
                c += a[:, 2 * hs :]
                np.tanh(c, out=c)
                own -= c
                own *= zr[:, :hs]
                own += c
                if t < 0 or t >= steps:
                    continue
                if d == 0:
                    states[t, :k] = own
                    continue
                k = live[t]
                e = states[t, :k] @ p["readout"][0]
                e += own[:k] @ p["readout"][1]
                e += p["bias"]
                if labels:
                    best[:k, t] = e.argmax(axis=1)
                e -= e.max(axis=1, keepdims=True)
                np.exp(e, out=e)
                e /= e.sum(axis=1, keepdims=True)
                total[:k] += e
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return total[back], best[back] if labels else None

    @staticmethod
    def windows(texts: list[str]) -> tuple[np.ndarray, ...]:
        """All bytes one after the other, and of each window its text, start, size and the bytes before and behind it to warm up on."""
        raw = [t.encode(errors="replace") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), counts)
        start = np.repeat(ends - sizes, counts) + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
        for _ in range(3):  # no window begins within a character
            start -= (flat[start] & 0xC0) == 0x80 if len(flat) else 0
        stop = np.append(start[1:], len(flat))
        return flat, doc, start, stop - start, np.minimum(WARM, start - (ends - sizes)[doc]), np.minimum(WARM, ends[doc] - stop)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the mean distribution over all its bytes; an empty text's is uniform."""
        out = np.zeros((len(texts), len(self.langs)))
        flat, doc, start, size, before, behind = self.windows(texts)
        for i in range(0, len(doc), LANES):
            at = slice(i, i + LANES)
            total, _ = self.read(flat, start[at], size[at], before[at], behind[at])
            np.add.at(out, doc[at], total)
        out[out.sum(axis=1) == 0] = 1
        return out / out.sum(axis=1, keepdims=True)

    def positions(self, text: str) -> list[str]:
        """The language at each byte of a text."""
        flat, _, start, size, before, behind = self.windows([text])
        _, best = self.read(flat, start, size, before, behind, labels=True)
        return [self.langs[k] for row, n in zip(best, size.tolist(), strict=True) for k in row[:n]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score; UNKNOWN and 0 for a text that is null or has no letter."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER(t)] if self.langs else []
        for lo, hi in groups([texts[i] for i in at]):
            p = self.probabilities([texts[i] for i in at[lo:hi]])
            for i, row, k in zip(at[lo:hi], p, p.argmax(axis=1), strict=True):
                langs[i], scores[i] = self.langs[k], float(row[k])
        return langs, scores


def train(places: list[bytes], labels: list[str], seed: int = SEED, steps: int = STEPS) -> Network:
    """Adam on the mean cross entropy over positions of places drawn with a seed; of each LENGTH bytes at most are read."""
    langs = sorted(Counter(labels))
    net = Network.start(langs, seed)
    own = [(np.frombuffer(t[:LENGTH], np.uint8), langs.index(y)) for t, y in zip(places, labels, strict=True) if t]
    if len(langs) < 2 or not own:
        return net
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.params.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(own), BATCH)
        x, y = np.zeros((LENGTH, BATCH), np.uint8), np.array([own[i][1] for i in pick])
        seen = np.zeros((LENGTH, BATCH), np.float32)
        for k, i in enumerate(pick.tolist()):
            part = own[i][0]
            x[: len(part), k], seen[: len(part), k] = part, 1
        logits, kept = net.forward(x)
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        grad = e / e.sum(axis=2, keepdims=True)
        grad[:, np.arange(BATCH), y] -= 1
        grad *= (seen / seen.sum())[:, :, None]
        g = net.backward(x, kept, grad)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, p in net.params.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def learn(docs: DataFrame, held_in, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Network:
    """Train on rows of docs with a label and for which held_in (a Column) holds: `most` rows at most, by a hash of the id; rows
    that repeat an id and a text count once, and repeated ids don't crowd out others. From anywhere in each of their texts
    PLACES runs of LENGTH bytes are drawn, where they are; only these go to the driver. No labelled row: nothing is learnt."""
    d = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & held_in).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("y"))
    ids = stored(d.select(F.col("id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = bounded_rows(stored(d.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")), most, "id")
    raw = F.col("text").cast("binary")
    at = lambda k: (F.pmod(F.xxhash64("id", k), F.greatest(F.octet_length("text") - LENGTH, F.lit(0)) + 1) + 1).cast("int")
    places = rows.select("y", F.transform(F.sequence(F.lit(1), F.lit(PLACES)), lambda k: F.substr(raw, at(k), F.lit(LENGTH))).alias("t")).collect()
    drawn = sorted((bytes(t), r.y) for r in places for t in r.t)
    return train([t for t, _ in drawn], [y for _, y in drawn])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """For each row of docs its id, lang_pred, score; with keep, all columns of docs and _lang_pred, _score.

    A null text and one without a letter are UNKNOWN with score 0, and so is every text if nothing was learnt. Repeated
    rows get the same again, an empty table gives no rows, and columns but the id and the text are not looked at.
    With keep the two new columns are named _lang_pred and _score, with further underscores where docs has such a column,
    and are the last ones. The network, a few thousand numbers, is broadcast. Nothing is shuffled.
    """
    model = expose(docs.sparkSession).sparkContext.broadcast(net)
    if keep:
        lang, score = "_lang_pred", "_score"
        while {lang, score} & {c.lower() for c in docs.columns}:
            lang, score = f"_{lang}", f"_{score}"
        schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
        source, column = docs, text_col
    else:
        schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        source, column = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text"
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            langs, scores = model.value.predict(batch.column(column).to_pylist())
            rest = batch.columns if keep else [batch.column("id")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    out = source.mapInArrow(run, schema)
    return out if keep else out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    net = learn(docs, fold(F.col("doc_id"), 5) != 0)
    return identify(docs, net).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
