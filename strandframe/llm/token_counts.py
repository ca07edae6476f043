"""Token counts by a compiled finite-state tokenizer.

A deterministic transducer reads the bytes of a batch of texts. Its states are the last-token states of bpe.Automaton, its
symbols a byte and whether a word of the vocabulary's pattern begins there, and each transition carries how many tokens
more there are than before it, so that the sum over a text's bytes is its number of tokens. States and transitions are
compiled from the vocabulary when they are first met, whatever the text; no text is counted by the library.

The batch is cut into chunks of CHUNK bytes, wherever that is, and all chunks are read in step, one byte of each at a time.
The map of a chunk in which a word begins takes every entering state to the same exit; only the bytes before that place,
its head, depend on the entering state. A chunk without such a place is all head. A prefix scan composes the maps: it
finds the nearest constant one before each chunk, and the heads are read from the states that then are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Automaton, special_tokens
from .common import documents, expose, groups, kept
from .words import Batch, Kinds

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256
#: Cells of the table, 4 bytes each, after which the transducer is compiled anew.
CELLS = 32_000_000
#: A cell is the next row, shifted, and the change in tokens, moved by half of the shift's range; -1 is not compiled yet.
SHIFT = 9
ZERO = 1 << SHIFT - 1
#: Rows of the table: what reads nothing before a word begins, and the start of a word. Row r is state r - 1 of the automaton.
IDLE, START = 0, 1
#: Heads in step up to which they are read one by one.
FEW = 3


class Transducer:
    """A table of transitions by row and symbol, filled as they are met."""

    def __init__(self, vocabulary: str):
        self.automaton = Automaton(vocabulary)
        if max(self.automaton.sizes.values()) >= ZERO:
            raise ValueError("the vocabulary has tokens too long for a cell")
        self.column = np.full(256, -1, np.int32)
        self.bytes: list[int] = []
        self.width = 64
        self._clear()

    def _clear(self) -> None:
        self.automaton.reset()
        self.cells = np.full((1 << 14) * self.width, -1, np.int32)
        self.cells[: self.width] = ZERO  # IDLE stays IDLE

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        """The column of each byte; between batches only, since the table may be laid out anew."""
        for b in np.flatnonzero((np.bincount(raw, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        width = self.width
        self.width = max(width, -(-len(self.bytes) // 16) * 16)
        if len(self.automaton.keys) * self.width > CELLS:
            self._clear()
        elif self.width > width:
            old = self.cells.reshape(-1, width)
            cells = np.full((len(old), self.width), -1, np.int32)
            cells[:, :width] = old
            cells[0] = ZERO
            self.cells = cells.ravel()
        return self.column[raw]

    def compile(self, cell: int) -> int:
        row, column = divmod(cell, self.width)
        state, more = self.automaton.step(row - START, self.bytes[column])
        if (state + START + 1) * self.width > len(self.cells):
            self.cells = np.concatenate([self.cells, np.full(len(self.cells) // 2 // self.width * self.width, -1, np.int32)])
        v = self.cells[cell] = state + START << SHIFT | ZERO + more
        return int(v)

    def step(self, cell: np.ndarray) -> np.ndarray:
        """The values of cells, compiled where they are not yet."""
        v = self.cells[cell]
        if len(v) and v.min() < 0:
            lack = np.flatnonzero(v < 0)
            for c in np.unique(cell[lack]).tolist():
                self.compile(c)
            v[lack] = self.cells[cell[lack]]
        return v

    def chunks(self, symbols: np.ndarray, begins: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Read all chunks in step, each from its first begin on; fill in the changes and return the exit rows, IDLE without a begin."""
        n, lanes = len(symbols), -(-len(symbols) // CHUNK)
        turn, base = np.zeros(lanes * CHUNK, np.int32), np.zeros(lanes * CHUNK, np.int32)
        turn[:n] = np.where(begins, 0, self.width)  # a begin leaves the row for START
        base[:n] = symbols + np.where(begins, np.int32(START * self.width), np.int32(0))
        turn, base = (np.ascontiguousarray(x.reshape(lanes, CHUNK).T) for x in (turn, base))
        out, row = np.empty((CHUNK, lanes), np.int16), np.zeros(lanes, np.int32)
        last = (n - 1) % CHUNK  # where the last chunk ends
        for t in range(CHUNK):
            v = self.step(row * turn[t] + base[t])
            row = v >> SHIFT
            out[t] = (v & 2 * ZERO - 1) - ZERO
            if t == last:
                end = int(row[-1])
        row[-1] = end
        more[:] = out.T.ravel()[:n]
        return row

    def heads(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Read bytes start to end of each head from a row; fill in the changes and return the exit rows."""
        order = np.argsort(starts - ends, kind="stable")
        at, left, row = starts[order], (ends - starts)[order], rows[order].astype(np.int64)
        live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")  # heads longer than t
        for t, k in enumerate(live.tolist()):
            if k <= FEW:
                for j in range(k):
                    row[j] = self.one(symbols, int(at[j]) + t, int(at[j] + left[j]), int(row[j]), more)
                break
            v = self.step(row[:k] * self.width + symbols[at[:k] + t])
            row[:k] = v >> SHIFT
            more[at[:k] + t] = (v & 2 * ZERO - 1) - ZERO
        out = np.empty(len(row), np.int64)
        out[order] = row
        return out

    def one(self, symbols: np.ndarray, start: int, end: int, row: int, more: np.ndarray) -> int:
        found, width = [], self.width
        item = self.cells.item
        for s in symbols[start:end].tolist():
            if (v := item(row * width + s)) < 0:
                v = self.compile(row * width + s)
                item = self.cells.item
            row = v >> SHIFT
            found.append((v & 2 * ZERO - 1) - ZERO)
        more[start:end] = found
        return row


def scan(exits: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each chunk: the exit of the nearest constant map before it, and how many open ones are between.

    Composing two maps keeps the later one if it is constant, and else carries the earlier one's exit through the later
    one. This is done for the maps of all prefixes at once, by doubling distances.
    """
    row = np.concatenate([np.full(1, IDLE, np.int64), exits[:-1]])
    known = np.concatenate([np.ones(1, bool), constant[:-1]])
    open_ = (~known).astype(np.int64)
    step = 1
    while not known.all():
        earlier, was, between = row[:-step].copy(), known[:-step].copy(), open_[:-step].copy()
        take = ~known[step:]
        row[step:] = np.where(take, earlier, row[step:])
        open_[step:] += np.where(take, between, 0)
        known[step:] |= was
        step *= 2
    return row, open_


class Counts:
    """Counts the tokens of texts; one for each worker, with its transducer."""

    def __init__(self, vocabulary: str):
        self.special = list(special_tokens(vocabulary))
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split
        self.transducer, self.kinds = Transducer(vocabulary), Kinds()

    def run(self, texts: list[str]) -> list[int]:
        if any(s in t for s in self.special for t in texts):  # each is one token and cuts its text
            parts = [self.cut(t) if any(map(t.__contains__, self.special)) else [t] for t in texts]
            counts = iter(self._run([p for ps in parts for p in ps]))
            return [sum(next(counts) for _ in ps) + len(ps) - 1 for ps in parts]
        return self._run(texts)

    def _run(self, texts: list[str]) -> list[int]:
        batch, t = Batch(texts, self.kinds), self.transducer
        n = len(batch.raw)
        if not n:
            return [0] * len(texts)
        cuts = batch.at[np.flatnonzero(batch.byte_cuts())]
        begins = np.zeros(n, bool)
        begins[cuts] = True
        symbols, more = t.symbols(batch.raw), np.empty(n, np.int16)
        exits = t.chunks(symbols, begins, more).astype(np.int64)
        starts = np.arange(0, n, CHUNK)
        ends = np.append(starts[1:], n)
        first = np.append(cuts, n)[np.searchsorted(cuts, starts)]
        constant = first < ends
        rows, between = scan(exits, constant)
        for k in range(int(between.max()) + 1):  # most batches have no open chunk, and one round
            at = np.flatnonzero((between == k) & (first > starts))
            if k:
                rows[at] = exits[at - 1]
            out = t.heads(symbols, starts[at], np.minimum(first, ends)[at], rows[at], more)
            exits[at] = np.where(constant[at], exits[at], out)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(more, dtype=np.int64)])
        return np.diff(upto[batch.at[batch.texts]]).tolist()


def _counts(vocabulary: str) -> Counts:
    """One for each vocabulary and worker; what it compiled lives from task to task."""
    return kept((Counts, hash(vocabulary)), lambda: Counts(vocabulary))


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary_path is a byte-level tokenizers file read on the driver and broadcast, a few MB whatever the input. Null
    texts count as empty and have no tokens; a special token inside a text is one token, as is the library's default.
    Repeated rows count again, extra columns are not read, an empty table gives no rows. Nothing is shuffled.
    """
    vocabulary = expose(docs.sparkSession).sparkContext.broadcast(Path(vocabulary_path).read_text())
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary.value)
        for batch in batches:
            texts, n = batch.column("text").to_pylist(), []
            for lo, hi in groups(texts):
                n += counts.run(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, T.StructType(fields))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
