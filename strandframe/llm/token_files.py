"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a run of documents. Each block of BLOCK ids stores their minimum, the differences from it in as
few bits as hold PERCENTILE of them, and the rest as exceptions: position and the bits above that width. An index of
block starts lets a reader open any range of ids without reading what is before it.

    magic, documents, ids, block size, blocks | id, null flag and length of each document | block starts | blocks
    block: minimum, width, exceptions | packed low bits | positions of exceptions | their high bits

Files are the rows of a Parquet table (part, seq, first, data): Spark's committer makes every file appear once, whatever
tasks are lost or run twice, and on any file system that Spark reaches. export() puts them in a folder as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteCodec
from .common import SALTS, documents, expose, groups, kept, lookup_join, stored

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"PFOR0001"
HEAD = struct.Struct("<8sQQIQ")
BLOCK_HEAD = struct.Struct("<IBI")
BLOCK = 1024
#: Blocks of one width that are handled at a time.
SLAB = 32
PERCENTILE = 90
#: Ids of a file, or few more.
FILE_IDS = 1 << 18
FILES = "part int, seq int, first long, n_docs long, n_tokens long, data binary"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _slabs(widths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of equal width, SLAB at a time."""
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        for i in range(0, len(at), SLAB):
            yield int(w), at[i : i + SLAB]


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of unsigned 32-bit ids; the last one is filled up with its last id."""
    if not len(ids):
        return []
    n = -(-len(ids) // block)
    x = np.concatenate([ids, np.full(n * block - len(ids), ids[-1], np.uint32)]).reshape(n, block)
    low = x.min(axis=1)
    rest = x - low[:, None]
    k = max(0, -(-block * percentile // 100) - 1)
    widths = _widths(np.partition(rest, k, axis=1)[:, k])
    out: list[bytes] = [b""] * n
    for w, at in _slabs(widths):
        r = rest[at]
        kind = "<u2" if w <= 16 else "<u4"
        bits = np.unpackbits(r.astype(kind).view(np.uint8).reshape(len(at), block, -1), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        high = (r.astype(np.uint64) >> np.uint64(w)).astype(np.uint32)
        for j, b in enumerate(at):
            odd = np.flatnonzero(high[j])
            out[b] = BLOCK_HEAD.pack(low[b], w, len(odd)) + packed[j].tobytes() + odd.astype("<u4").tobytes() + high[j][odd].astype("<u4").tobytes()
    return out


def unpack_blocks(data: memoryview, starts: np.ndarray, block: int) -> np.ndarray:
    """The ids of the blocks that begin at starts."""
    heads = [BLOCK_HEAD.unpack_from(data, s) for s in starts]
    out = np.zeros((len(heads), block), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for w, at in _slabs(widths):
        size = -(-block * w // 8)
        if w:
            own = np.stack([raw[p : p + size] for p in (starts[at] + BLOCK_HEAD.size).tolist()])
            kind, width = ("<u2", 16) if w <= 16 else ("<u4", 32)
            wide = np.zeros((len(at) * block, width), np.uint8)
            wide[:, :w] = np.unpackbits(own, axis=1, count=block * w, bitorder="little").reshape(-1, w)
            out[at] = np.packbits(wide.reshape(-1), bitorder="little").view(kind).reshape(len(at), block)
        for b in at.tolist():
            if m := heads[b][2]:
                p = starts[b] + BLOCK_HEAD.size + size
                out[b, np.frombuffer(data, "<u4", m, p)] |= np.frombuffer(data, "<u4", m, p + 4 * m) << np.uint32(w)
    return out + np.array([h[0] for h in heads], np.uint32)[:, None] if heads else out


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The bytes of a file with the ids of each document."""
    flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.uint32)
    blocks = pack_blocks(flat, block, percentile)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([HEAD.pack(MAGIC, len(ids), len(flat), block, len(blocks)), names, np.array([len(x) for x in ids], "<u4").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Reads the bytes of a file."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, docs, self.n_tokens, self.block, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        p = HEAD.size
        ids, null = np.frombuffer(data, "<i8", docs, p).tolist(), np.frombuffer(data, np.uint8, docs, p + 8 * docs)
        self.doc_ids = [None if x else i for i, x in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(data, "<u4", docs, p + 9 * docs).astype(np.int64)
        p += 13 * docs
        self.starts = np.frombuffer(data, "<u8", blocks + 1, p).astype(np.int64) + p + 8 * (blocks + 1)

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from their own blocks only."""
        stop = min(stop, self.n_tokens)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        return unpack_blocks(self.data, self.starts[a:b], self.block).reshape(-1)[start - a * self.block : stop - a * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start within the file and token ids of each document."""
        flat, at = self.range(0, self.n_tokens), 0
        for d, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            yield d, at, flat[at : at + n]
            at += n


def _codec(vocabulary: str) -> ByteCodec:
    """One for each vocabulary and worker; its table of words lives from task to task."""
    return kept((ByteCodec, hash(vocabulary)), lambda: ByteCodec(vocabulary))


def write_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """The table of files, written to the shared folder, in ascending order of id, nulls first, over (part, seq).

    Texts are dealt out by ranges of id and sorted there, rows that repeat an id by a hash of their text, so that neither
    these nor rows without an id make one range; rows that repeat both go to any of SALTS places there. A task encodes its
    range and holds one file's ids at a time. first is the number of ids in the part before the file. A null text is an
    empty one and has the end id alone. No rows give no files. Extra columns are not read.
    """
    vocabulary = expose(docs.sparkSession).sparkContext.broadcast(Path(vocabulary_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = _codec(vocabulary.value), TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = seq = first = 0

        def flush() -> pa.RecordBatch:
            row = [[part], [seq], [first], [len(ids)], [held], [write_file(names, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "first", "n_docs", "n_tokens", "data"])

        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for lo, hi in groups(texts):
                flat, begins = codec.encode(texts[lo:hi])
                flat = np.insert(flat.astype(np.uint32), begins[1:], np.uint32(end_id))
                for name, code in zip(own[lo:hi], np.split(flat, begins[1:-1] + np.arange(1, hi - lo)), strict=True):
                    names.append(name)
                    ids.append(code)
                    held += len(code)
                    if held >= file_ids:
                        yield flush()
                        seq, first, held, names, ids = seq + 1, first + held, 0, [], []
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("id", "text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"))
    dealt = keyed.repartitionByRange("id", "h", "salt").sortWithinPartitions("id", "h", "salt").select("id", "text")
    return stored(dealt.mapInArrow(run, FILES))


def read_tokens(files: DataFrame, id_col: str = "doc_id", values: bool = False) -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32, and with values the ids themselves."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part that was written
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stored(parts.select("part", before.cast("long").alias("base")))
    schema = "part int, id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), batch.column("data"), strict=True):
                rows = [(part, d, first + at, len(x), zlib.crc32(x.astype("<u4").tobytes()), *([x.tolist()] if values else [])) for d, at, x in TokenFile(data.as_py()).documents()]
                kinds = (pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * values)
                names = ["part", "id", "start", "n_tokens", "ids_crc32", *["ids"] * values]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = lookup_join(files.select("part", "first", "data").mapInArrow(run, schema), bases, "part", "inner")
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * values)


def export(files: DataFrame, folder: str) -> DataFrame:
    """Write each file's bytes to folder, which all executors mount, under a name that sorts in order; returns name and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data"), strict=True):
                to = Path(folder, f"{part:08d}-{seq:08d}.pfor")
                tmp = to.with_name(f"{to.name}.{TaskContext.get().taskAttemptId()}")
                tmp.write_bytes(raw := data.as_py())
                tmp.replace(to)  # whole or not at all
                yield pa.RecordBatch.from_arrays([pa.array([to.name]), pa.array([len(raw)], pa.int64())], names=["name", "size"])

    return files.select("part", "seq", "data").mapInArrow(run, T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))
