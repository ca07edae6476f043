"""Ranked search in a tiered index: postings of high impact first, bounds for the rest, lower tiers where those prove nothing.

The index is a table of segments, a few thousand documents each. A segment has its terms, and for each term its postings from
the highest impact on, cut into tiers: the first SHORT or a sixteenth, up to LONG or a quarter, the rest. With each term stand
the highest impacts of all its postings and of those below the first and the second tier. Documents are cut into segments
where they are read, so that no text and no posting is shuffled and a term that all documents hold is in many segments.

A search goes twice over the table. First only first tiers are read: their sums are lower bounds of scores, and of each
item the K-th best of them all is the mark to reach. Then each segment works out which of its documents could reach it. While
the bounds of what is below the tiers read add up to the mark or more, some document not seen yet might, and the item falls
through to the segment's next tier; once they don't, only the documents seen whose own bound reaches the mark are completed from
the tiers below. So all scores that come out are whole, and no document that belongs there is missing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, documents, expose, forget, stored

#: Runs of digits, letters and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 to those of terms: A-Z in lower case, space for what is in no term.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
K = 50
#: Documents and bytes of text of a segment; a longer text is a segment of its own. Bytes cut into terms at a time.
SEGMENT_DOCS, SEGMENT_BYTES, PIECE = 4096, 6 << 20, 1 << 20
#: Postings of a term in the first tier, and in the first two, at least; its share of all of them is a sixteenth and a quarter.
SHORT, LONG = 8, 32
#: Items answered at a time, and terms of these: what tasks are sent is as large as that.
ITEMS, ITEM_TERMS = 1024, 200_000
LOCAL = "segment long, ids array<{id}>, terms binary, df binary, top binary, below0 binary, below1 binary, docs0 binary, s0 binary, docs1 binary, s1 binary, docs2 binary, s2 binary"


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, PIECE bytes of it at a time or up to the end of a longer term."""
    start = 0
    while start < len(raw):
        end = start + PIECE
        part = raw[start:end].translate(_TERM_BYTES)
        while end < len(raw) and (cut := part.rfind(b" ")) < 0:
            part, end = part + raw[end : end + PIECE].translate(_TERM_BYTES), end + PIECE
        if end < len(raw):
            part, end = part[:cut], start + cut + 1
        yield part.split()
        start = end


def tier_sizes(df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.minimum(df, np.maximum(SHORT, df // 16))
    second = np.minimum(df, np.maximum(LONG, df // 4)) - first
    return first, second, df - first - second


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms; in Python's numbers where a product could leave 64 bits."""
    if 50 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 50 + 50 * n * n_docs // n_terms
    return np.array([50 + 50 * int(v) * n_docs // n_terms for v in n], np.int64)


class Segment:
    """Documents as they come, until it is closed: ids and numbers of their terms."""

    def __init__(self) -> None:
        self.ids: list = []
        self.size = 0
        self.words: list[np.ndarray] = []
        self.n: list[int] = []
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__

    def add(self, doc_id: object, raw: bytes) -> None:
        n = 0
        for terms in pieces(raw):
            self.words.append(np.fromiter(map(self.terms.__getitem__, terms), np.int32, len(terms)))
            n += len(terms)
        self.ids.append(doc_id)
        self.n.append(n)
        self.size += len(raw)

    def closed(self, number: int, n_docs: int, n_terms: int) -> list:
        """A row of the index."""
        n = np.array(self.n, np.int64)
        v = max(1, len(self.terms))
        doc = np.repeat(np.arange(len(n)), n)
        key, tf = np.unique(doc * v + np.concatenate([np.zeros(0, np.int32), *self.words]), return_counts=True)
        doc, term = key // v, key % v
        s = impacts(tf.astype(np.int64), lengths(n, n_docs, n_terms)[doc])
        by = np.lexsort((doc, -s, term))
        doc, s, df = doc[by].astype(np.uint16), s[by].astype(np.int32), np.bincount(term, minlength=len(self.terms))
        sizes = tier_sizes(df)
        start = np.cumsum(df) - df
        at = lambda k: np.where(k < df, s[np.minimum(start + k, max(0, len(s) - 1))], 0).astype(np.int32) if len(s) else np.zeros(len(df), np.int32)
        tier = np.repeat(np.tile(np.arange(3), len(df)), np.stack(sizes, axis=1).reshape(-1))
        row = [number, self.ids, b" ".join(self.terms), df.astype(np.int32).tobytes(), at(0 * df).tobytes(), at(sizes[0]).tobytes(), at(sizes[0] + sizes[1]).tobytes()]
        for k in range(3):
            row += [doc[tier == k].tobytes(), s[tier == k].tobytes()]
        return row


@dataclass
class Index:
    """A stored table of segments, the documents that have terms, and all their terms with repeats."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of docs: one pass counts terms, one cuts segments. Null and empty texts have no terms and are in none."""
    expose(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        n_docs = n_terms = 0
        for b in batches:
            for t in b.column(0):
                n = sum(map(len, pieces(t.as_py() or b"")))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["docs", "terms"])

    n_docs, n_terms = texts.select("text").mapInArrow(counted, "docs long, terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "terms"))).first()
    kind = docs.schema[id_col].dataType
    schema = T._parse_datatype_string(LOCAL.format(id=kind.simpleString()))
    arrow = [pa.int64(), None, *[pa.binary()] * 11]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        number, open_ = TaskContext.get().partitionId() << 32, Segment()

        def row() -> pa.RecordBatch:
            nonlocal open_, number
            values = open_.closed(number, n_docs, n_terms)
            open_, number = Segment(), number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=t or pa.list_(ids)) for v, t in zip(values, arrow, strict=True)], names=schema.fieldNames())

        ids = pa.int64()
        for b in batches:
            ids = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = b"" if not t.is_valid else t.as_py()
                if not raw.translate(_TERM_BYTES).strip():
                    continue
                if open_.ids and (len(open_.ids) >= SEGMENT_DOCS or open_.size + len(raw) > SEGMENT_BYTES):
                    yield row()
                open_.add(i, raw)
        if open_.ids:
            yield row()

    return Index(stored(texts.mapInArrow(run, schema)), int(n_docs), int(n_terms))


@dataclass
class Block:
    """Items that are answered together: their ids and terms by number, and by item the mark to reach."""

    ids: list = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, item_id: object, text: str | None) -> None:
        own: dict[bytes, None] = {}
        for terms in pieces((text or "").encode()):
            own |= dict.fromkeys(terms)
        self.ids.append(item_id)
        self.items.append(np.array([self.terms.setdefault(t, len(self.terms)) for t in own], np.int64))


def blocks(items: Iterable[tuple]) -> Iterator[Block]:
    block = Block()
    for item_id, text in items:
        block.add(item_id, text)
        if len(block.ids) >= ITEMS or len(block.terms) >= ITEM_TERMS:
            yield block
            block = Block()
    if block.ids:
        yield block


class Reader:
    """The terms of a block in one segment: for each tier, where in it their postings are."""

    def __init__(self, row: dict, block: Block):
        self.row = row
        self.df = np.frombuffer(row["df"], np.int32).astype(np.int64)
        self.place = np.full(len(block.terms), -1, np.int64)
        for i, t in enumerate(row["terms"].split(b" ")):
            if (k := block.terms.get(t)) is not None:
                self.place[k] = i
        self.sizes = tier_sizes(self.df)
        self.starts = [np.cumsum(z) - z for z in self.sizes]
        self.tiers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name], np.int32).astype(np.int64)

    def postings(self, tier: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        if tier not in self.tiers:
            self.tiers[tier] = np.frombuffer(self.row[f"docs{tier}"], np.uint16), np.frombuffer(self.row[f"s{tier}"], np.int32)
        docs, s = self.tiers[tier]
        a, b = int(self.starts[tier][at]), int(self.starts[tier][at] + self.sizes[tier][at])
        return docs[a:b], s[a:b].astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, and of all that equal the last of them."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
    return some


def lower_bounds(rows: Iterable[dict], block: Block, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each item the k highest sums of first-tier postings of these segments' documents."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(block.ids)
    for row in rows:
        r = Reader(row, block)
        sums = np.zeros(len(row["ids"]), np.int64)
        for i, own in enumerate(block.items):
            places = r.place[own]
            sums[:] = 0
            for t, at in zip(own[places >= 0].tolist(), places[places >= 0].tolist(), strict=True):
                docs, s = r.postings(0, at)
                sums[docs] += block.weights[t] * s
            top = np.concatenate([found[i], sums[best(sums, k)]])
            found[i] = np.sort(top)[::-1][:k] if len(top) > k else top
    for i, top in enumerate(found):
        if len(top):
            yield i, top


def reaching(r: Reader, block: Block, item: int, below: list[np.ndarray], mark: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents of a segment that reach the mark, with their whole scores, and the tier at which that was proven."""
    own = block.items[item]
    places = r.place[own]
    own, places = own[places >= 0], places[places >= 0]
    w = block.weights[own]
    n = len(r.row["ids"])
    none = np.zeros(0, np.int64)
    if int((w * below[0][places]).sum()) < mark:  # not even a document with the best posting of each term
        return none, none, 0
    sums, missing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for tier in range(3):
        rest = w * below[tier + 1][places]
        total = int(rest.sum())
        missing[:] = total
        for j, at in enumerate(places.tolist()):
            docs, s = r.postings(tier, at)
            sums[docs] += w[j] * s
            for seen in range(tier + 1 if rest[j] else 0):
                missing[r.postings(seen, at)[0]] -= rest[j]
        if total < mark:
            break
    chosen = sums + missing >= mark
    for lower in range(tier + 1, 3):
        for j, at in enumerate(places.tolist()):
            docs, s = r.postings(lower, at)
            mine = chosen[docs]
            sums[docs[mine]] += w[j] * s[mine]
    found = np.flatnonzero(chosen & (sums >= mark))
    return found, sums[found], tier


def _ordered(ids: list, scores: list[int], k: int) -> list[int]:
    """Places of the k best by score, equal ones by id, null ids first."""
    return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is not None, ids[i] if ids[i] is not None else 0))[:k]


def whole_scores(rows: Iterable[dict], block: Block, k: int) -> Iterator[tuple[int, list, list[int], list[int]]]:
    """Of each item ids, scores and tiers of the k best documents of these segments that reach its mark."""
    found: list[tuple[list, list[int], list[int]]] = [([], [], []) for _ in block.ids]
    marks = np.maximum(block.marks, 1)
    for row in rows:
        r = Reader(row, block)
        below = [r.numbers("top"), r.numbers("below0"), r.numbers("below1"), np.zeros(len(r.df), np.int64)]
        for i in range(len(block.ids)):
            docs, scores, tier = reaching(r, block, i, below, int(marks[i]))
            if not len(docs):
                continue
            ids, own, tiers = found[i]
            at = best(scores, k)
            ids += [row["ids"][d] for d in docs[at].tolist()]
            own += scores[at].tolist()
            tiers += [tier] * len(at)
            if len(ids) > k:
                keep = _ordered(ids, own, k)
                found[i] = [ids[j] for j in keep], [own[j] for j in keep], [tiers[j] for j in keep]
                marks[i] = max(marks[i], found[i][1][-1])
    for i, (ids, scores, tiers) in enumerate(found):
        if ids:
            yield i, ids, scores, tiers


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _frequencies(index: Index, block: Block) -> np.ndarray:
    """In how many documents each term of the block is, counted by segments and added up."""
    sent = index.segments.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(len(sent.value), np.int64)
        for row in _rows(batches):
            df = np.frombuffer(row["df"], np.int32)
            for i, t in enumerate(row["terms"].split(b" ")):
                if (k := sent.value.get(t)) is not None:
                    total[k] += df[i]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(len(block.terms), np.int64)
    for r in index.segments.select("terms", "df").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _marks(index: Index, block: Block, k: int) -> np.ndarray:
    """The k-th best lower bound of each item over all segments; 0 where there are fewer."""
    sent = index.segments.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for i, top in lower_bounds(_rows(batches), sent.value, k):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int32()), pa.array(top)], names=["item", "score"])

    rows = index.segments.select("ids", "terms", "df", "docs0", "s0").mapInArrow(run, "item int, score long")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    for keys in (["item", "salt"], ["item"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))).where(F.col("place") <= k)
    marks = np.zeros(len(block.ids), np.int64)
    for r in rows.where(F.col("place") == k).select("item", "score").collect():
        marks[r.item] = r.score
    return marks


def search(index: Index, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
    """item_id, rank, id, score, tier of each item's k best documents with a score above 0; tier is where it was proven.

    Each row of items is an item and each row of the index a document of its own, also where ids repeat; equal scores stand by
    ascending id, null first. Items without terms, and those of which no document holds a term of weight above 0, have no rows. Items are read and
    answered by blocks of ITEMS rows, or of fewer that have ITEM_TERMS terms.
    """
    spark = expose(items.sparkSession)
    id_kind, item_kind = index.segments.schema["ids"].dataType.elementType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind), T.StructField("doc", id_kind), T.StructField("score", T.LongType()), T.StructField("tier", T.IntegerType())])
    out = None
    for block in blocks(tuple(r) for r in items.select(item_col, text_col).toLocalIterator()):
        if not block.terms or not index.n_docs:
            continue
        df = _frequencies(index, block).tolist()
        block.weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df], np.int64)
        block.marks = _marks(index, block, k)
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forget()
            block = sent.value
            for i, ids, scores, tiers in whole_scores(_rows(batches), block, k):
                yield pa.RecordBatch.from_pylist([{"item": i, "item_id": block.ids[i], "doc": d, "score": s, "tier": t} for d, s, t in zip(ids, scores, tiers, strict=True)], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows = index.segments.mapInArrow(run, schema)
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        for keys in (["item", "salt"], ["item"]):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc")))).where(F.col("rank") <= k)
        rows = stored(rows.select("item_id", "rank", "doc", "score", "tier"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema).select("item_id", F.lit(1).alias("rank"), "doc", "score", "tier")
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_name), "score", "tier")


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
i AS (SELECT item_id, unnest(list_distinct({_SPLIT})) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, stats GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN w USING (term) JOIN i USING (term), stats GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = expose(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(build(documents(spark, sf_dir)), items).select("item_id", "rank", "doc_id", "score")
