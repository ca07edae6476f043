"""Near-duplicate groups by a Jaccard join of word shingles in prefix trees.

Texts become sets of 64-bit shingle hashes; equal sets are one class. Two sets that link miss few elements of each other,
so they share several of the first elements of either in a global order (the hash itself), and, among those first
elements, one of the rarest. Three exchanges of packed (element, set) pairs follow from that: by element, to count how
many sets have each; by set, to order a set's first elements by that count and keep those in which it must meet a
partner, none for most sets; and by element again, where sets that meet are tied to the least of them. Elements that are
common already within a task count as the most frequent of all: they travel by set, not by element, and tie sets as nodes of
their own, so that no task holds all sets of such an element. What is tied together is a candidate cluster.

A large cluster is taken apart first, by all elements of its sets and their exact counts in it (see refined()). The whole
sets of a cluster meet in prefix trees, which find the links exactly; clusters too large for one tree are cut into blocks
(see links()). Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, bitmap, documents, expose, forget, groups, lookup_join, marked, stored
from .components import components
from .shingle_trie import LinkTrie
from .shingles import shingle_sets, signature

PERCENT = 80
#: Two sets share a FURTHER-th of the smaller one's size among their first elements, instead of one: fewer sets pass.
FURTHER = 8
#: Elements and sets of a block at most; a tree holds two blocks at most.
BLOCK, SETS = 100_000, 300
#: An element is common if so many of the entries that a task looks through at a time, HOT_ENTRIES, have it; so many of the
#: most common ones are known to all tasks. Others may take part as rare ones: results don't hang on which these are.
HOT, HOT_ENTRIES, HOT_MOST = 8, 1 << 20, 200_000
#: Bytes of packed entries that a task of an exchange reads, about.
TASK_BYTES = 32 << 20
#: Entries that a task packs at a time: then every partition gets one packet from it.
PACK = 100_000
#: Characters of texts whose words are hashed at a time.
CHARS = 1 << 18
FIRST = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<u4")])
COUNTED = np.dtype([("key", "<i8"), ("token", "<u8"), ("n", "<u4"), ("df", "<u4")])
MEET = np.dtype([("token", "<u8"), ("key", "<i8")])
PACKET = "p int, kind int, blob binary"
#: Kinds of packets: entries by element, and entries of common elements by set.
RARE, COMMON = 0, 1
MOST = np.uint32(2**32 - 1)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of n elements with one it links to."""
    return -(-PERCENT * n // 100)


def common(n: np.ndarray) -> np.ndarray:
    """Elements that a set of size n promises to share among its first ones."""
    return np.maximum(1, n // FURTHER)


def firsts(n: int) -> int:
    """How many first elements keep that promise."""
    return int(min(n, n - needed(n) + max(1, n // FURTHER)))


def spots(parts: int) -> np.ndarray:
    """For each partition a number that Spark's hash partitioning sends there: its 32-bit Murmur3 hash with seed 42."""
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    x = np.arange(parts * (int(np.log(parts + 1)) + 12), dtype=np.uint32)
    h = np.uint32(42) ^ (turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts
    found, first = np.unique(part, return_index=True)
    out = np.arange(parts, dtype=np.int32)  # where none was found, any will do
    out[found] = x[first]
    return out


def _packets(rows: np.ndarray, field: str, spot: np.ndarray, kind: int = RARE) -> Iterator[pa.RecordBatch]:
    """rows cut by a hash of a field into packets (p, kind, blob), one for each partition."""
    if not len(rows):
        return
    p = ((rows[field].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(len(spot))
    order = np.argsort(p, kind="stable")
    rows, p = rows[order], p[order]
    cut = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
    blobs = [rows[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(spot[p[cut[:-1]]]), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["p", "kind", "blob"])


def _unpacked(batches: Iterator[pa.RecordBatch], rare: np.dtype, common: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all packets of either kind."""
    blobs: tuple[list[bytes], list[bytes]] = ([], [])
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            blobs[kind].append(blob)
    return np.frombuffer(b"".join(blobs[RARE]), rare), np.frombuffer(b"".join(blobs[COMMON]), common)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns, and their number at the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _hot(tokens: list[np.ndarray]) -> bytes | None:
    """The elements that HOT entries or more have, with their numbers."""
    found, n = np.unique(np.concatenate(tokens), return_counts=True)
    own = np.empty(int((n >= HOT).sum()), np.dtype([("token", "<u8"), ("n", "<u8")]))
    own["token"], own["n"] = found[n >= HOT], n[n >= HOT]
    return own.tobytes() or None


def scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """row, id, hash (of the text), n, sig, key for each row of docs, stored; and token, n of elements common within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names = ["row", "id", "hash", "n", "sig", "key", "hot"]
        tokens: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        for batch in batches:
            texts, sets = batch.column("text").to_pylist(), []
            for lo, hi in groups(texts, CHARS):
                for s in shingle_sets(texts[lo:hi]):
                    sets.append((len(s), sig := signature(s)))
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        tokens.append(s[: firsts(len(s))])
                        size += len(tokens[-1])
            hot = None
            if size > HOT_ENTRIES:
                hot, tokens, size = _hot(tokens), [], 0
                seen.clear()
            sigs = [s for _, s in sets]
            keys = np.frombuffer(b"".join(sigs), "<i8")[::2]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("hash"), pa.array([n for n, _ in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.int64()), pa.array([None] * (len(sets) - 1) + [hot] if sets else [], pa.binary())], names=names)
        if tokens and (hot := _hot(tokens)):
            yield pa.RecordBatch.from_arrays([*(pa.array([None], t) for t in (*[pa.int64()] * 4, pa.binary(), pa.int64())), pa.array([hot], pa.binary())], names=names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("hot").to_pylist()), [("token", "<i8"), ("n", "<i8")])
            yield pa.RecordBatch.from_arrays([pa.array(own["token"]), pa.array(own["n"])], names=["token", "n"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_ = stored(d.mapInArrow(run, "row long, id long, hash long, n long, sig binary, key long, hot binary"))
    return all_.where("row is not null").drop("hot"), all_.where("hot is not null").select("hot").mapInArrow(unpack, "token long, n long")


def candidates(docs: DataFrame, text_col: str, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """node, root: the clusters of set keys (64 bits of the signature) outside which no set links.

    The exchanges have as many partitions as the entries ask for, spark.sql.shuffle.partitions at least. What all tasks
    know of common elements are HOT_MOST numbers at most.
    """
    spark = docs.sparkSession
    entries = rows.agg(F.sum(F.col("n") * (100 - PERCENT + 100 / FURTHER) / 100)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries * FIRST.itemsize / TASK_BYTES))
    packets = spots(parts)
    most = hot.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(most["token"].to_numpy().view(np.uint64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = shared.value
        seen: set[bytes] = set()  # a task sends a set once, however many copies it reads
        held: list[np.ndarray] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            out = np.concatenate(held)
            at = np.searchsorted(known, out["token"])
            common_ = np.zeros(len(out), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == out["token"]
            yield from _packets(out[~common_], "token", packets)
            yield from _packets(out[common_], "key", packets, COMMON)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in groups(texts, CHARS):
                for s in shingle_sets(texts[lo:hi]):
                    if not len(s) or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    own = np.empty(firsts(len(s)), FIRST)
                    own["token"], own["key"], own["n"] = s[: len(own)], np.frombuffer(sig, "<i8", 1)[0], len(s)
                    held.append(own)
                    size += len(own)
                    if size > PACK:
                        yield from packed()
                        held, size = [], 0
        if held:
            yield from packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, common_ = _unpacked(batches, FIRST, FIRST)
        rows = rows[np.lexsort((rows["key"], rows["token"]))]
        rows = rows[_runs(rows["token"], rows["key"])[:-1]]  # the same set from several tasks
        cut = _runs(rows["token"])
        df = np.repeat(np.diff(cut), np.diff(cut))
        at = np.flatnonzero(df > 1)
        for own, number in ((rows[at], df[at]), (common_, MOST)):
            out = np.empty(len(own), COUNTED)
            for name in ("key", "token", "n"):
                out[name] = own[name]
            out["df"] = number
            yield from _packets(out, "key", packets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _ = _unpacked(batches, COUNTED, COUNTED)
        rows = rows[np.lexsort((rows["token"], rows["df"], rows["key"]))]
        rows = rows[_runs(rows["key"], rows["token"])[:-1]]  # a common element of the same set from several tasks
        cut = _runs(rows["key"])
        has = np.diff(cut)
        nth = np.arange(len(rows)) - np.repeat(cut[:-1], has)
        # the set and its partner share `least` of its first elements, so one of all but the last least - 1 of them,
        # counted from the rarest; those that no other set has are the rarest and left out already
        least = common(needed(rows["n"].astype(np.int64)))
        keep = rows[nth < np.repeat(has, has) - least + 1]
        out = np.empty(len(keep), MEET)
        out["token"], out["key"] = keep["token"], keep["key"]
        yield from _packets(out[keep["df"] < MOST], "token", packets)
        yield from _packets(out[keep["df"] == MOST], "key", packets, COMMON)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, common_ = _unpacked(batches, MEET, MEET)
        rows = rows[np.lexsort((rows["key"], rows["token"]))]
        cut = _runs(rows["token"])
        pairs = np.stack([np.repeat(rows["key"][cut[:-1]], np.diff(cut)), rows["key"]], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        nodes = np.stack([common_["token"].view(np.int64), common_["key"]], axis=1)  # such an element is a node itself
        pairs = np.concatenate([pairs, nodes])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    def exchange(df: DataFrame, function: Callable, schema: str) -> DataFrame:
        return df.repartition(parts, "p").mapInArrow(function, schema)

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = texts.mapInArrow(first, PACKET)
    return components(exchange(exchange(exchange(packed, count, PACKET), choose, PACKET), tie, "a long, b long"))


def _joined(blocks: DataFrame, *keys: str) -> DataFrame:
    """a, b: the links that a tree finds in each group of rows (keys, sig, root, shingles); root is what is known of sig's component."""

    def join(table: pa.Table) -> pa.Table:
        own = {s: (x, r) for s, x, r in zip(*(table.column(c).to_pylist() for c in ("sig", "shingles", "root")), strict=True)}
        names = sorted(own)
        pairs = LinkTrie([np.frombuffer(own[s][0], np.uint64) for s in names], PERCENT, [own[s][1] for s in names]).links()
        return pa.table({"a": pa.array([names[a] for a, _ in pairs], pa.binary()), "b": pa.array([names[b] for _, b in pairs], pa.binary())})

    return blocks.select(*keys, "sig", "root", "shingles").groupBy(*keys).applyInArrow(join, "a binary, b binary")


def _up_to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _blocks(elements: Column, block: int, sets: int) -> Column:
    """How many blocks rows make."""
    return F.greatest(F.ceil(F.sum(elements) / block), F.ceil(F.count(F.lit(1)) / sets)).cast("int")


def _dealt(rows: DataFrame, block: int, sets: int) -> DataFrame:
    """rows with cluster, sig and shingles, and with the number of blocks of their cluster and the one they are in, stored."""
    large = rows.groupBy("cluster").agg(_blocks(F.octet_length("shingles") / 8, block, sets).alias("blocks")).where("blocks > 1")
    out = lookup_join(rows, stored(large), "cluster").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return stored(out.withColumn("at", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))


def refined(rows: DataFrame) -> DataFrame:
    """cluster, sig, shingles of rows of clusters, with clusters taken apart; a set that can't link to any is left out.

    All elements of the sets are counted within their cluster, which Spark does in part before it shuffles. A set has no
    partner if fewer of its elements are shared than a partner must have of them. Otherwise, in the order of the exact
    counts, it shares with any partner one of its n - needed(n) + 1 rarest elements: sets that have such an element in
    common stay together. A passage that many documents share, but which doesn't make them alike, ties none of them.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for cluster, node, raw in zip(batch.column("cluster").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8")
                for a in range(0, len(own), PACK):
                    part = own[a : a + PACK]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), v)) for v in (cluster, node, len(own))), pa.array(part)], names=["cluster", "node", "n", "token"])

    rows = rows.dropDuplicates(["sig"]).withColumn("node", F.xxhash64("sig"))
    elements = rows.select("cluster", "node", "shingles").mapInArrow(explode, "cluster long, node long, n long, token long")
    counts = elements.groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("cluster", "node")
    shared = elements.join(counts, ["cluster", "token"]).select("*", F.count(F.lit(1)).over(own).alias("shared"), F.row_number().over(own.orderBy("df", "token")).alias("nth"))
    least = F.ceil(F.col("n") * PERCENT / 100)
    keep = shared.where((F.col("shared") >= least) & (F.col("n") - F.col("shared") + F.col("nth") <= F.col("n") - least + 1))
    comps = components(keep.select(F.xxhash64("cluster", "token").alias("a"), F.col("node").alias("b")))
    return rows.drop("cluster").join(comps.withColumnRenamed("root", "cluster"), "node").select("cluster", "sig", "shingles")


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str, text_col: str, block: int = BLOCK, most_sets: int = SETS) -> DataFrame:
    """a, b: signatures of classes that link, enough of them to connect all that links connect.

    A cluster of at most `block` elements and `most_sets` sets is one tree. A larger one is taken apart by refined(), and what
    is still larger is dealt into blocks. First each block meets one of them, which connects most of a cluster of many
    like sets. The sets outside its largest component, dealt into blocks of their own, then meet every block: two sets
    inside it are connected already, and any other two meet.
    """
    members = classes.join(clusters, F.col("key") == F.col("node")).select("sig", F.col("first.id").alias("id"), F.col("first.hash").alias("hash"), F.col("root").alias("cluster"))
    members = stored(members)
    bits = bitmap(members.select(F.xxhash64("id", "hash").alias("key")))
    texts = docs.select(F.col(id_col).cast("long").alias("tid"), F.xxhash64(text_col).alias("thash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = marked(texts, F.xxhash64("tid", "thash"), bits, "wanted").where("wanted")  # the others never move

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for lo, hi in groups(texts, CHARS):
                out += [s.tobytes() for s in shingle_sets(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("sig"), pa.array(out, pa.binary())], names=["cluster", "sig", "shingles"])

    own = members.join(texts, F.col("id").eqNullSafe(F.col("tid")) & (F.col("hash") == F.col("thash"))).select("cluster", "sig", "text")
    own = _dealt(own.mapInArrow(make, "cluster long, sig binary, shingles binary"), block, most_sets).withColumn("root", F.col("sig"))
    small, whole = own.where("blocks = 1"), own.where("blocks > 1")
    if whole.isEmpty():
        return _joined(small, "cluster")
    own = _dealt(refined(whole), block, most_sets).withColumn("root", F.col("sig"))
    found = _joined(small.unionByName(own.where("blocks = 1")), "cluster")
    whole = own.where("blocks > 1")
    if whole.isEmpty():
        return found

    one = whole.where("at > 0").withColumn("with", F.col("at")).unionByName(whole.where("at = 0").withColumn("with", _up_to(F.col("blocks"))))
    first = stored(_joined(one, "cluster", "with"))
    comps = components(first).select(F.col("node").alias("_sig"), F.col("root").alias("_root"))
    known = whole.drop("root").join(comps, F.col("sig") == F.col("_sig"), "left").withColumn("root", F.coalesce("_root", "sig")).drop("_sig", "_root")
    known = stored(known)
    sizes = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles") / 8).alias("elements"))
    most = stored(sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("most")))
    outside = lookup_join(known, most, "cluster", "inner").where(F.col("root") != F.col("most"))
    rest = stored(outside.groupBy("cluster").agg(F.first("most").alias("most"), _blocks(F.octet_length("shingles") / 8, block, most_sets).alias("rest")))
    known = lookup_join(known, rest, "cluster", "inner")
    outside = known.where(F.col("root") != F.col("most")).withColumn("u", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("rest")).cast("int")).withColumn("at", _up_to(F.col("blocks")))
    every = known.withColumn("u", _up_to(F.col("rest")))
    return found.unionByName(first).unionByName(_joined(every.unionByName(outside), "cluster", "u", "at"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most_sets: int = SETS) -> DataFrame:
    """For each row of docs: row, id, hash (xxhash64 of the text), n_shingles, component_id, kept.

    Texts link when PERCENT of the union of their shingle sets is common to both; component_id is the smallest id that
    links reach. Null and empty texts and those without words have no shingles and are alone. Of a component one row is
    kept, with the smallest id (null is the smallest), and the first of rows that repeat it. Shingles are compared by
    64-bit hashes and sets by 128-bit ones. Extra columns are not read; an empty table gives no rows.
    """
    expose(docs.sparkSession)
    rows, hot = scan(docs, id_col, text_col)
    full = rows.where("n > 0")
    classes = stored(full.groupBy("sig").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.min(F.struct("id", "row", "hash")).alias("first"), F.min("id").alias("least")))
    comps = components(links(docs, classes, candidates(docs, text_col, rows, hot), id_col, text_col, block, most_sets))

    named = classes.join(comps, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), F.struct("first.id", "first.row").alias("first"), "least")
    salted = stored(named.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS))))
    part = salted.groupBy("root", "salt").agg(F.min("first").alias("first"), F.min("least").alias("least"))
    whole = part.groupBy("root").agg(F.min("first").alias("keep"), F.min("least").alias("component_id"))
    spread = part.select("root", "salt").join(whole, "root")
    of_class = salted.select("sig", "root", "salt").join(spread, ["root", "salt"]).select("sig", F.col("keep.row").alias("keep_row"), "component_id")

    salted_rows = full.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    spread_rows = salted_rows.select("sig", "salt").distinct().join(of_class, "sig")  # at most SALTS rows for a class of any size
    out = salted_rows.join(spread_rows, ["sig", "salt"]).select("row", "id", "hash", "n", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))
    alone = rows.where("n = 0").select("row", "id", "hash", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles").withColumnRenamed("id", id_col)


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep, all columns as they are.

    Rows that lost set the bits of their id and text; rows whose bit is clear pass without a shuffle, and of the others
    those stay that are kept rows.
    """
    rows = stored(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "hash", "kept"))
    at = F.xxhash64("id", "hash")
    bits = bitmap(rows.where("not kept").select(at.alias("key")))
    keys = marked(rows.where("kept"), at, bits, "near").where("near").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    found = marked(packed, at, bits, "near")
    several = found.where("near")
    wins = several.join(keys, several["id"].eqNullSafe(keys["_id"]) & (several["hash"] == keys["_hash"]), "left_semi").dropDuplicates(["id", "hash"])
    return found.where("not near").select("doc.*").unionByName(wins.select("doc.*"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT * FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shared a JOIN shared b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id)::BIGINT AS component_id,
  coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
