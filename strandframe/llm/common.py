"""Shared helpers of the corpus operators: session settings, durable intermediate tables, hot-key joins."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space, and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a lookup table may be broadcast; beyond it lookup_join() shuffles with salted keys.
BROADCAST_ROWS = 20_000
SALTS = 64


#: Rows and bytes of an Arrow batch at most, and characters of the texts that a Python function holds in pieces at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
BATCH_CHARS = 1 << 19
#: Settings of a worker's allocators: one arena, and what is freed goes back to the system.
FREEING = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def expose(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they share the driver's file system; ship it with --py-files elsewhere.

    Arrow batches get few rows and bytes, because texts can be long, unless the session sets its own; workers give memory
    back that they have freed. Every operator with a Python function calls this first.
    """
    for name, usual, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "256MB", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", usual) in (usual, str(256 << 20), f"{256 << 20}b"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(own))
    spark.sparkContext.environment.update(FREEING)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """An object that a worker keeps from task to task, such as a codec with its cache; another key takes its place."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what the worker keeps, and give back what is free: called first by functions that need none of it, which may run in the same worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the system's C library
        trim(0)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return expose(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


#: Folders of intermediate tables that this driver has made and not removed.
_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/strandframe-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _FOLDERS.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, stored, without the intermediate tables that it took: they are removed once it is written."""
    before = len(_FOLDERS)
    out = stored(make())
    own, done = _FOLDERS[-1], _FOLDERS[before:-1]
    _FOLDERS[before:] = [own]
    for path in done:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that on pure ASCII and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def groups(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with most characters or so; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def n_words(text: Column) -> Column:
    """Number of runs of non-white characters; 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"{WHITE}+", -1))).cast("long")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, mod k; a null doc_id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join on a key that may hold any share of big's rows (nulls match). small has one row per key and is stored already.

    small is broadcast only after its rows are counted and number at most limit; otherwise each of its rows is repeated
    for SALTS salts, and big's rows of one key spread over as many tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        s = small.withColumnRenamed(key, "_key")
        return big.join(F.broadcast(s), big[key].eqNullSafe(s["_key"]), how).drop("_key")
    s = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "_key")
    b = big.withColumn("_salt1", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return b.join(s, b[key].eqNullSafe(s["_key"]) & (b["_salt1"] == s["_salt2"]), how).drop("_key", "_salt1", "_salt2")


#: Bits of a bitmap of hashed keys: for each key so many, as a power of two, from the least to the most (16 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps of the column key, a 64-bit hash, in rows of 4 KB at most, and their bits together.

    The size follows from the number of keys. Beyond MOST_BITS it stays, and more rows are marked by chance; what marks
    are used for is to leave work out, so that changes no result.
    """
    keys = stored(keys.select("key"))
    bits = LEAST_BITS
    n = keys.count()
    while bits < min(MOST_BITS, KEY_BITS * n):
        bits *= 2
    at = F.pmod("key", F.lit(bits))
    return stored(keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))), bits


def marked(df: DataFrame, key: Column, of: tuple[DataFrame, int], name: str) -> DataFrame:
    """df with a boolean column: whether the bit of key is set; a null key's isn't. The bitmaps are broadcast, MOST_BITS at most."""
    rows, bits = of
    at = F.pmod(key, F.lit(bits))
    d = df.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_pos", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.col("_pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("_pos") % 8).cast("int")) == 1, F.lit(False))
    b = rows.select(F.col("bucket").alias("_b"), F.col("bits").alias("_bits"))
    return d.join(F.broadcast(b), F.col("_bucket") == F.col("_b"), "left").select(*df.columns, is_set.alias(name))


def bounded_rows(rows: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`most` rows at most, however long, in the order of a hash of the id, then the id and a hash of the text; rows that repeat
    both count once. What decides are `most` rows of a few numbers. rows is stored already and has no column of these names: _h, _t.
    """
    keyed = rows.withColumn("_h", F.xxhash64(id_col)).withColumn("_t", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    first = keyed.select("_h", F.col(id_col).alias("_i"), "_t").distinct().orderBy("_h", "_i", "_t").limit(most)
    chosen = stored(first.select("_i", F.col("_t").alias("_u")))
    found = keyed.join(F.broadcast(chosen), F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u")))
    return found.dropDuplicates([id_col, "_t"]).select(*rows.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold_of: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and _label of at most `most` rows of docs that have a label and for which fold_of holds, however long their texts.

    Which rows is fixed by a hash of the id. Of several labels of one id the highest counts. The ids, `most` rows of two
    numbers, are what is broadcast; a repeated id can't add rows beyond the bound. It is empty only if no row of docs has a label.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fold_of).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    ids = stored(ids.join(docs.select(F.col(id_col).alias("_own")).distinct(), F.col("_id") == F.col("_own"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(most))
    held = stored(docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select(id_col, text_col, "_label"))
    return bounded_rows(held, most, id_col, text_col)
