"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Everything is built-in DataFrame functions. The first level counts rows by length; the second hashes the first PREFIX
characters of rows whose length another row has, and counts (length, hash) pairs; the third hashes whole texts of rows
whose pair another row has. What repeats on a level becomes a bitmap as large as the number of repeated keys asks for, 16 MB
at most, which is broadcast to the next one's scan. A bit shared by chance costs a hash and changes nothing, because rows
are grouped by the hash of the whole text in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, bitmap, documents, lower_ascii, marked, stored

PREFIX = 64


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")  # lower-casing A-Z leaves it as it is


def _prefix(text: Column) -> Column:
    return F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX)))


def _sha(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def _repeated(rows: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Bitmaps of the keys that more than one row has; equal keys of a task are counted before they are shuffled."""
    return bitmap(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64(*keys).alias("key")))


class Levels:
    """The bitmaps of the first two levels over the column text of a table."""

    def __init__(self, texts: DataFrame):
        self.lengths = _repeated(texts.select(_length(F.col("text")).alias("len")), "len")
        self.pairs = _repeated(self.second(texts).where("pfx is not null").select("len", "pfx"), "len", "pfx")

    def second(self, texts: DataFrame) -> DataFrame:
        """texts with len and pfx, which is null where the length is the row's own."""
        d = marked(texts.withColumn("len", _length(F.col("text"))), F.xxhash64("len"), self.lengths, "_long")
        return d.withColumn("pfx", F.when(F.col("_long"), _prefix(F.col("text")))).drop("_long")

    def again(self, texts: DataFrame) -> DataFrame:
        """texts with a boolean column again: whether the row reaches the third level."""
        key = F.when(F.col("pfx").isNotNull(), F.xxhash64("len", "pfx"))
        return marked(self.second(texts), key, self.pairs, "again").drop("len", "pfx")


def _decisions(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> tuple[Levels, DataFrame]:
    """The first levels, and row, id, sha, keep_id, keep_row, size of every row of docs."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels = Levels(texts)
    sha = _sha(F.col("text"))
    rows = levels.again(texts)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "again", (sha if digest else F.when(F.col("again"), sha)).alias("sha"))
    rows = stored(rows)  # narrow; row numbers stay as they are from here on

    again = rows.where("again").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    part = again.groupBy("sha", "salt").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha").agg(F.max("best").alias("keep"), F.sum("n").alias("size"))
    spread = part.select("sha", "salt").join(whole, "sha")  # at most SALTS rows for a group of any size
    grouped = again.join(spread, ["sha", "salt"]).select("row", "id", "sha", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "size")
    alone = rows.where("not again").select("row", "id", "sha", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("size"))
    return levels, grouped.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so nulls and empty texts form one
    group. Of a group the row with the largest id stays; a null id is smaller than any other, and of rows that repeat an
    id and a text exactly one stays. Extra columns, whatever their names, are not read. An empty table gives no rows.
    text_sha256 is null for rows that never reached the third level, unless digest asks for it everywhere.
    """
    _, out = _decisions(docs, id_col, text_col, digest)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns as they are.

    Rows that don't reach the third level pass without a shuffle. The others meet the (id, hash) of the rows that stay, which
    is one row per group; of rows that repeat an id and a text each task keeps one before they are shuffled.
    """
    levels, out = _decisions(docs, id_col, text_col, digest=False)
    stay = stored(out.where("size > 1 and row = keep_row").select(F.col("id").alias("_id"), F.col("sha").alias("_sha")))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = levels.again(packed)
    several = found.where("again").withColumn("sha", _sha(F.col("text")))
    sole = out.where("size = 1 and sha is not null").select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))  # a bit shared by chance
    keys = stay.unionByName(sole)
    wins = several.join(keys, several[f"doc.{id_col}"].eqNullSafe(keys["_id"]) & (several["sha"] == keys["_sha"]), "left_semi")
    wins = wins.withColumn("_id", F.col(f"doc.{id_col}")).dropDuplicates(["_id", "sha"])
    return found.where("not again").select("doc.*").unionByName(wins.select("doc.*"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS sha FROM t)
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM h
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest=True)
