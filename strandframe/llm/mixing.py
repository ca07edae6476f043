"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets come from one table with a row for each source. Within a source every document is taken the whole number of
times that fits, and the rest of the target is filled with further documents in the order of md5(seed, id), of which the
last may be taken in part. The cumulative sizes in that order are never computed over a source at once: documents are
summed into the BUCKETS leading digits of their md5, the bucket in which the target ends is summed into the next digits,
and only the documents of that second bucket, a 16-millionth of a source, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lookup_join, n_words, stored

SEED = 20240601
EPOCHS = 3
WEIGHTS = (1, 2, 3)
DIGITS = 3  # hexadecimal digits of a bucket: 4096 buckets


def water_fill(sources: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from rows (source, source_size): shares of the total by weight, at most epochs * source_size.

    Sources in code point order, null last, weigh as weights repeat. With sources ordered by limit / weight, those that
    reach their limit come first; the level of the others is what is left over divided by their weights, which is what
    sharing the excess again and again ends in. The window runs over one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = sources.select("source", "source_size", (F.col("source_size") * epochs).alias("cap"), rank.alias("rank"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", left.cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min_by(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")), F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank"))).over(Window.partitionBy())
    s = s.withColumn("_level", level)
    full = F.col("_level").isNull() | (F.col("cap") / F.col("weight") <= F.col("_level"))
    return s.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("_level")).alias("target"))


def _ends(sums: DataFrame, need: str, bucket: str) -> DataFrame:
    """Of rows (source, bucket, size, need): the bucket in which need ends and the sum of those before it, if need ends in one."""
    w = Window.partitionBy("source").orderBy(bucket)
    c = sums.withColumn("_upto", F.sum("size").over(w))
    return c.where((F.col("_upto") - F.col("size") <= F.col(need)) & (F.col(need) < F.col("_upto"))).withColumn("_before", F.col("_upto") - F.col("size"))


def _key(id_col: Column, text: Column, seed: int) -> Column:
    """What orders documents: rows without an id take a hash of their text for it, so that they don't share one key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.xxhash64(text)))).cast("binary"))


def _lead() -> Column:
    return F.substring("key", 1, 2 * DIGITS)


def _mark() -> Column:
    return F.concat("end1", "end2")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size, hash (of the text), key, row of each row of docs, stored: the text is read once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"), _key(F.col(id_col), F.col(text_col), seed).alias("key"), F.monotonically_increasing_id().alias("row"))
    return stored(rows)


def _plan(rows: DataFrame, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """For each source its target, whole repetitions, the two buckets in which the rest ends and what it needs of the second."""
    b1, b2 = F.substring("key", 1, DIGITS), F.substring("key", 1 + DIGITS, DIGITS)
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long")
    targets = stored(targets.withColumn("whole", whole).withColumn("rest", rest))

    sums = rows.groupBy("source", b1.alias("b1")).agg(F.sum("size").alias("size"))
    first = _ends(lookup_join(sums, targets.select("source", "rest"), "source", "inner"), "rest", "b1")
    first = stored(first.select("source", "b1", (F.col("rest") - F.col("_before")).alias("need")))
    inside = lookup_join(rows.withColumn("at", b1), first.withColumnRenamed("b1", "end1"), "source", "inner").where("at = end1")
    second = _ends(inside.groupBy("source", "need", "end1", b2.alias("b2")).agg(F.sum("size").alias("size")), "need", "b2")
    ends = second.select(F.col("source").alias("_s"), "end1", F.col("b2").alias("end2"), (F.col("need") - F.col("_before")).alias("left"))
    return stored(targets.join(ends, targets["source"].eqNullSafe(ends["_s"]), "left").drop("_s"))


def _shares(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with their source's plan and extra, the words beyond whole repetitions: those of the last buckets, and the others."""
    all_rows = lookup_join(rows, plan, "source", "inner")
    upto = Window.partitionBy("source").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = all_rows.where(_lead() == _mark()).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left") - F.coalesce(F.sum("size").over(upto), F.lit(0)))))
    # without an end, the rest is 0: floor() leaves less than a whole source
    other = all_rows.where(_mark().isNull() | (_lead() != _mark())).withColumn("extra", F.when(_lead() < _mark(), F.col("size")).otherwise(F.lit(0).cast("long")))
    return last, other


def _copies() -> Column:
    return F.col("whole") + (F.col("extra") * 2 >= F.greatest("size", F.lit(1))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies (whole repetitions), taken (words, with the last repetition in part).

    A source's taken words are its rounded target, and no row exceeds epochs times its size. Null texts have size 0 and
    null sources are a source of their own. Rows that repeat an id stand next to each other in the order. copies counts a
    part of half the document or more as a whole one. An empty table gives no rows; extra columns are not read.
    """
    rows = _sizes(docs, id_col, text_col, source_col, seed)
    last, other = _shares(rows, _plan(rows, epochs, weights))
    out = last.unionByName(other)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _copies().alias("copies"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with each row as often as mix() has copies of it, whole texts and all columns as they are.

    Copies follow from the source's plan and the row's own key, so no text is shuffled but those of the last buckets.
    """
    rows = _sizes(docs, id_col, text_col, source_col, seed)
    plan = _plan(rows, epochs, weights)
    last, _ = _shares(rows, plan)
    edge = stored(last.groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash")).agg(F.sum(_copies()).alias("copies")))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"), _key(F.col(id_col), F.col(text_col), seed).alias("key"))
    own = lookup_join(packed, plan, "source", "inner")
    extra = F.when(_lead() < _mark(), F.col("size")).otherwise(F.lit(0).cast("long"))
    inner = own.where(_mark().isNull() | (_lead() != _mark())).withColumn("extra", extra).select("doc", _copies().alias("copies"))
    ends = own.where(_lead() == _mark()).dropDuplicates(["id", "hash"])
    ends = ends.join(edge, ends["id"].eqNullSafe(edge["_id"]) & (ends["hash"] == edge["_hash"])).select("doc", "copies")
    return inner.unionByName(ends).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


ORACLE = f"""
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('{SEED}:' || doc_id::VARCHAR) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
ranked AS (SELECT *, {EPOCHS} * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
weighed AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight FROM ranked),
levels AS (SELECT *, ((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
one AS (SELECT level FROM levels WHERE cap / weight > level ORDER BY cap / weight, rank LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN (SELECT level FROM one) IS NULL OR cap / weight <= (SELECT level FROM one) THEN cap::DOUBLE ELSE weight * (SELECT level FROM one) END AS target FROM levels),
reps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
cum AS (SELECT doc_id, rows_.source, size, source_size, target, whole, floor(target + 0.5)::BIGINT - whole * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY rows_.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows_ JOIN reps ON rows_.source IS NOT DISTINCT FROM reps.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM cum
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
