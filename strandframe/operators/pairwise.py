"""Global alignment of pairs of strings in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow, banded, hof
from ..scheme import DEFAULT, ScoringScheme

#: Rows of a block of all_pairs().
PAIR_ROWS = 500


def score_pairs(df: DataFrame, a: str = "a", b: str = "b", scheme: ScoringScheme = DEFAULT, method: str = "arrow", at_least: int | None = None) -> DataFrame:
    """df with global_score and max_cell_score.

    method: arrow (any length), catalyst (short strings, no Python), banded (long strings that differ little, exact always;
    no max_cell_score), or edit for the scheme whose score is the negated Levenshtein distance, which has none either. at_least keeps pairs that score so much, after a filter on their
    lengths that Catalyst can push below the kernel. No traceback is ever computed here.
    """
    x, y = F.col(a), F.col(b)
    if at_least is not None:
        df = df.where(hof.upper_bound(x, y, scheme) >= at_least)
    if method == "edit":
        if not scheme.is_edit_distance:
            raise ValueError("this scheme isn't an edit distance")
        out = df.withColumn("global_score", hof.edit_score(x, y))
    elif method == "banded":
        out = df.withColumn("global_score", banded.scores(x, y, scheme)["global_score"])
    elif method in ("arrow", "catalyst"):
        score = arrow.scores(x, y, scheme, once=at_least is not None) if method == "arrow" else hof.scores(x, y, scheme)
        d = df.withColumn("_s", score)
        out = d.withColumns({"global_score": F.col("_s.global_score"), "max_cell_score": F.col("_s.max_cell_score")}).drop("_s")
    else:
        raise ValueError("method must be arrow, catalyst, banded or edit")
    return out if at_least is None else out.where(F.col("global_score") >= at_least)


def all_pairs(df: DataFrame, key: str, rows: int = PAIR_ROWS) -> DataFrame:
    """Each two rows of df once, the one with the smaller key first: columns x and y, structs of df's columns. Rows of equal
    keys are no pair.

    Rows are dealt into blocks of about `rows`, and each two blocks meet in an equi-join, so that no side is broadcast
    and no task holds more than two blocks; a row is sent as often as there are blocks.
    """
    blocks = max(1, -(-df.count() // rows))
    own = df.select(F.struct(*df.columns).alias("_r"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    meet = lambda name, first, last: own.select(F.col("_r").alias(name), "_b", F.explode(F.sequence(first, last)).alias("_c"))
    x = meet("x", F.col("_b"), F.lit(blocks - 1)).select("x", F.col("_b").alias("_i"), F.col("_c").alias("_j"))
    y = meet("y", F.lit(0), F.col("_b")).select("y", F.col("_c").alias("_k"), F.col("_b").alias("_l"))
    met = x.join(y.hint("shuffle_hash"), (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l")))
    small, large = F.least(f"x.{key}", f"y.{key}"), F.col(f"x.{key}") < F.col(f"y.{key}")
    met = met.where((F.col(f"x.{key}") != F.col(f"y.{key}")) & ((F.col("_i") < F.col("_j")) | (F.col(f"x.{key}") == small)))
    return met.select(F.when(large, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(large, F.col("y")).otherwise(F.col("x")).alias("y"))


def align_pairs(df: DataFrame, a: str = "a", b: str = "b", scheme: ScoringScheme = DEFAULT, method: str = "arrow") -> DataFrame:
    """df with global_score, max_cell_score, swapped, row_a, row_b and ops; rows are given for a and b as they came.

    method: arrow (any length) or catalyst (short strings, no Python); both find the same alignment.
    """
    if method not in ("arrow", "catalyst"):
        raise ValueError("method must be arrow or catalyst")
    d = df.withColumn("_s", (arrow if method == "arrow" else hof).aligned(F.col(a), F.col(b), scheme))
    return d.withColumns({k: F.col(f"_s.{k}") for k in ("global_score", "max_cell_score", "swapped", "row_a", "row_b", "ops")}).drop("_s")


def rescored(ops: Column, scheme: ScoringScheme = DEFAULT) -> Column:
    """The score of an alignment from its operations, in Catalyst: pairs by their kind and a gap's opening where one begins."""
    count = lambda c: F.char_length(ops) - F.char_length(F.translate(ops, c, ""))
    gaps = count("D") + count("I")
    opened = F.regexp_count(ops, F.lit("D+")) + F.regexp_count(ops, F.lit("I+"))
    return (count("=") * scheme.match + count("X") * scheme.mismatch + gaps * scheme.gap_extend + opened * scheme.gap_open).cast("bigint")


def alignment_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each column of each alignment: keys, column (from 1), symbol_a, symbol_b, op."""
    at = F.posexplode(F.arrays_zip(hof.symbols(F.col("row_a")).alias("a"), hof.symbols(F.col("row_b")).alias("b"), hof.symbols(F.col("ops")).alias("op")))
    d = df.select(*keys, at.alias("_i", "_c"))
    return d.select(*keys, (F.col("_i") + 1).cast("bigint").alias("column"), F.col("_c.a").alias("symbol_a"), F.col("_c.b").alias("symbol_b"), F.col("_c.op").alias("op"))


def best_matches(df: DataFrame, key: str, k: int, ties: list[str]) -> DataFrame:
    """The k pairs of each key that score most, with rank; equal scores by the columns of ties. Spark keeps k rows of each
    key in every task before it shuffles."""
    w = Window.partitionBy(key).orderBy(F.desc("global_score"), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
