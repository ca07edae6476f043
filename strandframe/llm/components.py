"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of edges (a, b); root is the smallest node of its component.

    Each round takes every node to the smallest of itself and its neighbours and renames the edges, which leaves at most
    half of the names in a component of several. The smallest neighbour is a combined aggregation; the joins that
    rename have one row for each node on one side, so a node with many edges is split by adaptive execution. All rounds
    are stored, and names are composed from the first round to the last.
    """
    edges = stored(edges.where("a <> b").distinct())
    names: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        names.append(to)
        a, b = (to.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
        renamed = edges.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb"))
        edges = stored(renamed.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not names:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = names[0]
    for to in names[1:]:
        t = to.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = stored(out.join(t, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
    return out
