"""Heaviest paths of partial-order graphs as tables of nodes and edges, of all sets at once.

A node's best edge is one of its heaviest, so only nodes with several of those need scores to choose. All others hang from
their predecessor at once; each round, every node jumps to what its ancestor hangs from, with the weight and length up to
there, and a node that still has to choose does so when its candidates hang from the same ancestor, whose own score doesn't
matter then. So the rounds grow with the logarithm of the longest chain and with how deep choices are nested, not with
the order's length. A round is a Parquet table in a shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

NODE = ["set_id", "v"]
#: What a chain of predecessors ends at when nothing is open along it.
DONE = -1


class _Rounds:
    """Tables in a folder, one for each round."""

    def __init__(self, folder: str):
        self.folder, self.n = folder, 0

    def store(self, df: DataFrame, left: Column | None = None) -> tuple[DataFrame, int]:
        """df written and read again, and for how many of its rows `left` holds."""
        self.n += 1
        path, seen = f"{self.folder}/table={self.n}", Observation()
        if left is not None:
            df = df.observe(seen, F.count_if(left).alias("n"))
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("n", 0) if left is not None else 0  # an empty plan may leave no count


def _as(df: DataFrame, node: str, *columns: str) -> DataFrame:
    """df with its node as `node`, its set and some of its columns, marked."""
    return df.select("set_id", F.col("v").alias(node), *(F.col(c).alias(f"_{c}") for c in columns))


def _relaxed(work: DataFrame, edges: DataFrame, rounds: _Rounds) -> DataFrame:
    """work with pred, score and len worked out anew where `again` holds, over edges from nodes that aren't shut.

    work: set_id, v, place, sink, shut, again, pred, score, len. Nodes where `again` doesn't hold keep what they have."""
    into = edges.join(_as(work.where(~F.col("shut")), "src"), ["set_id", "src"], "left_semi").join(_as(work.where("again"), "dst"), ["set_id", "dst"], "left_semi")
    most = into.groupBy("set_id", "dst").agg(F.max("weight").alias("weight"))
    into, _ = rounds.store(into.join(most, ["set_id", "dst", "weight"]))
    first = into.groupBy("set_id", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("_src"), F.min("weight").alias("_w"))
    ties = into.join(first.where("_n > 1").select("set_id", F.col("v").alias("dst")), ["set_id", "dst"], "left_semi")
    n, lone = F.coalesce("_n", F.lit(0)), F.col("_n") == 1
    root = F.when(~F.col("again") | (n == 0), F.lit(DONE)).when(lone, F.col("_src")).otherwise(F.col("v"))
    anew = lambda old, none, one: F.when(~F.col("again"), F.col(old)).when(n == 0, none).when(lone, one).otherwise(F.lit(0))
    state = work.join(first, NODE, "left").select(
        *NODE, "place", "sink", "shut", "again", F.when(~F.col("again"), F.col("pred")).when(n == 0, F.lit(-1)).when(lone, F.col("_src")).cast("bigint").alias("pred"),
        anew("score", F.lit(0), F.col("_w")).cast("bigint").alias("score"), anew("len", F.lit(1), F.lit(1)).cast("int").alias("len"), root.cast("bigint").alias("root"))
    state, left = rounds.store(state, F.col("root") != DONE)
    while left:
        # what hangs from nothing open meets nobody, under a key of its own, so that no key is frequent
        key = F.when(F.col("root") == DONE, -1 - F.col("v")).otherwise(F.col("root"))
        up = _as(state, "_at", "root", "score", "len").where(F.col("_root") != F.col("_at"))
        jumped = state.withColumn("_at", key).join(up, ["set_id", "_at"], "left").drop("_at")
        jumped = jumped.select(*NODE, "place", "sink", "shut", "again", "pred", (F.col("score") + F.coalesce("_score", F.lit(0))).alias("score"), (F.col("len") + F.coalesce("_len", F.lit(0))).cast("int").alias("len"), F.coalesce("_root", "root").alias("root"))
        rivals = ties.join(_as(state, "src", "root", "score", "len"), ["set_id", "src"])
        best = F.max_by(F.struct("src", "_root", (F.col("_score") + F.col("weight")).alias("score"), (F.col("_len") + 1).alias("len")), F.struct("_score", "pred_ord"))
        chosen = rivals.groupBy("set_id", F.col("dst").alias("v")).agg(F.min("_root").alias("_a"), F.max("_root").alias("_b"), best.alias("_x")).where("_a = _b").select(*NODE, "_x")
        open_ = F.col("pred").isNull() & F.col("_x").isNotNull()
        pick = lambda new, old: F.when(open_, F.col(new)).otherwise(F.col(old))
        state, left = rounds.store(
            jumped.join(chosen, NODE, "left").select(
                *NODE, "place", "sink", "shut", "again", pick("_x.src", "pred").cast("bigint").alias("pred"), pick("_x.score", "score").cast("bigint").alias("score"),
                pick("_x.len", "len").cast("int").alias("len"), pick("_x._root", "root").cast("bigint").alias("root")),
            F.col("root") != DONE)
    return state.drop("root")


def _shut(work: DataFrame, edges: DataFrame, rounds: _Rounds) -> DataFrame:
    """work with those nodes shut as well that are worked out again and have no way in but from shut ones."""
    closed = -1
    while True:
        work, n = rounds.store(work, F.col("shut"))
        if n == closed:
            return work
        closed = n
        none = edges.join(_as(work, "src", "shut"), ["set_id", "src"]).groupBy("set_id", F.col("dst").alias("v")).agg(F.bool_and("_shut").alias("_none"))
        work = work.join(none, NODE, "left").withColumn("shut", F.col("shut") | F.col("again") & F.coalesce("_none", F.lit(False))).drop("_none")


def _best_ways(nodes: DataFrame, edges: DataFrame, rounds: _Rounds) -> tuple[DataFrame, DataFrame]:
    edges, _ = rounds.store(edges.where(F.col("set_id").isNotNull()).select("set_id", *(F.col(c).cast("bigint").alias(c) for c in ("src", "dst", "pred_ord", "weight"))))
    v = nodes.where(F.col("set_id").isNotNull()).select("set_id", F.col("node_id").cast("bigint").alias("v"), F.col("topo_idx").cast("bigint").alias("place"))
    leaving = edges.select("set_id", F.col("src").alias("v"), F.lit(False).alias("_sink")).distinct()
    none = F.lit(None)
    work = v.join(leaving, NODE, "left").select(*NODE, "place", F.coalesce("_sink", F.lit(True)).alias("sink"), F.lit(False).alias("shut"), F.lit(True).alias("again"), none.cast("bigint").alias("pred"), none.cast("bigint").alias("score"), none.cast("int").alias("len"))
    work, _ = rounds.store(work)
    return _relaxed(work, edges, rounds), edges


def best_ways(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """set_id, node_id, hp_score, hp_pred (-1: none), hp_len of each node: the best way to it, before branches are completed.

    nodes: set_id, node_id, topo_idx (an order along the edges); edges: set_id, src, dst, pred_ord, weight, as multiple.graph_nodes()
    and graph_edges() give them. The heaviest edge into a node wins; of equal ones that whose node scores most, then the one
    of the highest pred_ord, which must differ among the edges of a node. Extra columns are not read, empty tables give no rows,
    rows without a set_id are left out; node_id must differ within a set and edges must not repeat nor form a cycle.
    `folder` is new and shared by all executors.
    """
    return _best_ways(nodes, edges, _Rounds(folder))[0].select("set_id", F.col("v").alias("node_id"), F.col("score").alias("hp_score"), F.col("pred").cast("int").alias("hp_pred"), F.col("len").alias("hp_len"))


def _completed(state: DataFrame, edges: DataFrame, rounds: _Rounds) -> DataFrame:
    """Where the best node of a set is no sink, rivals of lower score that lead to its successors are shut out and what comes
    after it is worked out again, until the best one is a sink. All sets that need it take a step at a time."""
    high = F.struct("score", "place")
    name = F.struct("v", "score", "place", "sink")
    ready, tops = [], state.groupBy("set_id").agg(F.max_by(name, high).alias("top"))
    while True:
        tops, left = rounds.store(tops, ~F.col("top.sink"))
        going = tops.where("NOT top.sink")
        ready.append(state.join(tops.where("top.sink"), "set_id", "left_semi"))
        if not left:
            break
        own = edges.join(going, "set_id")
        after = own.where(F.col("src") == F.col("top.v")).select("set_id", F.col("dst").alias("v"))
        scored = _as(state, "src", "score")
        rivals = own.where(F.col("src") != F.col("top.v")).join(after.withColumnRenamed("v", "dst"), ["set_id", "dst"], "left_semi").join(scored, ["set_id", "src"])
        rivals = rivals.where((F.col("_score") > 0) & (F.col("_score") < F.col("top.score"))).select("set_id", F.col("src").alias("v")).distinct()
        work = state.join(going, "set_id").join(after.withColumn("_after", F.lit(True)), NODE, "left").join(rivals.withColumn("_rival", F.lit(True)), NODE, "left")
        shut, near = F.col("shut") | F.coalesce("_rival", F.lit(False)), F.coalesce("_after", F.lit(False))
        work = work.withColumn("shut", shut).withColumn("again", (F.col("place") > F.col("top.place")) & (near | ~F.col("shut"))).withColumn("shut", F.col("shut") & ~F.col("again"))
        work = _shut(work.select(*state.columns), edges.join(going, "set_id", "left_semi"), rounds)
        state = _relaxed(work, edges.join(going, "set_id", "left_semi"), rounds)
        found = state.join(going, "set_id").join(after.withColumn("_after", F.lit(True)), NODE, "left")
        later = (F.col("place") > F.col("top.place")) & ~F.col("shut") & (F.col("score") > F.col("top.score"))
        best = lambda where: F.max_by(F.when(where, name), F.when(where, high))
        tops = found.groupBy("set_id").agg(F.coalesce(best(later), best(F.col("_after"))).alias("top"))
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out


def heaviest_path(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """best_ways() after branches are completed, with on_path: whether the node is on its set's heaviest path to a sink.

    Sets take part in further rounds until their best node is a sink; the path ends at the first in order of the best
    sinks and is found backwards by doubling distances. Inputs, ties and empty tables as in best_ways().
    """
    rounds = _Rounds(folder)
    state, _ = rounds.store(_completed(*_best_ways(nodes, edges, rounds), rounds))
    rank = F.struct(F.when(F.col("shut"), -F.col("score")).otherwise(F.col("score")), -F.col("place"))
    ends = state.where("sink").groupBy("set_id").agg(F.max_by("v", rank).alias("v")).withColumn("on", F.lit(True))
    back, left = rounds.store(state.join(ends, NODE, "left").select(*NODE, F.col("pred").alias("up"), F.coalesce("on", F.lit(False)).alias("on")), F.col("up") >= 0)
    while left:
        marked = back.where(F.col("on") & (F.col("up") >= 0)).select("set_id", F.col("up").alias("v")).distinct().withColumn("_new", F.lit(True))
        key = F.when(F.col("up") < 0, -1 - F.col("v")).otherwise(F.col("up"))
        jumped = back.withColumn("_at", key).join(_as(back, "_at", "up"), ["set_id", "_at"], "left").join(marked, NODE, "left")
        back, left = rounds.store(jumped.select(*NODE, F.coalesce("_up", F.lit(DONE)).alias("up"), (F.col("on") | F.coalesce("_new", F.lit(False))).alias("on")), F.col("up") >= 0)
    return state.join(back, NODE).select("set_id", F.col("v").alias("node_id"), F.col("score").alias("hp_score"), F.col("pred").cast("int").alias("hp_pred"), F.col("len").alias("hp_len"), F.col("on").alias("on_path"))


def consensus(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """set_id and consensus: the bases along each set's heaviest path. nodes has base as well."""
    on = heaviest_path(nodes, edges, folder).where("on_path").select("set_id", "node_id")
    path = F.array_sort(F.collect_list(F.struct("topo_idx", "base")))
    return nodes.select("set_id", "node_id", "topo_idx", "base").join(on, ["set_id", "node_id"]).groupBy("set_id").agg(F.array_join(F.transform(path, lambda x: x["base"]), "").alias("consensus"))
