"""Progressive partial-order alignment of sets of sequences in a table."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import poa
from ..functions.hof import symbols
from ..scheme import DEFAULT, ScoringScheme

FIELDS = {
    "rows": "array<struct<seq_idx:int,name:string,row:string>>",
    "consensus": "string",
    "nodes": "array<struct<node_id:int,base:string,ring_id:int,topo_idx:int,column:int,seq_ids:array<int>,hp_score:bigint,hp_pred:int,hp_len:int>>",
    "edges": "array<struct<src:int,dst:int,pred_ord:int,weight:int>>",
    "rounds": "array<struct<round:int,nodes_before:int,end_score:bigint,nodes_added:int>>",
}


def _rows(found: poa.Alignment, names: pd.Series) -> list[dict]:
    return [{"seq_idx": i, "name": n, "row": r} for i, (n, r) in enumerate(zip(names, found.rows, strict=True))]


def _nodes(found: poa.Alignment) -> list[dict]:
    g, (score, pred, length) = found.graph, found.scores
    ring = {v: min(r) for r in g.rings for v in r}
    place = {v: i for i, v in enumerate(found.order)}
    return [{"node_id": v, "base": c, "ring_id": ring[v], "topo_idx": place[v], "column": found.column[v], "seq_ids": g.passing[v], "hp_score": score[v], "hp_pred": pred[v], "hp_len": length[v]} for v, c in enumerate(g.symbols)]


def _edges(found: poa.Alignment) -> list[dict]:
    return [{"src": u, "dst": v, "pred_ord": k, "weight": w} for v, b in enumerate(found.graph.before) for k, (u, w) in enumerate(b.items())]


def _rounds(found: poa.Alignment) -> list[dict]:
    return [{"round": i, "nodes_before": a, "end_score": s, "nodes_added": n} for i, (a, s, n) in enumerate(found.rounds, 1)]


def progressive(df: DataFrame, group: str = "set_id", order: str = "seq_idx", sequence: str = "sequence", name: str | None = None, scheme: ScoringScheme = DEFAULT, fields: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """One row for each set: of its rows, consensus, graph nodes and edges, and rounds the fields that are asked for.

    Sequences join in ascending `order`, which must be given because the result depends on it; equal ones in the order of
    the strings. Null sequences are left out. A set is one task, as its graph grows by one sequence after another; many
    sets run side by side. The views below take what they need of it.
    """
    fields = list(fields)
    kind = T._parse_datatype_string(", ".join(f"{f} {FIELDS[f]}" for f in fields))
    schema = T.StructType([T.StructField("set_id", df.schema[group].dataType), *kind.fields])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "s"], kind="stable")
        found = poa.progressive(pdf["s"].tolist(), scheme)
        make = {"rows": lambda: _rows(found, pdf["n"]), "consensus": lambda: found.consensus, "nodes": lambda: _nodes(found), "edges": lambda: _edges(found), "rounds": lambda: _rounds(found)}
        return pd.DataFrame({"set_id": [key[0]], **{f: [make[f]()] for f in fields}})

    d = df.select(F.col(group).alias("set_id"), F.col(order).alias("o"), F.col(sequence).alias("s"), (F.col(name) if name else F.lit(None)).cast("string").alias("n")).where(F.col("s").isNotNull())
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given outright: by their bytes, all sets would be one task's
    return d.repartition(parts, "set_id").groupBy("set_id").applyInPandas(run, schema)


def _view(sets: DataFrame, field: str) -> DataFrame:
    return sets.select("set_id", F.explode(field).alias("_x")).select("set_id", "_x.*")


def msa_rows(sets: DataFrame) -> DataFrame:
    """set_id, seq_idx, name, row: the gapped rows, all of one length in a set."""
    return _view(sets, "rows")


def msa_consensus(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", "consensus")


def graph_nodes(sets: DataFrame) -> DataFrame:
    return _view(sets, "nodes")


def graph_edges(sets: DataFrame) -> DataFrame:
    return _view(sets, "edges")


def rounds(sets: DataFrame) -> DataFrame:
    return _view(sets, "rounds")


def seed_nodes(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The graph of a first sequence: key, node_id (from 0), base."""
    at = F.posexplode(symbols(F.col(sequence)))
    return df.select(key, at.alias("node_id", "base"))


def seed_edges(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The chain of a first sequence: key, src, dst, weight 1."""
    n = F.char_length(sequence)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.explode(steps).alias("dst")).select(key, (F.col("dst") - 1).alias("src"), "dst", F.lit(1).alias("weight"))


def sinks(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that no edge leaves."""
    e = edges.select(F.col(key).alias("_k"), F.col("src").alias("_s"))
    return nodes.join(e, (nodes[key] == e["_k"]) & (nodes["node_id"] == e["_s"]), "left_anti")
