"""Alignment in SQL text: scalar functions and table functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..scheme import DEFAULT, ScoringScheme
from . import poa
from .arrow import ALIGNED
from .kernels import align, score_batch


def register(spark: SparkSession, scheme: ScoringScheme = DEFAULT) -> None:
    """nw_score(a, b) and nw_max_cell(a, b): bigint; nw_align(a, b): a struct of scores, gapped rows and operations.

    Table functions, also with LATERAL: alignment_columns(row_a, row_b, ops), and msa_rows, poa_nodes, poa_edges of an
    array of strings, which are aligned in their order. Null arguments give null, or no rows.
    """

    def scored(which: int) -> object:
        @F.pandas_udf("bigint")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            known = (a.notna() & b.notna()).tolist()
            pairs = [p for p, k in zip(zip(a, b, strict=True), known, strict=True) if k]
            found = iter(score_batch(pairs, scheme)[which].tolist())
            return pd.Series([next(found) if k else None for k in known], dtype="Int64")

        return run

    @F.pandas_udf(ALIGNED)
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [align(x, y, scheme) if isinstance(x, str) and isinstance(y, str) else (None,) * 6 for x, y in zip(a, b, strict=True)]
        out = pd.DataFrame(rows, columns=["global_score", "max_cell_score", "swapped", "row_a", "row_b", "ops"])
        return out.astype({"global_score": "Int64", "max_cell_score": "Int64", "swapped": "boolean"})

    class Columns:
        def eval(self, row_a: str, row_b: str, ops: str) -> Iterator[tuple]:
            if row_a is not None and row_b is not None and ops is not None:
                yield from ((i, *c) for i, c in enumerate(zip(row_a, row_b, ops, strict=True), 1))

    class Rows:
        def eval(self, sequences: list) -> Iterator[tuple]:
            yield from enumerate(poa.progressive([s for s in sequences or [] if s is not None], scheme).rows)

    class Nodes:
        def eval(self, sequences: list) -> Iterator[tuple]:
            found = poa.progressive([s for s in sequences or [] if s is not None], scheme)
            yield from ((v, c, found.column[v], found.graph.passing[v]) for v, c in enumerate(found.graph.symbols))

    class Edges:
        def eval(self, sequences: list) -> Iterator[tuple]:
            graph = poa.progressive([s for s in sequences or [] if s is not None], scheme).graph
            yield from ((u, v, k, w) for v, b in enumerate(graph.before) for k, (u, w) in enumerate(b.items()))

    spark.udf.register("nw_score", scored(0))
    spark.udf.register("nw_max_cell", scored(1))
    spark.udf.register("nw_align", aligned)
    spark.udtf.register("alignment_columns", F.udtf(Columns, returnType="column int, symbol_a string, symbol_b string, op string"))
    spark.udtf.register("msa_rows", F.udtf(Rows, returnType="seq_idx int, row string"))
    spark.udtf.register("poa_nodes", F.udtf(Nodes, returnType="node_id int, base string, column int, seq_ids array<int>"))
    spark.udtf.register("poa_edges", F.udtf(Edges, returnType="src int, dst int, pred_ord int, weight int"))
