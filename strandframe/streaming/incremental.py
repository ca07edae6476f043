"""Progressive alignment over a stream: each set's graph is the state, and sequences join it as they come."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.poa import Graph, finish, grow
from ..scheme import DEFAULT, ScoringScheme


def pack(graph: Graph) -> bytes:
    """A graph as compressed JSON, which any version can read."""
    place = {id(r): k for k, r in enumerate({id(r): r for r in graph.rings}.values())}
    data = {"symbols": graph.symbols, "before": [list(b.items()) for b in graph.before], "after": [list(a) for a in graph.after], "rings": [place[id(r)] for r in graph.rings], "mates": graph.mates, "passing": graph.passing, "listing": graph.listing}
    return zlib.compress(json.dumps(data).encode())


def unpack(raw: bytes) -> Graph:
    data = json.loads(zlib.decompress(raw))
    rings: dict[int, list[int]] = {}
    for v, k in enumerate(data["rings"]):
        rings.setdefault(k, []).append(v)
    return Graph(data["symbols"], [dict(map(tuple, b)) for b in data["before"]], [dict.fromkeys(a) for a in data["after"]], [rings[k] for k in data["rings"]], data["mates"], data["passing"], data["listing"])


def incremental(df: DataFrame, group: str = "set_id", order: str = "seq_idx", sequence: str = "sequence", scheme: ScoringScheme = DEFAULT, idle: str = "none", timeout_ms: int = 0) -> DataFrame:
    """For each set of a micro-batch: set_id, n_sequences, n_nodes, weight (of all edges), end_score (of the last sequence),
    consensus, closed.

    Sequences of one micro-batch join in ascending `order`; later ones join after them, whatever their order says, as a
    graph can't be taken back. With idle="close" a set that gets nothing for timeout_ms of processing time gives a last
    row with closed and its state is dropped. Use with outputMode("update").
    """
    if idle not in ("none", "close"):
        raise ValueError("idle must be none or close")
    out = T.StructType.fromDDL("n_sequences int, n_nodes int, weight bigint, end_score bigint, consensus string, closed boolean")
    out = T.StructType([T.StructField("set_id", df.schema[group].dataType), *out.fields])
    names = out.fieldNames()
    weight = lambda g: sum(w for b in g.before for w in b.values())

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            raw, n = state.get
            graph = unpack(bytes(raw))
            state.remove()
            yield pd.DataFrame([(key[0], n, len(graph.symbols), weight(graph), None, finish(graph, n, []).consensus, True)], columns=names)
            return
        graph, n, score = Graph(), 0, None
        if state.exists:
            raw, n = state.get
            graph = unpack(bytes(raw))
        rows = pd.concat(list(batches)).sort_values([order, sequence], kind="stable")
        for s in rows[sequence].dropna():
            _, score, _ = grow(graph, s, n, scheme)
            n += 1
        state.update((pack(graph), n))
        if idle == "close":
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], n, len(graph.symbols), weight(graph), score, finish(graph, n, []).consensus, False)], columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle == "close" else GroupStateTimeout.NoTimeout
    return df.groupBy(group).applyInPandasWithState(run, out, "graph binary, n int", "update", timeout)
