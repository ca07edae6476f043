"""Heaviest paths as tables against those worked out node by node."""

import random

from pyspark.sql import functions as F

from strandframe.functions import poa
from strandframe.operators import heaviest, multiple
from strandframe.plans import catalog

NODES = "set_id int, node_id int, topo_idx int, base string"
EDGES = "set_id int, src int, dst int, pred_ord int, weight int"


def random_graph(rng):
    """Edges between any nodes, of few different weights, so that ties and branches that end early are frequent."""
    g = poa.Graph()
    n = rng.randint(1, 24)
    for _ in range(n):
        g.add(rng.choice("ACGT"))
    for v in range(1, n):
        for u in rng.sample(range(v), min(v, rng.choice([0, 1, 1, 2, 3]))):
            g.before[v][u] = rng.choice([1, 1, 2, 9])
            g.after[u][v] = None
    return g, list(range(n))


def frames(spark, graphs):
    nodes = [(s, v, i, g.symbols[v]) for s, (g, order) in enumerate(graphs) for i, v in enumerate(order)]
    edges = [(s, u, v, k, w) for s, (g, _) in enumerate(graphs) for v, b in enumerate(g.before) for k, (u, w) in enumerate(b.items())]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def compare(spark, graphs, tmp_path):
    nodes, edges = frames(spark, graphs)
    got = {(r.set_id, r.node_id): r for r in heaviest.heaviest_path(nodes, edges, str(tmp_path / "h")).collect()}
    text = dict(heaviest.consensus(nodes, edges, str(tmp_path / "c")).collect())
    assert len(got) == sum(len(order) for _, order in graphs)
    for s, (g, order) in enumerate(graphs):
        path, score, pred, length = poa.heaviest_path(g, order)
        for v in order:
            r = got[s, v]
            assert (r.hp_score, r.hp_pred, r.hp_len, r.on_path) == (score[v], pred[v], length[v], v in path), (s, v)
        assert text[s] == "".join(g.symbols[v] for v in path)


def completed(g, order):
    """Whether the best node of the first pass is no sink."""
    score = {}
    for v in order:
        best = max(((w, score[p], k, p) for k, (p, w) in enumerate(g.before[v].items())), default=None)
        score[v] = best[1] + best[0] if best else 0
    return bool(g.after[max(order, key=lambda v: (score[v], v))])


def test_random_graphs(spark, tmp_path):
    rng = random.Random(4)
    graphs = [random_graph(rng) for _ in range(400)]
    assert sum(completed(g, order) for g, order in graphs) > 40
    compare(spark, graphs, tmp_path)


def test_alignments_with_gaps(spark, tmp_path):
    rng, graphs = random.Random(8), []
    for _ in range(25):
        base = "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 120)))
        noisy = lambda s: "".join(rng.choice(["", c + c, rng.choice("ACGT")]) if rng.random() < 0.2 else c for c in s)
        found = poa.progressive([noisy(base) for _ in range(rng.randint(1, 6))])
        graphs.append((found.graph, found.order))
    compare(spark, graphs, tmp_path)


def test_long_chain_of_branches_takes_few_rounds(spark, tmp_path):
    """1,500 branches of equal weight one after the other: 4,500 nodes, each choice below all earlier ones."""
    g = poa.Graph()
    last = g.add("A")
    for i in range(1500):
        a, b, end = g.add("C"), g.add("G"), g.add("A")
        for u, v in ((last, a), (last, b), (a, end), (b, end)):
            g.link(u, v)
        last = end
    compare(spark, [(g, list(range(len(g.symbols))))], tmp_path)
    assert len(list((tmp_path / "h").iterdir())) < 45


def test_edge_cases(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(1, 0, 0, "A"), (None, 0, 0, "C")], NODES), spark.createDataFrame([], EDGES)
    extra = nodes.withColumn("score", F.lit("x")).withColumn("v", F.lit(7)).withColumn("shut", F.lit(1))
    assert [tuple(r) for r in heaviest.heaviest_path(extra, edges.withColumn("root", F.lit(1)), str(tmp_path / "a")).collect()] == [(1, 0, 0, -1, 1, True)]
    assert heaviest.consensus(nodes.limit(0), edges, str(tmp_path / "b")).count() == 0


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.set_id: r.consensus for r in multiple.msa_consensus(catalog._brand_sets(spark, folder, "consensus")).collect()}
    assert {r.set_id: r.consensus for r in catalog.poa_consensus_as_tables(spark, folder).collect()} == want
