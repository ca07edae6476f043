import random

import duckdb
import pytest

from strandframe.functions import poa
from strandframe.functions.kernels import score_batch
from strandframe.functions.poa import Graph, align_to_graph, grow, heaviest_path, progressive
from strandframe.plans import catalog, oracle
from strandframe.scheme import DEFAULT, ScoringScheme

from .test_kernels import examples


@pytest.mark.parametrize("scheme", [DEFAULT, ScoringScheme(1, -1, -1, 0)])
def test_invariants_of_random_sets(scheme):
    rng = random.Random(1)
    for _ in range(150):
        seqs = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        r = progressive(seqs, scheme)
        assert [x.replace("-", "") for x in r.rows] == seqs
        assert len({len(x) for x in r.rows}) <= 1
        assert sum(w for b in r.graph.before for w in b.values()) == sum(max(0, len(s) - 1) for s in seqs)
        for ring in r.graph.rings:
            assert len({r.graph.symbols[v] for v in ring}) == len(ring)
        if len(seqs) == 2 and all(seqs):
            assert r.rounds[0][1] == score_batch([tuple(seqs)], scheme)[0][0]


def test_small_sets():
    assert progressive([]).rows == [] and progressive([]).consensus == ""
    assert progressive(["abc"]).rows == ["abc"] and progressive(["abc"]).consensus == "abc"
    assert progressive(["a", "a"]).rows == ["a", "a"]
    r = progressive(["abcabc"] * 4)
    assert r.consensus == "abcabc" and [x[1:] for x in r.rounds] == [(12, 0)] * 3
    three = progressive(["axb", "ayb", "azb", "awb", "avb"], ScoringScheme(2, -1, -2, -4))
    assert max(map(len, three.graph.rings)) == 5 and {len(x) for x in three.rows} == {3}
    assert progressive(["é日a", "é日b"]).rows == ["é日a", "é日b"]


def test_path_goes_on_to_a_sink():
    """The node of most weight has a successor, and a rival of lower score leads there by a heavier edge."""
    g = Graph()
    a, b, c, d, e = (g.add(x) for x in "abcde")
    for u, v, w in ((a, b, 5), (b, c, 1), (d, c, 3), (e, d, 1)):
        for _ in range(w):
            g.link(u, v)
    path, score, *_ = heaviest_path(g, [a, b, e, d, c])
    assert [g.symbols[v] for v in path] == ["a", "b", "c"] and score[c] == 6


def built(text, edges, beside=()):
    """A graph of the symbols of text, in this order, with edges "ab" and nodes beside others."""
    g, at = Graph(), {}
    near = dict(beside)
    for c in text:
        at[c] = g.add(c, at[near[c]] if c in near else None)
    for u, v in edges:
        g.link(at[u], at[v])
    g.listing = list(range(len(text)))
    return g


def named(g, nodes):
    return "".join(g.symbols[v] for v in nodes)


def test_order_is_depth_first():
    g = built("abcdx", ["ab", "bc", "cd", "ax", "xd"])
    assert named(g, g.order()) == "abcxd" and named(g, g.listing) == "abcxd"
    g = built("abcdx", ["ax", "xd", "ab", "bc", "cd"])  # the edge that was added first is followed first
    assert named(g, g.order()) == "axbcd"
    g = built("abcy", ["ab", "bc", "yb"])  # the walk from a stops at b, which waits for y
    assert named(g, g.order()) == "aybc"
    g.listing = [3, 0, 1, 2]  # a walk begins at the first that is listed
    assert named(g, g.order()) == "yabc"


def test_sinks_of_rings():
    g = built("abcx", ["ab", "bc", "ax"], {"x": "b"})  # x ends beside b, which goes on: x comes first
    assert named(g, g.order()) == "axbc"
    g = built("abcxd", ["ab", "ac", "cx", "cd"], {"x": "b"})  # both end: they wait until d is there
    assert named(g, g.order()) == "acdbx"
    assert named(g, g.ring_order()) == "acdbx"


def test_rings_wait_for_all_their_nodes():
    g = built("abcyz", ["ab", "bc", "ay", "yz", "zc"], {"y": "b"})
    assert named(g, g.ring_order()) == "ayzbc"  # y completes the ring, and z follows from it alone
    g = built("abcdyz", ["ab", "bc", "cd", "ay", "yz", "zd"], {"y": "b", "z": "c"})
    assert named(g, g.ring_order()) == "aybczd"
    r = progressive(["acgt", "aggt", "acct"], ScoringScheme(2, -1, -2, -4))
    assert [x for x in r.rows] == ["acgt", "aggt", "acct"]


def test_equal_sinks_end_at_the_first_in_order():
    """The second sequence ends beside the first one's end; a third that fits neither takes the sink that comes first."""
    scheme = ScoringScheme(2, -1, -2, -4)
    g = Graph()
    for k, s in enumerate(("abc", "abd")):
        grow(g, s, k, scheme)
    _, path = align_to_graph(g, "abx", scheme)
    order = g.listing
    assert path[-1] == (2, next(v for v in order if not g.after[v]))
    assert align_to_graph(built("ab", []), "a", scheme)[0] == -1  # the very first node isn't an end beside others
    assert align_to_graph(built("a", []), "a", scheme)[0] == 2


@pytest.mark.parametrize("cells", [0, 40])
def test_blocks_of_planes_give_the_same_walk(cells):
    rng = random.Random(3)
    for _ in range(60):
        g = Graph()
        for k in range(5):
            s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            if k:
                listing = g.listing
                want = align_to_graph(g, s)
                g.listing = listing
                assert align_to_graph(g, s, cells=cells) == want
            grow(g, s, k)


def test_generated_set():
    """Values of this engine for generated sequences, which hold wherever the tests run."""
    rng = random.Random(11)
    root = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = ["".join(c if rng.random() < 0.9 else rng.choice(["", "A", "C", "G", "T", "AC"]) for c in root) for _ in range(5)]
    r = progressive(seqs)
    assert r.rounds == [(300, 250, 44), (344, 388, 24), (368, 481, 14), (382, 392, 19)]
    assert (len(r.graph.symbols), len(r.rows[0]), len(r.consensus)) == (401, 323, 302)
    assert [x.replace("-", "") for x in r.rows] == seqs


def test_cycles_are_an_error():
    g = Graph()
    a, b = g.add("a"), g.add("b")
    g.listing = [a, b]
    g.link(a, b)
    g.link(b, a)
    for f in (g.order, g.ring_order):
        with pytest.raises(ValueError):
            f()


@pytest.mark.skipif(not examples([5000] * 5), reason="no example files here")
def test_documented_set():
    seqs = examples([5000] * 5)
    r = progressive(seqs)
    assert r.rounds == [(5000, -5451, 1885), (6885, -3101, 1714), (8599, -1776, 1531), (10130, -870, 1338)]
    g = r.graph
    assert (len(g.symbols), max(r.column) + 1, max(map(len, g.rings)), max(map(len, g.before)), sum(not b for b in g.before)) == (11468, 9000, 4, 5, 2)
    assert max(r.scores[0].values()) == 12912 and len(r.consensus) == 5987
    assert [x.replace("-", "") for x in r.rows] == seqs
    assert sum(w for b in g.before for w in b.values()) == 24995


@pytest.mark.parametrize("scheme", [DEFAULT, ScoringScheme(2, -1, -2, -1), ScoringScheme(1, -1, -1, 0)])
def test_sets_of_two_match_sql(scheme):
    """Rows and consensus by an independent statement of the rules in SQL, over pairs full of ties."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    pairs = [(i, 0, word(), word()) for i in range(120)]
    con = duckdb.connect()
    con.execute("create table pairs_(k1 bigint, k2 bigint, a varchar, b varchar)")
    con.executemany("insert into pairs_ values (?, ?, ?, ?)", pairs)
    sql = f"WITH RECURSIVE {oracle.pair_msa('SELECT * FROM pairs_', scheme)} SELECT k1, row_a, row_b, consensus FROM msa JOIN consensus USING (k1, k2)"
    got = {k: tuple(v) for k, *v in con.execute(sql).fetchall()}
    for i, _, a, b in pairs:
        r = progressive([a, b], scheme)
        assert got[i] == (*r.rows, r.consensus), (a, b)


@pytest.mark.parametrize("scheme", [ScoringScheme(2, -5, -2, -4), ScoringScheme(2, -1, -100, -127), ScoringScheme(1, -1, -1, 0)])
def test_alignments_worked_out_ahead_change_nothing(scheme, monkeypatch):
    """Sets with many repeats and few changes, next to sets in which each sequence brings something."""
    rng = random.Random(21)
    for case in range(30):
        pool = ["".join(rng.choice("ACGT"[: 2 + case % 3]) for _ in range(rng.choice((0, 1, 6, 9)) if case % 2 else 8)) for _ in range(rng.choice((3, 12)))]
        own = [rng.choice(pool) for _ in range(rng.choice((5, 40)))]
        if case % 5 == 0:
            monkeypatch.setattr(poa, "AHEAD_CELLS", 300)
        graph, rounds = Graph(), []
        for i, s in enumerate(own):
            r = grow(graph, s, i, scheme)
            if r[0]:
                rounds.append(r)
        got, want = progressive(own, scheme), poa.finish(graph, len(own), rounds)
        got.graph.version = want.graph.version
        assert got == want
        monkeypatch.undo()


def test_many_sequences_take_few_passes_over_the_graph(monkeypatch):
    """Names of which most bring nothing new; before, each one was a pass of its own."""
    passes = []
    init = poa.GraphPlanes.__init__
    monkeypatch.setattr(poa.GraphPlanes, "__init__", lambda self, *a, **b: (passes.append(1), init(self, *a, **b))[1])
    names = [f"Supplier#{(i * 37) % 1000:09d}" for i in range(1000)]
    found = progressive(names, ScoringScheme(2, -1, -100, -127))
    assert found.rows == names and len(found.rounds) == 999 and len(passes) < 400


def test_rounds_without_gaps_take_whole_texts_and_all_suppliers(spark):
    """All texts of the benchmark and all suppliers are in the sets; texts were cut at 60 symbols first, then left out."""
    folder = "/root/testdata/sf0.01"
    got = catalog.poa_rounds_without_gaps(spark, folder).collect()
    count = lambda sql: duckdb.sql(sql.format(folder)).fetchall()[0][0]
    assert sum(r.set_id < 0 for r in got) == count("SELECT count(*) - count(DISTINCT item_id // 5) FROM '{}/benchmark.parquet' WHERE text IS NOT NULL")
    assert sum(r.set_id >= 0 for r in got) == count("SELECT count(*) - count(DISTINCT s_nationkey) FROM '{}/supplier.parquet'")
    longest = dict(duckdb.sql(f"SELECT -1 - item_id // 5, max(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) FROM '{folder}/benchmark.parquet' GROUP BY ALL").fetchall())
    assert all(r.nodes_before == longest[r.set_id] for r in got if r.set_id < 0 and r.round == 1)
