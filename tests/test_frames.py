"""Operators and queries on DataFrames."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandframe.functions import arrow, hof
from strandframe.operators import multiple, pairwise, qgram, wavefront
from strandframe.plans import catalog
from strandframe.scheme import DEFAULT, ScoringScheme
from strandframe.streaming import incremental as stream

from .test_kernels import SCHEMES, cell_by_cell, pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("scheme", SCHEMES[:3])
def test_catalyst_and_arrow_scores_agree(spark, scheme):
    p = [(i, a, b) for i, (a, b) in enumerate(pairs(3, 60))] + [(900, None, "a"), (901, "a", None)]
    df = spark.createDataFrame(p, "i int, a string, b string")
    got = df.select("i", "a", "b", hof.scores(F.col("a"), F.col("b"), scheme).alias("x"), arrow.scores(F.col("a"), F.col("b"), scheme).alias("y")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.x is None and r.y is None
        else:
            assert tuple(r.x) == tuple(r.y) == cell_by_cell(r.a, r.b, scheme)


@pytest.mark.parametrize("scheme", SCHEMES)
def test_catalyst_and_arrow_alignments_agree(spark, scheme):
    p = [(i, a, b) for i, (a, b) in enumerate(pairs(5, 70))] + [(900, None, "a"), (901, "a", None), (902, "", ""), (903, "", "ab"), (904, "é日", "日"), (905, "AAAA", "AAAAAAAA")]
    df = spark.createDataFrame(p, "i int, a string, b string").repartition(8)
    fast = pairwise.align_pairs(df, scheme=scheme, method="catalyst")
    got, want = ({r.i: tuple(r) for r in d.collect()} for d in (fast, pairwise.align_pairs(df, scheme=scheme)))
    assert got == want
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        pairwise.align_pairs(df, method="other")


def test_score_pairs_options(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "zzzzzzzzzzzz"), ("a", "b")], "a string, b string")
    assert [r.global_score for r in pairwise.score_pairs(df, at_least=3).collect()] == [8]
    edit = ScoringScheme(0, -1, -1, 0)
    assert [r.global_score for r in pairwise.score_pairs(df, scheme=edit, method="edit").collect()] == [r.global_score for r in pairwise.score_pairs(df, scheme=edit).collect()]
    for bad in ({"method": "edit"}, {"method": "none"}):
        with pytest.raises(ValueError):
            pairwise.score_pairs(df, **bad)
    ops = pairwise.align_pairs(df).select("global_score", pairwise.rescored(F.col("ops")).alias("again")).collect()
    assert all(r.global_score == r.again for r in ops)
    plan = pairwise.score_pairs(df, method="catalyst")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("scheme", "q", "bounds"), [(DEFAULT, 2, (9, 22)), (ScoringScheme(2, -1, -1, 0), 3, (25,)), (ScoringScheme(-1, -3, -2, -1), 2, (-9,))])
def test_score_join_finds_what_all_pairs_find(spark, scheme, q, bounds):
    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT" if i % 2 else "abcdefghij") for _ in range(rng.randint(5, 30))) for i in range(14)]
    rows = []
    for i in range(70):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.choice((0, 1, 1, 3))] = rng.choice(("", "x", "ACG"))
        rows.append((i, "".join(s), i))
    rows += [(900, None, 0), (901, "", 0), (902, "A", 0), (None, "ACGT", 0)]
    df = spark.createDataFrame(rows, "id int, s string, k1 int").repartition(4).cache()
    pairs = pairwise.all_pairs(df.where("s is not null and id is not null"), "id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.s").alias("p"), F.col("y.s").alias("q"))
    every = [(r.a, r.b, r.global_score) for r in pairwise.score_pairs(pairs, "p", "q", scheme).collect()]
    for at_least in bounds:
        found = qgram.score_join(df, "id", "s", at_least, scheme, q, block=7).select("x.id", F.col("y.id").alias("b"), "global_score").collect()
        assert sorted(map(tuple, found)) == sorted(p for p in every if p[2] >= at_least)
    df.unpersist()


def test_score_join_scores_few_pairs(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, s[:20] + "x" + s[22:]) for i, s in rows[:40]]
    df = spark.createDataFrame(rows, "id int, s string")
    met = qgram.candidates(df, "id", "s", 90)
    assert met.count() == qgram.score_join(df, "id", "s", 90).count() == 40  # of 57,630 pairs


def test_score_join_of_texts_alike_in_all_but_one_symbol(spark):
    """Texts that share their frequent q-grams meet by what differs, and rows of one text are pairs of their own."""
    names = [f"Supplier#{i:09d}" for i in range(60)] + ["Supplier#00000001", "Supplier#0000000123", "Supplier#00000012345", "supplier#000000123456789"]
    rows = [(i, s) for i, s in enumerate(names)] + [(1000 + i, names[i]) for i in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "id int, s string")
    for at_least in (29, 36):
        found = qgram.score_join(df, "id", "s", at_least, q=4).select("x.id", F.col("y.id").alias("b"), "global_score")
        every = pairwise.all_pairs(df, "id").select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.s").alias("a"), F.col("y.s").alias("b"))
        want = [(r.i, r.j, r.global_score) for r in pairwise.score_pairs(every, at_least=at_least).collect()]
        assert sorted(map(tuple, found.collect())) == sorted(want)
    own = df.where("length(s) = 18 and id < 60")
    met = qgram.candidates(own, "s", "s", 29, q=4)
    assert met.count() == qgram.score_join(own, "s", "s", 29, q=4).count()
    assert "_grams" not in met._jdf.queryExecution().optimizedPlan().toString()  # before, all pairs met by a frequent q-gram


def test_msa_takes_its_order_from_a_column(spark):
    rows = [(1, 2, "ACGT"), (1, 0, "ACT"), (1, 1, None), (2, 0, "A"), (3, 0, "")]
    sets = multiple.progressive(spark.createDataFrame(rows, "set_id int, seq_idx int, sequence string"))
    got = {(r.set_id, r.seq_idx): r.row for r in multiple.msa_rows(sets).collect()}
    assert got == {(1, 0): "AC-T", (1, 1): "ACGT", (2, 0): "A", (3, 0): ""}
    assert {r.set_id: r.consensus for r in multiple.msa_consensus(sets).collect()}[2] == "A"
    assert multiple.graph_edges(sets).where("set_id = 1").agg(F.sum("weight")).first()[0] == 5
    assert multiple.progressive(spark.createDataFrame([], "set_id int, seq_idx int, sequence string")).count() == 0


def test_stream_grows_the_same_graph(spark, tmp_path):
    schema = "set_id int, seq_idx int, sequence string"
    rows = [(1, 0, "ACGTACGT"), (1, 1, "ACGACGT"), (2, 0, "TTT"), (1, 2, "ACGTCGT"), (2, 1, "TAT")]
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.incremental(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update")
        q.option("checkpointLocation", ck).foreachBatch(lambda d, i: d.write.mode("append").parquet(sink)).trigger(availableNow=True).start().awaitTermination()
    last = {r.set_id: r for r in spark.read.parquet(sink).orderBy("n_sequences").collect()}
    whole = multiple.progressive(spark.createDataFrame(rows, schema))
    for r in whole.collect():
        own = last[r.set_id]
        assert (own.consensus, own.n_nodes, own.end_score) == (r.consensus, len(r.nodes), r.rounds[-1].end_score)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are elsewhere")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    # no nation has two suppliers in the smallest tables
    sf = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01") if name == "poa_rounds_without_gaps" else SF
    df = catalog.QUERIES[name](spark, sf)
    rows = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    assert rows
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in ("nation", "region", "part", "supplier", "documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(str(r[k]) for k in order) for r in want.fetchall()) == rows


def test_dna_queries_match_brute_force(spark):
    data = {r.item_id: r for r in catalog.dna_pairs(spark, SF).collect()}
    rows = {r.item_id: r for r in catalog.nw_dna_score(spark, SF).collect()}
    for i in sorted(data)[:3]:
        assert (rows[i].global_score, rows[i].max_cell_score) == cell_by_cell(data[i].a, data[i].b, DEFAULT)


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(catalog.QUERIES) <= set(q)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_tiles_give_the_score(spark, size):
    from strandframe.operators.wavefront import score_tiled

    for a, b in [*pairs(5, 3), ("", "ab"), ("", ""), ("acbacbacba", "abcaabcbcacbb")]:
        assert score_tiled(spark, a, b, SCHEMES[3], size) == cell_by_cell(*((a, b) if len(a) >= len(b) else (b, a)), SCHEMES[3])


def test_all_pairs_meet_once(spark):
    rng = random.Random(6)
    names = [f"n{rng.randrange(10**6)}" for _ in range(150)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate([*names, names[0]])], "name string, at int")
    for rows in (7, 1000):
        met = pairwise.all_pairs(df, "name", rows).select("x.name", F.col("y.name").alias("other"), "x.at", F.col("y.at").alias("b")).collect()
        want = sorted((p, q, i, j) for i, p in enumerate([*names, names[0]]) for j, q in enumerate([*names, names[0]]) if p < q)
        assert sorted(map(tuple, met)) == want
    plan = pairwise.all_pairs(df, "name")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairwise.all_pairs(df.limit(0), "name").count() == 0


def test_scores_above_a_bound_are_worked_out_once(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "xyz"), (None, "a")], "a string, b string")
    scored = pairwise.score_pairs(df, at_least=-5)
    assert [(r.a, r.b) for r in scored.collect()] == [("abc", "abd")]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_only_the_wanted_fields_are_made(spark):
    df = spark.createDataFrame([(1, 0, "abc"), (1, 1, "abd")], "set_id int, seq_idx int, sequence string")
    assert multiple.progressive(df, fields=["consensus"]).columns == ["set_id", "consensus"]
    assert multiple.msa_rows(multiple.progressive(df, fields=["rows"])).count() == 2


def test_sets_are_dealt_among_tasks(spark):
    """Small tables of many sequences: by their bytes Spark would give all sets to one task."""
    df = spark.createDataFrame([(i, j, "abc") for i in range(40) for j in range(2)], "set_id int, seq_idx int, sequence string")
    tasks = multiple.progressive(df, fields=["rounds"]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4


def test_tiles_refuse_what_is_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wavefront, "SYMBOLS", 5)
    with pytest.raises(ValueError, match="more than 5 symbols"):
        wavefront.score_tiled(spark, "abc", "abc")
