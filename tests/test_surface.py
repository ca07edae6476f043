"""SQL functions and the command line."""

import pytest

from strandframe import cli
from strandframe.functions import sql
from strandframe.functions.kernels import align
from strandframe.functions.poa import progressive


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "ACGT", "AGT"), (2, None, "A")], "i int, a string, b string").createOrReplaceTempView("pairs")
    r = spark.sql("SELECT i, nw_score(a, b) AS s, nw_max_cell(a, b) AS m, nw_align(a, b) AS x FROM pairs ORDER BY i").collect()
    want = align("ACGT", "AGT")
    assert (r[0].s, r[0].m) == want[:2] and tuple(r[0].x) == want
    assert r[1].s is None and r[1].m is None
    c = spark.sql("SELECT i, c.* FROM (SELECT i, nw_align(a, b) AS x FROM pairs WHERE i = 1), LATERAL alignment_columns(x.row_a, x.row_b, x.ops) AS c ORDER BY column").collect()
    assert "".join(x.op for x in c) == want[5] and [x.column for x in c] == [1, 2, 3, 4]
    rows = spark.sql("SELECT * FROM msa_rows(array('ACGT', 'AGT')) ORDER BY seq_idx").collect()
    assert [x.row for x in rows] == progressive(["ACGT", "AGT"]).rows
    assert spark.sql("SELECT sum(weight) AS w FROM poa_edges(array('ACGT', 'AGT'))").first().w == 5
    assert spark.sql("SELECT count(*) AS n FROM poa_nodes(array('ACGT', 'AGT'))").first().n == 4


def test_command_line(spark, tmp_path, capsys):
    a, b, out = (str(tmp_path / x) for x in ("a.fa", "b.fa", "out.txt"))
    open(a, "w").write(">x\nAGT\n")
    open(b, "w").write(">y\nAC\nGT\n>z\nTTT\n")
    assert cli.main(["pairwise", "-1", a, "-2", b, "-o", out], spark) == 0
    assert capsys.readouterr().out == "global_score=0 max_cell_score=2\n"
    assert open(out).read() == ">1\nACGT\n>2\nA-GT"
    assert cli.main(["pairwise", "-1", a, "-2", b, "--no-trace", "-M", "3"], spark) == 0
    assert cli.main(["multiple", "-i", b, "-o", out], spark) == 0
    text = open(out).read()
    assert text.startswith(">1\n") and "consensus:\n" in text and not text.endswith("\n")
    open(a, "w").write("")
    assert cli.main(["pairwise", "-1", a, "-2", b, "-o", out], spark) == 1
    with pytest.raises(SystemExit):
        cli.arguments(["pairwise"])
