import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from strandframe.sources import files
from strandframe.sources.datasource import register
from strandframe.sources.parse import guess_format, records

FASTA = ">one first  record\tx\r\nACGT\r\n\r\nAC\r\n>empty\n>two\nTTTT\n\nGG>G\n"
FASTQ = "@r1 c\nACGT\nAC\n+r1\n@III\n@I\n@r2\nA\n+\n@\n"


def parsed(raw, form="auto"):
    return [r[1:] for r in records(raw.encode() if isinstance(raw, str) else raw, form)]


def test_fasta():
    want = [("one", "first  recordx", "ACGTAC", None), ("empty", "", "", None), ("two", "", "TTTTGG>G", None)]
    assert parsed(FASTA) == want
    assert parsed(gzip.compress(FASTA.encode())) == want
    assert parsed("junk\n" + FASTA) == want
    assert parsed("") == parsed("\n\n") == []
    assert parsed(">x") == [("x", "", "", None)]


def test_fastq():
    assert parsed(FASTQ) == [("r1", "c", "ACGTAC", "@III@I"), ("r2", "", "A", "@")]
    assert parsed("@x\n+\n@y\nAC\n+\nII\n") == [("x", "", "", ""), ("y", "", "AC", "II")]


def test_formats_are_told_apart_and_enforced():
    assert [guess_format(x) for x in ("a>@", "a@>", "abc", "")] == ["fasta", "fastq", "unknown", "unknown"]
    for text, form in ((FASTA, "fastq"), (FASTQ, "fasta"), ("no mark", "auto")):
        with pytest.raises(ValueError):
            parsed(text, form)


def test_frames_read_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(FASTA)
    (tmp_path / "in/b.data").write_bytes(gzip.compress(FASTQ.encode()))
    df = files.read_sequences(spark, str(tmp_path / "in"))
    assert sorted((r.format, r.seq_id, r.name, r.sequence) for r in df.collect()) == [("fasta", 0, "one", "ACGTAC"), ("fasta", 1, "empty", ""), ("fasta", 2, "two", "TTTTGG>G"), ("fastq", 0, "r1", "ACGTAC"), ("fastq", 1, "r2", "A")]
    scanned = files.scan_fasta(spark, str(tmp_path / "in/a.fa"))
    assert sorted(map(tuple, scanned.collect())) == [("empty", "", ""), ("one", "first  recordx", "ACGTAC"), ("two", "", "TTTTGG>G")]
    fasta = df.where("format = 'fasta'")
    files.write_fasta(fasta.coalesce(1), str(tmp_path / "out"), line_width=4, include_comment=True, case="lower")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == ">one first  recordx\nacgt\nac\n>empty\n\n>two\ntttt\ngg>g\n"
    files.write_fasta(fasta, str(tmp_path / "gz"), compression="gzip", line_width=0)
    assert files.read_sequences(spark, str(tmp_path / "gz")).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_sequences(spark, str(tmp_path / "none")).count()


def test_formats_of_spark_read(spark, tmp_path):
    register(spark)
    (tmp_path / "a.fa").write_text(FASTA)
    df = spark.read.format("fasta").load(str(tmp_path / "a.fa"))
    assert [r.name for r in df.orderBy("seq_id").collect()] == ["one", "empty", "two"]
    df.write.format("fasta").mode("append").options(lineWidth="4", baseCase="upper", gzip="true").save(str(tmp_path / "out"))
    again = spark.read.format("seqfile").load(str(tmp_path / "out"))
    assert sorted(again.select("name", "sequence").collect()) == sorted(df.select("name", F.upper("sequence")).collect())
    q = df.where("name = 'one'").withColumn("quality", F.repeat(F.lit("I"), F.length("sequence")))
    q.write.format("fastq").mode("overwrite").save(str(tmp_path / "fq"))
    assert spark.read.format("fastq").load(str(tmp_path / "fq")).first().quality == "IIIIII"
    with pytest.raises(Exception, match="not fastq"):
        spark.read.format("fastq").load(str(tmp_path / "a.fa")).count()


def test_nulls_are_written_as_empty(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([("a", None, None, None), ("b", "x", "AC", None), (None, None, "G", "I")], "name string, comment string, sequence string, quality string")
    files.write_fasta(df, str(tmp_path / "fa"))
    assert sorted((r.name, r.sequence) for r in files.read_sequences(spark, str(tmp_path / "fa")).collect()) == [("", "G"), ("a", ""), ("b", "AC")]
    files.write_fastq(df.where("sequence is null or quality is not null"), str(tmp_path / "fq"))
    assert sorted((r.name, r.sequence, r.quality) for r in files.read_sequences(spark, str(tmp_path / "fq")).collect()) == [("", "G", "I"), ("a", "", "")]
    df.write.format("fasta").mode("append").save(str(tmp_path / "own"))
    own, plain = (sorted(x for p in d.glob("part-*") for x in p.read_text().splitlines()) for d in (tmp_path / "own", tmp_path / "fa"))
    assert own == plain  # one rule in both writers


def test_both_readers_agree(spark, tmp_path):
    texts = {"a.fa": FASTA, "b.fa": ">>first mark\nAC\n>>second\nGG\n>third\n", "c.fa": "\n\n>x\nA\n\n>>y z\nC\n", "d.fa": "", "e.fa": "\n", "f.fa": ">only"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for name in [*texts, ""]:
        want = files.read_sequences(spark, str(tmp_path / name)).select("name", "comment", "sequence").collect()
        assert sorted(files.scan_fasta(spark, str(tmp_path / name)).collect()) == sorted(want), name


def test_a_large_file_is_split_and_its_first_record_known(spark, tmp_path):
    (tmp_path / "large.fa").write_text("".join(f">>r{i} c\nACGT{i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.scan_fasta(spark, str(tmp_path / "large.fa"))
        assert df.rdd.getNumPartitions() > 4
        assert {(r.name, r.sequence) for r in df.collect()} == {(f">r{i}", f"ACGT{i}") for i in range(4000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [FASTQ, "words\n>a\nAC\n", "@r\nAC\n+\nII\n"])
def test_scan_refuses_other_files(spark, tmp_path, text):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(ValueError, match="not a FASTA file"):
        files.scan_fasta(spark, str(tmp_path))


def test_records_are_read_as_they_are_asked_for(tmp_path):
    class Counted(io.FileIO):
        got = 0

        def readinto(self, buffer):
            n = super().readinto(buffer)
            Counted.got += n
            return n

    raw = b"@r\nA\n+\nI\n" + b"".join(b"@%s\nA\n+\nI\n" % random.Random(i).randbytes(40).hex().encode() for i in range(20_000))
    for name, content in (("a.fq", raw), ("a.gz", gzip.compress(raw))):
        (tmp_path / name).write_bytes(content)
        Counted.got = 0
        with Counted(tmp_path / name) as f:
            assert next(records(f))[1] == "r"
            assert 0 < Counted.got < 200_000 < (tmp_path / name).stat().st_size


def _fastq(n, wrapped=False):
    rng = random.Random(n)
    out = []
    for i in range(n):
        s = "".join(rng.choice("ACGTé") for _ in range(rng.randint(0, 60)))
        q = "".join(rng.choice("@+I>") for _ in s)
        cut = len(s) // 2 if wrapped and len(s) > 2 else 0
        parts = [f"@r{i} c {i}", *([s[:cut], s[cut:]] if cut else [s]), rng.choice(("+", f"+r{i}")), *([q[:cut], q[cut:]] if cut else [q])]
        out.append(rng.choice(("\n", "\r\n")).join(parts))
    return "\n".join(out)


@pytest.mark.parametrize("split", [700, 4096, 1 << 20])
def test_fastq_is_split_where_records_may_go_on(spark, tmp_path, split):
    (tmp_path / "large.fq").write_bytes(_fastq(900).encode())
    (tmp_path / "end.fq").write_bytes((_fastq(30) + "\n\n\n").encode())
    (tmp_path / "wrapped.fq").write_bytes((_fastq(300, wrapped=True) + "\n").encode())
    (tmp_path / "blank.fq").write_bytes(_fastq(50).replace("\n@r7 ", "\n\n@r7 ").encode())
    (tmp_path / "z.fq.gz").write_bytes(gzip.compress(_fastq(80).encode()))
    (tmp_path / "none.fq").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.text(str(tmp_path))
        found = files.scan_fastq(spark, str(tmp_path))
        if split < 5000:
            assert lines.rdd.getNumPartitions() > 10
        key = lambda r: (r.path.rpartition("/")[2], r.seq_id, r.format, r.name, r.comment, r.sequence, r.quality)
        got = sorted(map(key, found.collect()))
        assert got == sorted(map(key, files.read_sequences(spark, str(tmp_path)).collect())) and len(got) == 900 + 30 + 300 + 50 + 80
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fastq_scan_refuses_other_files(spark, tmp_path):
    (tmp_path / "x.fq").write_text(">a\nAC\n")
    with pytest.raises(Exception, match="not fastq"):
        files.scan_fastq(spark, str(tmp_path)).count()


def test_filters_are_pushed_into_the_reader(spark, tmp_path):
    register(spark)
    (tmp_path / "a.fa").write_text("".join(f">r{i} c{i % 3}\nAC\nGT{i}\n" for i in range(30)))
    (tmp_path / "b.fq").write_text(_fastq(40, wrapped=True))
    plain = [r for r in spark.read.format("seqfile").load(str(tmp_path)).collect()]
    df = spark.read.format("seqfile").load(str(tmp_path))
    for where, own in (
        ("name = 'r7'", lambda r: r.name == "r7"),
        ("name like 'r1%' and comment in ('c1', 'c 11')", lambda r: r.name.startswith("r1") and r.comment in ("c1", "c 11")),
        ("format = 'fastq' and seq_id >= 35", lambda r: r.format == "fastq" and r.seq_id >= 35),
        ("length(sequence) > 40 and name <> 'r3' and comment is not null", lambda r: len(r.sequence) > 40 and r.name != "r3"),
        ("name = 'r2' or seq_id = 5", lambda r: r.name == "r2" or r.seq_id == 5),
        (f"path = '{tmp_path}/b.fq' and quality is not null", lambda r: r.path.endswith("b.fq")),
    ):
        assert sorted(df.where(where).collect()) == sorted(filter(own, plain)), where
    steps = lambda where: df.where(where)._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in steps("name = 'r7' and seq_id < 3") and "Filter" in steps("quality = 'I'")  # what is left to Spark is a step of its own
    assert df.where(f"path = '{tmp_path}/b.fq'").rdd.getNumPartitions() == 1


def test_refused_records_are_not_kept():
    asked = []
    want = lambda name, comment: asked.append(name) or name == "r5"
    text = "".join(f"@r{i}\nAC\n+\n@@\n" for i in range(9)).encode()
    assert [r[1] for r in records(text, "auto", want)] == ["r5"] and asked == [f"r{i}" for i in range(9)]
    assert list(records(text, "auto", want, lambda form: form == "fasta")) == []
