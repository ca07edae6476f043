"""Sequence files as streams: restarts, repeated micro-batches, admission."""

import gzip

import pytest

from strandframe.plans import catalog
from strandframe.sources import files
from strandframe.streaming.files import stream_sequences, write_epochs


def put(folder, k):
    """File k, of k % 3 records (none in some), every second one in gzip, some of them FASTQ."""
    mark = "@" if k % 4 == 1 else ">"
    text = "".join(f"{mark}f{k}r{i} c{k}\nACGT{'A' * i}\n" + (f"+\n{'@' * (4 + i)}\n" if mark == "@" else "") for i in range(k % 3))
    (folder / f"new{k}").write_bytes(gzip.compress(text.encode()) if k % 2 else text.encode())
    (folder / f"new{k}").rename(folder / f"in{k}.seq")
    return [f"f{k}r{i}" for i in range(k % 3)]


def run(spark, tmp_path, files_a_batch=2):
    s = stream_sequences(spark, f"{tmp_path}/in", files_a_batch=files_a_batch)
    write_epochs(s, f"{tmp_path}/out", f"{tmp_path}/state", files.fasta_text(include_comment=True)).trigger(availableNow=True).start().awaitTermination()
    rows = files.read_sequences(spark, f"{tmp_path}/out/epoch=*").collect()
    return sorted(r.name for r in rows), rows


def test_restarts_neither_lose_nor_repeat_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = sum((put(folder, k) for k in range(7)), [])
    got, rows = run(spark, tmp_path)
    assert got == sorted(names)
    assert {r.name: (r.comment, r.sequence) for r in rows}["f5r1"] == ("c5", "ACGTA")
    epochs = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert epochs == [f"epoch={i}" for i in range(4)]  # two files each
    assert run(spark, tmp_path)[0] == sorted(names)  # nothing is new

    names += sum((put(folder, k) for k in range(7, 11)), [])
    assert run(spark, tmp_path)[0] == sorted(names)

    last = max(int(p.name) for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state/commits").iterdir():  # the last micro-batch wrote, and the driver was lost before it said so
        if p.name in (str(last), f".{last}.crc"):
            p.unlink()
    names += put(folder, 11)
    assert run(spark, tmp_path)[0] == sorted(names)


def test_a_stream_agrees_with_the_reader(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        put(folder, k)
    s = stream_sequences(spark, str(folder))
    s.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/all/{i}")).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/all/*").selectExpr("path", "seq_id", "format", "name", "comment", "sequence", "coalesce(quality, '')").collect())
    assert got == sorted(tuple(r) for r in files.read_sequences(spark, str(folder)).selectExpr("path", "seq_id", "format", "name", "comment", "sequence", "coalesce(quality, '')").collect())


def test_wrong_files_and_bounds_are_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("@r\nA\n+\n@\n")
    with pytest.raises(ValueError):
        stream_sequences(spark, f"{tmp_path}/in", files_a_batch=0)
    with pytest.raises(ValueError):
        stream_sequences(spark, f"{tmp_path}/in", form="embl")
    q = stream_sequences(spark, f"{tmp_path}/in", form="fasta").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="(?i)fasta"):
        q.awaitTermination()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = catalog.streaming_sequences(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted((r.name, r.comment, r.symbols) for r in got) == sorted((f"doc{d.doc_id}", d.lang or "", len(d.text or "")) for d in docs)


def test_a_file_goes_to_python_in_pieces(spark, tmp_path, monkeypatch):
    """Files of many pieces and of none, plain and gzip, next to each other in one task; before, a worker got each one whole."""
    monkeypatch.setattr(files, "PIECE", 64)
    (tmp_path / "in").mkdir()
    texts = {k: "".join(f">r{k}.{i} é\n{'ACGT' * (i % 40)}\n" for i in range(k * 30)) for k in range(4)}
    for k, t in texts.items():
        (tmp_path / "in" / f"{k}.fa").write_bytes(gzip.compress(t.encode()) if k % 2 else t.encode())
    got = files.decoded(spark.read.format("binaryFile").load(f"{tmp_path}/in").coalesce(1)).collect()
    assert sorted((r.path[-4:], r.seq_id, r.name, r.comment, r.sequence) for r in got) == sorted((f"{k}.fa", i, f"r{k}.{i}", "é", "ACGT" * (i % 40)) for k in texts for i in range(k * 30))
    plan = files.read_sequences(spark, f"{tmp_path}/in")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" in plan and "substring(content" in plan
