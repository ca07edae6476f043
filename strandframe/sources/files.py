"""Sequence files as DataFrames, on any file system that Spark reaches, and back.

read_sequences() opens whole files (plain or gzip, told by their first bytes; Spark reads 2 GB of a file that way, and
format("fastq") any size from mounted paths); scan_fasta() and scan_fastq() split large plain files. Writers form the records' text with column functions and leave the files to Spark.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hof
from .parse import records

SCHEMA = "path string, seq_id long, format string, name string, comment string, sequence string, quality string"
ROWS = 1000
#: Bytes of a file that go to Python at a time.
PIECE = 1 << 20


class _Pieces(io.RawIOBase):
    """A file as it comes in pieces, of which one is held at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def decoded(contents: DataFrame, form: str = "auto") -> DataFrame:
    """The records of whole files, given as path and content, of a table or a stream.

    A file goes to Python in pieces of PIECE bytes, and records come back by ROWS of them or PIECE characters, so that a
    worker holds little of it, however large it is. Arrow batches are set to 512 rows and 8 MB for the session unless it has its own settings.
    """
    if form not in ("auto", "fasta", "fastq"):
        raise ValueError("form must be auto, fasta or fastq")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file, at, piece) for batch in batches for file, at, piece in zip(*(batch.column(c) for c in ("path", "at", "piece")), strict=True))
        ahead = next(pieces, None)

        def own() -> Iterator[bytes]:
            """The pieces of one file: the next one begins at 0 again."""
            nonlocal ahead
            first = True
            while ahead is not None and (first or ahead[1].as_py()):
                piece, first = ahead[2].as_py(), False
                ahead = next(pieces, None)
                yield piece

        while ahead is not None:
            file, parts = ahead[0].as_py(), own()
            rows: list[tuple] = []
            size = 0
            for i, r in enumerate(records(_Pieces(parts), form)):
                rows.append((file, i, *r))
                size += len(r[3]) + len(r[4] or "")
                if len(rows) == ROWS or size >= PIECE:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)
            for _ in parts:  # what the parser left
                pass

    conf = contents.sparkSession.conf
    for name, usual, most in (("maxRecordsPerBatch", ("10000",), "512"), ("maxBytesPerBatch", ("256MB", str(256 << 20), f"{256 << 20}b"), str(8 << 20))):
        if conf.get(f"spark.sql.execution.arrow.{name}", usual[0]) in usual:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    size = F.octet_length("content")
    cut = contents.select("path", "content", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PIECE))).alias("at"))
    return cut.select("path", "at", F.substring("content", F.col("at") + 1, F.lit(PIECE)).alias("piece")).mapInArrow(run, SCHEMA)


def read_sequences(spark: SparkSession, path: str | list[str], form: str = "auto") -> DataFrame:
    """path, seq_id (number within the file, from 0), format, name, comment, sequence, quality (null in FASTA).

    A file is one task's; missing paths are Spark's error. form fasta or fastq refuses other files.
    """
    return decoded(spark.read.format("binaryFile").load(path), form)


def scan_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, comment, sequence of FASTA files (plain, or with a codec's file name). Files are split where a line starts
    with >, so a large one is many tasks', and records are taken apart by Catalyst expressions.

    A file must begin with > or a blank line; another one, such as FASTQ, is an error. To know each file's first record, the
    only one that still has its mark, files are read once more, for a number a file.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_at"), F.monotonically_increasing_id().alias("_row"))
    heads = text.where("_at = 0").groupBy("_file").agg(F.min(F.struct("_row", F.substr("value", F.lit(1), F.lit(1)).alias("mark"))).alias("head"))
    bad = heads.where("head.mark not in ('>', '\n', '\r', '')").select("_file").first()
    if bad is not None:
        raise ValueError(f"not a FASTA file: {bad[0]}")
    first = heads.select(F.col("head._row").alias("_first"))
    text = text.join(first, F.col("_row") == F.col("_first"), "left")
    marked = F.startswith("value", F.lit(">"))
    text = text.where(F.col("_first").isNull() | marked)  # what stands before a file's first mark is blank
    lines = F.split(F.when(F.col("_first").isNotNull(), F.substr("value", F.lit(2))).otherwise(F.col("value")), "\n")
    header = F.get(lines, F.lit(0))
    rest = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    return text.select(hof.header_name(header).alias("name"), hof.header_comment(header).alias("comment"), F.array_join(rest, "").alias("sequence"))


def _line_starts(lines: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each file the places of its splits and the number of the line that each begins with. A split is two numbers; Spark's driver holds more of each."""
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in lines.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts.setdefault(r.path, []).append((r["at"], r.n))
    out = {}
    for path, own in counts.items():
        at, n = np.array(sorted(own)).T
        out[path] = at, np.cumsum(n) - n
    return out


_PARTS = "path string, seq_id long, header string, sequence string, plus string, quality string, phase int, line string"


def _fastq_parts(lines: DataFrame) -> DataFrame:
    """The records of four lines that lie in one split, and the lines of those that don't, with their number among the four."""
    sent = lines.sparkSession.sparkContext.broadcast(_line_starts(lines))
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string()]
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def table(columns: list) -> pa.RecordBatch:
        size = len(columns[1])
        return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else [c] * size, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def alone(path: str, number: int, own: list[str]) -> pa.RecordBatch:
        numbers = range(number, number + len(own))
        return table([path, [i // 4 for i in numbers], None, None, None, None, [i % 4 for i in numbers], own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, left = (None, 0), 0, []
        for batch in batches:
            paths, places, values = (batch.column(c).to_pylist() for c in ("path", "at", "value"))
            cuts = [0, *(i for i in range(1, len(paths)) if places[i] != places[i - 1] or paths[i] != paths[i - 1]), len(paths)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = [v.removesuffix("\r") for v in values[a:b]]
                if split != (paths[a], places[a]):
                    if left:
                        yield alone(split[0], number, left)
                    split = paths[a], places[a]
                    at, first = sent.value[paths[a]]
                    number, left = int(first[np.searchsorted(at, places[a])]), []
                    if (head := -number % 4) and own:
                        yield alone(split[0], number, own[:head])
                        number, own = number + len(own[:head]), own[head:]
                elif -number % 4 and not left:  # the split's first lines were fewer than those of its first record
                    head = -number % 4
                    yield alone(split[0], number, own[:head])
                    number, own = number + len(own[:head]), own[head:]
                left += own
                if whole := len(left) // 4 * 4:
                    yield table([split[0], list(range(number // 4, (number + whole) // 4)), left[0:whole:4], left[1:whole:4], left[2:whole:4], left[3:whole:4], None, None])
                    number, left = number + whole, left[whole:]
        if left:
            yield alone(split[0], number, left)

    return lines.mapInArrow(run, _PARTS)


def scan_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq_id, format, name, comment, sequence, quality of FASTQ files, large plain ones split among tasks.

    Lines of all splits are counted first, so that each split knows the number of its first line and, as records are four
    lines, where in a record it begins: no quality is taken for a header. Records that two splits share are put together
    from their lines. Files whose records aren't four lines each, as with wrapped sequences or blank lines between, are found by
    their marks and lengths and read by read_sequences(), one task a file; so is a file of another kind, which that refuses.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    parts = _fastq_parts(lines)
    joined = parts.where(F.col("phase").isNotNull()).groupBy("path", "seq_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "line"))).alias("l"))
    of = lambda k: F.coalesce(F.element_at("l", F.lit(k)), F.lit("")).alias(("header", "sequence", "plus", "quality")[k])
    found = parts.where(F.col("phase").isNull()).select("path", "seq_id", "header", "sequence", "plus", "quality").unionByName(joined.select("path", "seq_id", *map(of, range(4))))
    found = found.where(F.concat("header", "sequence", "plus", "quality") != "")  # blank lines behind the last record
    right = F.startswith("header", F.lit("@")) & F.startswith("plus", F.lit("+")) & ~F.startswith("sequence", F.lit("+")) & (F.char_length("sequence") == F.char_length("quality"))
    other = [r.path for r in found.where(~right).select("path").distinct().collect()]
    header = F.substr("header", F.lit(2))
    out = found.where(~F.col("path").isin(other)) if other else found
    out = out.select("path", "seq_id", F.lit("fastq").alias("format"), hof.header_name(header).alias("name"), hof.header_comment(header).alias("comment"), "sequence", "quality")
    return out.unionByName(read_sequences(spark, other, "fastq")) if other else out


def _sequence(case: str) -> Column:
    return hof.folded(F.coalesce(F.col("sequence"), F.lit("")), case)


def _header(mark: str, include_comment: bool) -> Column:
    comment = F.coalesce(F.col("comment"), F.lit(""))
    head = F.concat(F.lit(mark), F.coalesce(F.col("name"), F.lit("")))
    return F.when(comment != "", F.concat(head, F.lit(" "), comment)).otherwise(head) if include_comment else head


def fasta_text(line_width: int = 80, include_comment: bool = False, case: str = "original") -> Column:
    """The record of a row with name, comment and sequence, without a line feed at its end. Nulls are written as empty."""
    return F.concat(_header(">", include_comment), F.lit("\n"), F.array_join(hof.wrapped(_sequence(case), line_width), "\n"))


def fastq_text(include_comment: bool = False, case: str = "original") -> Column:
    return F.concat(_header("@", include_comment), F.lit("\n"), _sequence(case), F.lit("\n+\n"), F.coalesce(F.col("quality"), F.lit("")))


def _with_comment(df: DataFrame) -> DataFrame:
    return df if "comment" in df.columns else df.withColumn("comment", F.lit(None).cast("string"))


def write_fasta(df: DataFrame, path: str, line_width: int = 80, include_comment: bool = False, case: str = "original", mode: str = "error", compression: str = "none") -> None:
    """Rows with name, sequence and perhaps comment as FASTA part files, wrapped at line_width (0: one line)."""
    _with_comment(df).select(fasta_text(line_width, include_comment, case).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_fastq(df: DataFrame, path: str, include_comment: bool = False, case: str = "original", mode: str = "error", compression: str = "none") -> None:
    _with_comment(df).select(fastq_text(include_comment, case).alias("value")).write.mode(mode).option("compression", compression).text(path)


def pair_text() -> Column:
    """The two rows of an aligned pair, the longer sequence first, numbered 1 and 2."""
    one, two = F.when(F.col("swapped"), F.col("row_b")).otherwise(F.col("row_a")), F.when(F.col("swapped"), F.col("row_a")).otherwise(F.col("row_b"))
    return F.concat(F.lit(">1\n"), one, F.lit("\n>2\n"), two)


def msa_text() -> Column:
    """The rows of a set from operators.multiple.progressive(), numbered from 1, and the consensus."""
    rows = F.transform("rows", lambda r: F.concat(F.lit(">"), (r["seq_idx"] + 1).cast("string"), F.lit("\n"), r["row"], F.lit("\n")))
    return F.concat(F.array_join(rows, ""), F.lit("consensus:\n"), F.col("consensus"))


def write_alignments(df: DataFrame, path: str, text: Column, mode: str = "error") -> None:
    """One record a row, by pair_text() or msa_text()."""
    df.select(text.alias("value")).write.mode(mode).text(path)
