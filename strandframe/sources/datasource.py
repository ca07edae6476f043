"""format("fasta"), format("fastq") and format("seqfile"): Python data sources over mounted paths.

They serve sessions that want spark.read.format(...); files.py reads any file system that Spark itself can. Filters on path,
format, seq_id, name and comment are pushed into the readers: other files aren't opened, or no further than to their first
mark, and of other records only headers are decoded.
"""

from __future__ import annotations

import glob
import gzip
import os
import uuid
import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as spark_source
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .parse import records

FIELDS = "path string, seq_id long, format string, name string, comment string, sequence string, quality string"


def mounted(path: str) -> str:
    """A path of Spark as one of the file system."""
    return path.removeprefix("file://").removeprefix("file:")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


#: What a pushed filter asks of a column's value, which is never null in these columns.
_TESTS: dict[type, Callable[[object, object], bool]] = {
    spark_source.EqualTo: operator.eq,
    spark_source.EqualNullSafe: operator.eq,
    spark_source.GreaterThan: operator.gt,
    spark_source.GreaterThanOrEqual: operator.ge,
    spark_source.LessThan: operator.lt,
    spark_source.LessThanOrEqual: operator.le,
    spark_source.In: lambda v, x: v in x,
    spark_source.StringStartsWith: lambda v, x: v.startswith(x),
    spark_source.StringEndsWith: lambda v, x: v.endswith(x),
    spark_source.StringContains: lambda v, x: x in v,
    spark_source.IsNotNull: lambda v, _: True,
}
_PUSHED = ("path", "format", "seq_id", "name", "comment")


class _Chosen:
    """Asked for each header of a file, in order; number is that of the last one."""

    def __init__(self, fits: Callable[..., bool]):
        self.fits, self.number = fits, -1

    def __call__(self, name: str, comment: str) -> bool:
        self.number += 1
        return self.fits(seq_id=self.number, name=name, comment=comment)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, form: str):
        self.form, path = form, mounted(options.get("path", ""))
        self.pushed: list[tuple[str, type, object]] = []
        if os.path.isdir(path):
            self.paths = sorted(p for p in glob.glob(f"{path}/*") if os.path.isfile(p) and os.path.basename(p)[0] not in "._")
        else:
            self.paths = sorted(glob.glob(path))
        if not self.paths:
            raise FileNotFoundError(f"no file at {path!r}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what can be told from a path, a first mark or a header; the rest stays Spark's."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PUSHED and getattr(f, "value", "") is not None:
                self.pushed.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def fits(self, **values: object) -> bool:
        return all(_TESTS[kind](values[c], x) for c, kind, x in self.pushed if c in values)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths if self.fits(path=p)]

    def read(self, partition: _File) -> Iterator[tuple]:
        chosen = _Chosen(self.fits)
        with open(partition.path, "rb", buffering=0) as f:  # read as records are asked for, whatever the file's size
            for r in records(f, self.form, chosen, lambda found: self.fits(format=found)):
                yield (partition.path, chosen.number, *r)


class _Writer(DataSourceWriter):
    """Each task writes a file under a temporary name; the names become final together on commit."""

    def __init__(self, options: dict, form: str, schema: StructType, overwrite: bool):
        self.path, self.form, self.names, self.overwrite = mounted(options["path"]), form, schema.names, overwrite
        self.width = int(options.get("linewidth", 80))
        self.comment = str(options.get("includecomment", "false")).lower() == "true"
        self.case, self.gzip = options.get("basecase", "original"), str(options.get("gzip", "false")).lower() == "true"
        if self.case not in ("original", "upper", "lower"):
            raise ValueError("baseCase must be upper, lower or original")
        self.before = glob.glob(f"{self.path}/part-*") if overwrite else []

    def _fold(self, s: str) -> str:
        if self.case == "original":
            return s
        change = str.upper if self.case == "upper" else str.lower
        return "".join(change(c) if c.isascii() else c for c in s)

    def _text(self, row: dict) -> str:
        head = ("@" if self.form == "fastq" else ">") + (row.get("name") or "")
        if self.comment and row.get("comment"):
            head += f" {row['comment']}"
        s = self._fold(row.get("sequence") or "")
        if self.form == "fastq":
            return f"{head}\n{s}\n+\n{row.get('quality') or ''}\n"
        lines = [s[i : i + self.width] for i in range(0, len(s), self.width)] if self.width > 0 else [s]
        return "\n".join([head, *(lines or [""])]) + "\n"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.{self.form}" + (".gz" if self.gzip else "")
        temporary, final = f"{self.path}/_{name}", f"{self.path}/{name}"
        with gzip.open(temporary, "wt", encoding="utf-8") if self.gzip else open(temporary, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(self._text(dict(zip(self.names, row, strict=True))))
        return _Written(temporary, final)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for old in self.before:
            os.remove(old)
        for m in filter(None, messages):
            os.replace(m.temporary, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in filter(None, messages):
            if os.path.exists(m.temporary):
                os.remove(m.temporary)


class _Sequences(DataSource):
    form = "auto"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self.form)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, "fasta" if self.form == "auto" else self.form, schema, overwrite)


class FastaDataSource(_Sequences):
    """Options of a writer: lineWidth, includeComment, baseCase, gzip."""

    form = "fasta"

    @classmethod
    def name(cls) -> str:
        return "fasta"


class FastqDataSource(_Sequences):
    form = "fastq"

    @classmethod
    def name(cls) -> str:
        return "fastq"


class SequenceFileDataSource(_Sequences):
    """Reads either format, told by the file's first mark."""

    @classmethod
    def name(cls) -> str:
        return "seqfile"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaDataSource, FastqDataSource, SequenceFileDataSource):
        spark.dataSource.register(source)
