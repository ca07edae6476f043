"""Sequence files as a stream, and a stream as sequence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..sources.files import decoded

CONTENTS = "path string, modificationTime timestamp, length long, content binary"


def stream_sequences(spark: SparkSession, path: str, form: str = "auto", files_a_batch: int | None = None) -> DataFrame:
    """sources.files.read_sequences() of files as they appear in a folder: path, seq_id, format, name, comment, sequence, quality.

    Which files have been read is in the query's checkpoint, so a restart goes on with the next one. A micro-batch takes
    files_a_batch files (none given: all that are there), oldest first. Files are to be moved in whole and not to be changed
    after that; they may be of up to 2 GB, plain or gzip, of any file system of Spark. An empty one has no records; one
    that is not of the form fails the query, which goes on with the same files once it is mended.
    """
    if files_a_batch is not None and files_a_batch < 1:
        raise ValueError("files_a_batch must be positive")
    source = spark.readStream.format("binaryFile").schema(CONTENTS)
    if files_a_batch is not None:
        source = source.option("maxFilesPerTrigger", files_a_batch)
    return decoded(source.load(path), form)


def write_epochs(df: DataFrame, path: str, checkpoint: str, text: Column, compression: str = "none") -> DataStreamWriter:
    """A writer of the stream's records, one a row by sources.files.fasta_text() or another such column; start() it as usual.

    Micro-batch n is the folder epoch=n of path. One that is run again, as its commit was lost, replaces its folder, so
    nothing is there twice; read path/epoch=* with sources.files.read_sequences() or scan_fasta(). Nothing else may write to path.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(text.alias("value")).write.mode("overwrite").option("compression", compression).text(f"{path}/epoch={epoch}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
