"""BPE encoding and decoding of whole texts by a depth-first walk of the trie of their distinct words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordCodec
from .common import documents, expose, groups, kept

VOCABULARY = "word_bpe_49k.json"


def _codec(vocabulary: str) -> WordCodec:
    """One for each vocabulary and worker; its table of words lives from task to task."""
    return kept((WordCodec, hash(vocabulary)), lambda: WordCodec(vocabulary))


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digests") -> DataFrame:
    """For each row of docs its id, n_tokens, and with outputs="values" ids and decoded, with "digests" their sha256.

    vocabulary_path is a tokenizers file read on the driver; its content, a few MB whatever the input, is broadcast. Null
    texts count as empty, which gives no ids and an empty decoded text. Rows that repeat give the same again, extra
    columns are not read, an empty table gives no rows. Nothing is shuffled.
    """
    spark = expose(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(Path(vocabulary_path).read_text())
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("id", id_type), T.StructField("n_tokens", T.LongType())]
    if outputs == "values":
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    else:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    digest = outputs != "values"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value)
        for batch in batches:
            texts, n, a, b = batch.column("text").to_pylist(), [], [], []
            for lo, hi in groups(texts):
                ids, begins, decoded = codec.run(texts[lo:hi])
                n.append(np.diff(begins))
                ids = ids.astype("<i4" if not digest else "<u4")
                if digest:
                    raw, at = memoryview(ids.tobytes()), (4 * begins).tolist()
                    a.append(pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:], strict=False)], pa.string()))
                    b.append(pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded], pa.string()))
                else:
                    a.append(pa.array(ids))
                    b.append(decoded)
            sizes = np.concatenate([np.empty(0, np.int64), *n])
            first, second = pa.concat_arrays(a) if a else pa.array([], pa.string() if digest else pa.int32()), pa.concat_arrays(b) if b else pa.array([], pa.string())
            if not digest:
                first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), first)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), first, second], names=[f.name for f in fields])

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, T.StructType(fields))
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
