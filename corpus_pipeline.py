"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import documents, finished, fold
from strandframe.llm.exact_dedup import keep_one_copy
from strandframe.llm.jaccard_join import keep_one_of_group
from strandframe.llm.language_id import UNKNOWN, identify, learn
from strandframe.llm.mixing import mixed_documents
from strandframe.llm.word_codec import VOCABULARY, encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language has a lower probability are rejected.
SURE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network, trained on their labels, recognises a language."""
    net = learn(docs, fold(F.col("doc_id"), 5) != 0)
    found = identify(docs, net, keep=True)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= SURE)).select(*docs.columns)


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return keep_one_copy(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates."""
    return keep_one_of_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document of the mix."""
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), outputs="values")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_copy),
    ("jaccard_join", one_of_near_copies),
    ("mixing", mixed),
    ("word_codec", encoded),
]

#: No stage after the first can be written in SQL without the network; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again, and then its intermediate tables go."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for _, stage in STAGES:
        docs = finished(spark, partial(stage, spark, docs, sf_dir))
    return docs
