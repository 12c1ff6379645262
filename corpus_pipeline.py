"""The corpus pipeline: documents through five of the training-data operators, one after another.

Each stage works on all that its predecessor kept, is written as Parquet and read again. All but the last
return the columns of documents; the last returns the encoded documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, jaccard_join, mixing, pieces, resampling
from tidewater.llm.common import clear, delete, shared_dir, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; those that it rejects go."""
    return resampling.resampled(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id."""
    return jaccard_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their shares: documents are repeated, or left out."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return pieces.encoding_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The first stage's model and the last stage's library are beyond SQL; tests hold the pipeline
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Once a stage is written, what it has staged and its predecessor's output go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        out = f"{shared_dir(spark)}/tidewater/pipeline-{hashlib.sha256(name.encode()).hexdigest()[:8]}-{uuid.uuid4().hex}"
        first = staged()
        f(spark, docs, sf_dir).write.parquet(out)
        clear(spark, first)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
