"""A corpus from `documents`: five stages, each written as Parquet and read again before the next.

Stages keep the columns of documents; the last gives each remaining document's token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, order_minhash, quality_ftrl, sentencepiece_codec, window_dedup
from seqloom.llm.common import shared_dir, table
from seqloom.llm.queries import tokenizer

#: Words that a worker of the last stage remembers: the stages before leave more workers than cores, and all of them take part.
WORDS = 300_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    model = quality_ftrl.fit(docs, table(spark, sf_dir, "labels"))
    return quality_ftrl.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest doc_id stays."""
    return order_minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a document of a smaller doc_id has too go from the text."""
    return with_length(window_dedup.without_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of the benchmark go from the text."""
    return with_length(decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of each document that is left."""
    return sentencepiece_codec.encode_documents(docs, tokenizer("piece_bpe_32k.model"), remembered=WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: A trained classifier and a tokenizer's vocabulary are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
