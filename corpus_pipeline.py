"""The training-corpus pipeline: five stages, each on all that the one before it kept.

Quality rejects poor documents, toxicity rejects abuse, the near-duplicate stage (simhash) leaves one document of each group of
texts whose five-word shingles have a Jaccard similarity of 0.8 or more, mixing repeats and drops documents so that sources
meet their weights, and SentencePiece turns what is left into ids.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import mixing, piece, quality, simhash, toxicity
from veilwork.llm.runtime import checkpoint_folder, remove, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece.encoded_digests(docs, with_ids=True)


STAGES = [("quality", good), ("toxicity", clean), ("simhash", distinct), ("mixing", mixed), ("sentencepiece", encoded)]

#: The learned, hashed and encoded stages are not SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage's table goes when the next one is written; the last one read stays in the checkpoint folder."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
