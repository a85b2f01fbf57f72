"""Corpus preparation: language, near duplicates, benchmark leaks, source mix and shards, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from episcope.llm import decontaminate, kdtree, language, mixing, queries, simhash
from episcope.llm.registry import table
from episcope.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language.keep_known(docs, language.fit_text_model(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: any head of the files has the target weights."""
    return mixing.mixed(docs, queries.WEIGHTS, queries.BLOCK_BYTES)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, their shard and slot. ``mix_rank`` is the row number in the mix's files:
    documents below any rank have the target weights until a source runs out, and each shard's slots follow it."""
    return kdtree.kd_shards(mixing.ranked_as_stored(docs), queries.document_coordinates(), queries.document_size(),
                            queries.SHARDS, order="mix_rank")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mix", in_target_mix),
    ("shards", in_shards),
]

#: Trained models, hashing and components have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
