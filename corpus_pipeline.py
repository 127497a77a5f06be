"""A corpus pipeline of five of the training-data operators.

Quality classifier, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, mixing to
target weights. Each stage works on all that the one before it kept, and its decisions take
effect: rejected documents, all but one document of a group of near-duplicates, repeated passages
and documents with benchmark items go; the last stage draws the sample.

Defined results: every stage accepts nulls, empty texts and empty tables as its operator does, and
keeps the input's columns and their types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideflow.llm import decontamination, mixing, ngram_join, quality, suffix_dedup
from tideflow.llm.common import deleted, scratch, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", join_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier is trained on the data, which SQL cannot express; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    What a stage has read, and the tables that it wrote on its way, go once its own result is written.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            deleted(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
