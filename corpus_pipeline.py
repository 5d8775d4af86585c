"""The training-data pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame; `run` writes it as Parquet below the shared checkpoint folder and reads it back for
the next one. All stages but the last return the columns of documents; the last one returns ids.

Null and empty texts are documents like others in every stage (the quality rules drop them, as
they have too few words); rows without an id are judged like others, and a stage that names rows by
id tells such rows apart by their texts; extra columns, whatever their names, are carried along up
to the last stage; an empty table passes all stages as an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plaintscope.llm import byte_bpe, decontamination, jaccard_join, quality_classifier, quality_rules
from plaintscope.session import checkpoint_dir


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.5 or more for quality."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality_rules.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without so many words of benchmark passages that they count as contaminated."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, for a trainer to read, with digests of ids and decoded bytes."""
    ranks = byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.with_round_trip(docs, ranks), keep_ids=True)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

# The classifier is a trained model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
