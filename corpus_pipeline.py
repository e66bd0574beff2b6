"""The corpus pipeline: five operators one after the other, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; the last returns the
shard manifest. Stages take nulls, empty and long texts, repeated rows, empty tables and extra
columns as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenota.llm import decontaminate, fertility, mixing, neardup, sharding
from lumenota.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the fertility bands reject."""
    return fertility.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix takes them, in training order."""
    return mixing.training_order(docs)


def hilbert_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every document of the mix to a shard and a slot."""
    return sharding.shard_stage(spark, docs, sf_dir)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", hilbert_shards),
]

#: Tokenisers, sampled signatures and checksums have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
