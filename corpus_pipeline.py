"""A training-data pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

Defined results: documents without text have no words and fail the quality rules;
null language or source are groups of their own throughout; rows without doc_id are
judged like any other and are nobody's copies; of rows that repeat a doc_id, one of
each text passes the near-dedup; ties go to the smallest doc_id there, and to a
seeded hash in the mix, which may take a document twice; very long texts are read
whole; an empty table stays empty; columns besides those of documents ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from rostrum.llm.shared import kept

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id. Five words and a similarity of 0.8, as near-duplicate stages take
    (the contract of ``op8`` alone says four)."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not cover by a twentieth or more."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights; a document that is taken twice is there twice."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, and where each row goes: shard and slot."""
    return sharding.shard(docs, shards=SHARDS).select(*docs.columns, "__s.shard", "__s.slot")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: The mix is fitted by dynamic programming and the shards by iterated medians, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = done if i == len(STAGES) - 1 else kept(done)
    return docs
