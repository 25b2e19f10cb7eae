"""A corpus pipeline of five stages; each is a decision that takes effect on what its predecessor kept.

Every stage but the last returns the columns of documents; its result is written as Parquet and read back as the next
one's documents, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, jaccard, language_id, mixing, sharding
from tidewatch.llm.common import materialize, release


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts of no language go."""
    return language_id.keep_identified(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of a group of near-duplicates the document with the smallest id stays."""
    return jaccard.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with any benchmark passage go (a coverage limit of 0)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are drawn so that sources, languages and topics meet their target shares."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: each document gets a shard and a slot."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("ngram_jaccard_join", dedup),
    ("decontamination", clean),
    ("mixing", mix),
    ("sharding", shard),
]

#: Trained models and the raking loop are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}-{name}")
            if k:
                release(before)
            before = docs
    return docs
