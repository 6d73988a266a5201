"""From a corpus to training shards: one stage after the other, each written and read again.

Every stage takes (spark, docs, sf_dir); `docs` has the columns of documents, and so has
what all stages but the last return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybook.llm import decontamination, jaccard, mixing, shards, toxicity
from waybook.sources.scratch import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus' labels, calls toxic go."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard.distinct(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at least a twentieth of whose words lie in windows of the benchmark go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of smaller sources again, up to one and a half passes."""
    return mixing.mixed(docs, repeats=1.5)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 contiguous shards of about equal bytes: doc_id, size, text_crc32, shard, slot, source."""
    return shards.balanced(docs, 24, carry=["source"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", accepted), ("jaccard_join", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
