"""A training-data pipeline over ``documents``: five stages, each over all that the last one kept.

Quality rules reject documents; of each group of near copies one document
stays; documents that hold a benchmark item go; sources are mixed to their
weights (documents may then come more than once); and what is left is written
as token sequences in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakflow.llm import decontaminate, jaccard, mixing, quality, training_order
from peakflow.llm._spark import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's fences."""
    return quality.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents."""
    return jaccard.deduplicate(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each token sequence of the shards."""
    return training_order.sequence_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_items", benchmark_items),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]

#: Tokenising has no SQL form; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to shared scratch and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
