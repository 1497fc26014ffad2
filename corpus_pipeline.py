"""From raw documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.shared import delete, delete_at_end, scope, shared_dir
from loomgraph.llm import decontaminate, jaccard, mixing, quality, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines and the documents that the rules reject go."""
    return quality.apply_rules(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay away, stay, or come again, as their sources' targets ask for."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shard),
]

#: Near duplicates, mixing and the ring are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes once the next one is written, the last one when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_end(spark, at)
    for n, (_, stage) in enumerate(STAGES):
        with scope(spark):  # what the stage writes for itself goes once it is written
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
        if n:
            delete(spark, f"{at}/{n - 1}")
    return docs
