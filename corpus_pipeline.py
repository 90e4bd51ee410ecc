"""The corpus pipeline: quality rules, SimHash near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes all that the one before kept, as Parquet, and is given back whole rows of documents, extra columns
of any name with them; the last returns each document's shard and slot. A null doc_id is a document like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, sharding, simhash
from tessera.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null, empty and short texts are rejected, long ones judged in whole; a share
    equal to its limit is kept, and each of repeated rows is judged alike. No documents: none."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id, null last; of equal ones, and of repeated rows, one
    row by its hash. Texts without words are one group. No documents: none."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, be the window's item_id null or not; null texts have no
    words and stay. Each of repeated rows is judged alike. No items: all stay. No documents: none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities; repeated rows share their fate, a null source or
    language is a value of its own. No documents: none."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's size, CRC, shard and slot; equal texts, null and empty among them, are one group, in which
    rows go by doc_id, null last. No documents: none."""
    return sharding.sharded(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: SQL can't express SimHash components or raking; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
