"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorweave.llm.near_dedup import NearDup, deduplicated
from sensorweave.llm.packing import pack_documents
from sensorweave.llm.passages import without_passages
from sensorweave.llm.quality import clean_documents
from sensorweave.llm.secrets import redact_documents
from sensorweave.llm.shared import scratch, shared_folder


#: A pair at the threshold shares no band with probability (1 - 0.8**6)**41, 4e-6.
NEAR = NearDup(percent=80, bands=41, rows=6)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed, documents that lose too much go."""
    return clean_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return deduplicated(docs, NEAR)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    return without_passages(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", passage_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: MinHash, chaining and tokenising have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again; a stage's own tables go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
