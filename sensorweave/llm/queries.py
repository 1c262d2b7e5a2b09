"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, licenses, near_dedup, oracles, packing, passages, pieces, quality, secrets, sharding, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_documents(spark, sf_dir))


def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_documents(spark, sf_dir))


def op4_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op10_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(_documents(spark, sf_dir))


QUERIES = (
    op1_ring_sharding,
    op2_license_scan,
    op3_shared_passages,
    op4_window_packing,
    op5_line_quality,
    op6_near_dedup,
    op7_merge_dropout,
    op8_token_files,
    op9_secret_scan,
    op10_multiset_fingerprint,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {
        op5_line_quality.__name__: oracles.QUALITY,
        op6_near_dedup.__name__: oracles.NEAR_DUP,
        op10_multiset_fingerprint.__name__: oracles.FINGERPRINT,
    }
