"""The test tables as sensor streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EEG_STEP_NS = 3_906_250
GAZE_STEP_NS = 16_666_667


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") * EEG_STEP_NS).alias("timestamp_ns"), F.col("embedding").alias("channels"), F.col("vec_id").cast("bigint").alias("sequence_id"))


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") * GAZE_STEP_NS).alias("timestamp_ns"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.lit(3.0).alias("pupil_diameter"), F.col("event_id").cast("bigint").alias("idx"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, ts_us, event_id, value of every event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("user_id"), "event_type", us.alias("ts_us"), F.col("event_id").cast("bigint").alias("event_id"), "value")


def two_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as anchors and views as the stream they align with."""
    events = arrivals(spark, sf_dir)
    return events.where("event_type = 'purchase'").drop("event_type"), events.where("event_type = 'view'").drop("event_type")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_returnflag and us from order to shipping, in microseconds; about half are negative."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("s"))
    return i.join(o, i.l_orderkey == o.o_orderkey).select("l_returnflag", (F.datediff("s", "o").cast("bigint") * 86_400_000_000).alias("us"))
