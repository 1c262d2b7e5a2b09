"""Entry points: replay a recording, simulate, audit, benchmark a replay."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer, signal
from ..operators import align, stats, windows
from ..schema import AuditConfig
from ..sources import corec, simulate
from . import packets, reports

GAZE = ["x", "y", "pupil_diameter"]


def scans(spark: SparkSession, path: str, limit: int = 0, mode: str = "replay") -> tuple[DataFrame, DataFrame]:
    """EEG and gaze frames of a file or folder of recordings; ``limit`` EEG frames of each (0: all).

    Every EEG frame has its own recording's ``rate_hz``, gaze frames a frame
    (``ratio``) and newest gaze frames held (``cap``).
    """
    corec.register(spark)
    read = lambda section: spark.read.format("corec").option("section", section).load(path)
    rate = F.col("sample_rate_hz")
    cap = F.floor(rate) if mode == "replay" else F.lit(256)
    headers = read("header").select("recording", rate.alias("rate_hz"), F.when(rate > 0, F.col("gaze_rate_hz") / rate).otherwise(0.0).alias("ratio"), cap.cast("bigint").alias("cap"))
    eeg = read("eeg").join(headers, "recording")
    return (eeg.where(F.col("sequence_id") < limit) if limit else eeg), read("gaze")


def predictions(aligned: DataFrame, model: str | None, size: int, stride: int, by: list[str]) -> DataFrame:
    """keys, window_end and the model's prediction of every full window; no model file gives the seeded one for as many channels."""
    full = packets.model_windows(aligned, size, stride, by)
    return full.select(*by, "window_end", infer.classifier(model, None, size)("eeg", "gaze").alias("prediction"))


def replay(spark: SparkSession, path: str, model: str | None = None, mode: str = "replay", limit: int = 0, with_model: bool = False, size: int = 500, stride: int = 100) -> DataFrame:
    """Fused packets of recordings; ``limit`` EEG frames of each (0: all).

    ``with_model`` classifies full windows by ``model`` or, without a file, by the
    seeded network; otherwise the stub's constant stands in.
    """
    eeg, gaze = scans(spark, path, limit, mode)
    by = ["recording"]
    if mode == "nearest":
        aligned = align.asof_nearest(eeg, gaze, GAZE, by)
    else:
        aligned = align.asof_buffered(eeg, gaze, GAZE, mode, by=by, limits=("ratio", "cap"))
    if not with_model:
        return packets.fused_packets(aligned, by=by, size=size, stride=stride, rate_column="rate_hz")
    numbered = windows.with_row_number(aligned, "timestamp_ns", by, ties=["sequence_id"])
    got = predictions(numbered, model, size, stride, by).withColumnRenamed("window_end", "rn")
    joined = numbered.join(got, [*by, "rn"], "left")
    known = F.when(F.col("prediction.classification").isNotNull(), F.col("prediction"))
    return packets.fused_packets(joined, by=by, size=size, stride=stride, prediction=known, rate_column="rate_hz")


def simulate_live(spark: SparkSession, seconds: float = 1.0, channels: int = 64, rate_hz: float = 256.0, gaze_rate_hz: float = 60.0) -> DataFrame:
    """Packets of simulated streams as a live feed has them.

    Gaze comes with the first EEG frame at or after its interval's end, so with
    every so-manieth frame; windows that are not full count as ``observe``.
    """
    step = -(-int(1e9 / gaze_rate_hz) // int(1e9 / rate_hz))
    frames = int(seconds * rate_hz)
    eeg = simulate.simulated_eeg(spark, frames, channels, rate_hz)
    gaze = simulate.simulated_gaze(spark, -(-frames // step), gaze_rate_hz)
    aligned = align.asof_buffered(eeg, gaze, GAZE, "live", float(step))
    return packets.fused_packets(aligned, rate_hz, waiting_class="observe")


def audit(spark: SparkSession, packet_count: int = 100_000, channels: int = 64, samples_per_channel: int = 500, drop_rate: float = 0.0, corrupt_rate: float = 0.0) -> DataFrame:
    """The one-row report; a packet count of 0 means 10,000, as for a remote caller."""
    cfg = AuditConfig(packet_count=packet_count or 10_000, channel_count=channels, samples_per_channel=samples_per_channel, drop_rate=drop_rate, corrupt_rate=corrupt_rate)
    return reports.audit_report(reports.audit_packets(spark, cfg))


def replay_bench(spark: SparkSession, path: str, limit: int = 0) -> dict:
    """What a replay with everything preloaded gives, and how fast it went.

    ``features`` counts every hundredth fused frame, for which the spatial
    features over the channels of one tick are computed.
    """
    began = time.perf_counter()
    eeg, gaze = scans(spark, path, limit, "bench")
    aligned = align.asof_buffered(eeg, gaze, GAZE, "bench", by=["recording"], limits=("ratio", "cap"))
    numbered = windows.with_row_number(align.with_degraded(aligned), "timestamp_ns", ["recording"], ties=["sequence_id"])
    sampled = F.when(F.pmod("rn", F.lit(100)) == 0, F.col("channels"))
    rows = numbered.withColumn("features", signal.features_arrow(None)(sampled, "rate_hz")).persist()
    offset = F.abs("alignment_offset_ns")
    held = stats.histogram_percentiles(stats.log2_histogram(rows.select(offset.alias("ns")), "ns"), [50.0, 90.0, 99.0]).collect()
    row = rows.agg(
        F.count(F.lit(1)).alias("fused"),
        F.coalesce(F.sum(1.0 / F.col("rate_hz")), F.lit(0.0)).alias("recorded_s"),
        F.count("features").alias("features"),
        F.count_if((F.col("rn") >= 500) & (F.pmod("rn", F.lit(100)) == 0)).alias("inferences"),
        F.coalesce(F.avg(F.col("degraded").cast("double")) * 100, F.lit(0.0)).alias("degraded_percent"),
        F.coalesce(F.avg(offset.cast("double")), F.lit(0.0)).alias("mean_alignment_ns"),
    ).first()
    rows.unpersist()
    seconds = time.perf_counter() - began
    percentiles = {f"offset_p{p}_ns": 0 for p in (50, 90, 99)} | {f"offset_p{int(r.p)}_ns": r.ns for r in held}
    return row.asDict() | percentiles | {"elapsed_s": seconds, "frames_per_s": row.fused / seconds, "real_time_factor": row.recorded_s / seconds}
