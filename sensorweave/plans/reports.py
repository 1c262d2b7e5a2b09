"""One-row reports of self-measurement, replay and clients, and their renderings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, wire
from ..operators import faults, stats
from ..schema import AuditConfig

PERCENTS = (50.0, 90.0, 99.0, 99.9)


def audit_packets(spark: SparkSession, cfg: AuditConfig, send_step_ns: int = 125_000, slices: int = 8) -> DataFrame:
    """Every packet with its faults, decoded: packet, dropped, corrupted, send_ns, recv_ns, error.

    Times are columns, so a run is reproducible: packets leave every
    ``send_step_ns`` and take 42 to 300 microseconds by their number's noise.
    """
    samples = F.transform(F.sequence(F.lit(0), F.lit(cfg.channel_count * cfg.samples_per_channel - 1)), lambda i: F.sin(i.cast("float").cast("double")).cast("float"))
    n = cfg.channel_count * cfg.samples_per_channel
    size = len(wire.encode_packet(1 << 60, cfg.channel_count, [0.0] * n, cfg.packet_count))
    plan = faults.fault_plan(spark, cfg.packet_count, cfg.drop_rate, cfg.corrupt_rate, size).repartition(slices, "packet")
    send = F.lit(1 << 60) + F.col("packet") * send_step_ns
    sent = plan.select("packet", "dropped", F.col("position").isNotNull().alias("corrupted"), "position", send.alias("send_ns"))
    sent = sent.withColumn("recv_ns", F.col("send_ns") + 42_100 + F.pmod(F.shiftrightunsigned(scalar.xorshift(F.col("packet")), 3), F.lit(258_000)))
    payload = wire.encode_neural_packet("send_ns", F.lit(cfg.channel_count).cast("bigint"), samples, "packet")
    got = F.when(~F.col("dropped"), wire.decode_neural_packet(faults.flip_byte(payload, "position")))
    return sent.withColumn("packet_out", got).select("packet", "dropped", "corrupted", "send_ns", "recv_ns", F.col("packet_out.error").alias("error"))


def audit_report(packets: DataFrame) -> DataFrame:
    """One row: counters, latency percentiles, jitter, throughput, loss."""
    got = packets.where("NOT dropped")
    counts = packets.agg(
        F.count_if(~F.col("dropped")).alias("packets_sent"),
        F.count_if(~F.col("dropped")).alias("packets_received"),
        F.count_if("dropped").alias("packets_dropped"),
        F.count_if("corrupted").alias("packets_corrupted"),
        F.count("error").alias("decode_errors"),
        F.coalesce((F.max("recv_ns") - F.min("send_ns")) / 1e6, F.lit(0.0)).alias("duration_ms"),
    )
    latency = got.where("error IS NULL AND recv_ns >= send_ns").select((F.col("recv_ns") - F.col("send_ns")).alias("ns"))
    percentiles = stats.histogram_percentiles(stats.log2_histogram(latency, "ns"), list(PERCENTS))
    named = percentiles.agg(*[F.coalesce(F.max(F.when(F.col("p") == p, F.col("ns"))), F.lit(0)).cast("bigint").alias(f"latency_p{str(p).removesuffix('.0').replace('.', '')}_ns") for p in PERCENTS])
    summary = latency.agg(*stats.latency_summary(F.col("ns"))).select(F.col("mean_ns").alias("latency_mean_ns"), F.col("min_ns").alias("latency_min_ns"), F.col("max_ns").alias("latency_max_ns"))
    jitter = stats.jitter(got, "recv_ns", order=["packet"], width=1 << 16).select(F.col("jitter_std_dev").alias("jitter_std_dev_ns"), F.col("mean_interval").alias("mean_interval_ns"))
    row = counts.crossJoin(named).crossJoin(summary).crossJoin(jitter)  # one row each
    return row.withColumn("throughput_pps", stats.throughput_pps(F.col("packets_received"), F.col("duration_ms"))).withColumn("loss_fraction", stats.loss_fraction(F.col("packets_sent"), F.col("packets_dropped"), F.col("decode_errors"))).withColumn("heap_allocs", F.lit(0).cast("bigint"))


def client_summary(packets: DataFrame) -> DataFrame:
    """What a subscriber counts: packets, classes (none counts as observe), and picks over its intervals; times of 0 are left out."""
    classes = F.coalesce(F.nullif(F.trim("classification"), F.lit("")), F.lit("observe"))
    counts = packets.agg(F.count(F.lit(1)).alias("packets"), F.count_if(classes == "intent").alias("intent"), F.count_if(classes == "observe").alias("observe"), F.count_if(classes == "accumulating").alias("accumulating"), F.coalesce(F.avg("confidence"), F.lit(0.0)).cast("double").alias("mean_confidence"))
    steps = stats.intervals(packets.where("timestamp_ns > 0"), "timestamp_ns", order=["sequence_id"], width=1 << 16).where("interval IS NOT NULL")
    return counts.crossJoin(stats.picked_percentiles(steps, "interval").withColumnRenamed("count", "intervals").withColumnRenamed("mean", "mean_interval"))


def replay_report(packets: DataFrame, rate_hz: float, elapsed_ms: int, n_eeg: int) -> DataFrame:
    """Frames, fusion quality, predictions, whole frames a second and real-time factor."""
    ready = F.col("classification") != "accumulating"
    out = packets.agg(
        F.lit(n_eeg).cast("bigint").alias("eeg_frames"),
        F.count(F.lit(1)).alias("fused"),
        F.count_if(ready).alias("inferences"),
        F.count_if(F.col("classification") == "intent").alias("intent"),
        F.count_if(F.col("classification") == "observe").alias("observe"),
        F.coalesce(F.avg(F.abs("alignment_offset_ns").cast("double")), F.lit(0.0)).alias("mean_alignment_ns"),
        F.coalesce(F.avg((F.abs("alignment_offset_ns") > 10_000_000).cast("double")) * 100, F.lit(0.0)).alias("degraded_percent"),
    )
    frames, ms = F.col("eeg_frames"), F.lit(elapsed_ms).cast("bigint")
    return out.withColumn("fps", stats.frames_per_second(frames, ms)).withColumn("real_time_factor", stats.real_time_factor(frames, F.lit(rate_hz), ms))


def render(row: dict, config: dict | None = None, fmt: str = "table", compare: dict | None = None) -> str:
    """A report row as ``table``, ``markdown`` or ``json``, with an optional column to compare with."""
    if fmt == "json":
        return json.dumps({"config": config or {}, "results": row}, indent=2, default=str)
    shown = {k: f"{v:,.3f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v) for k, v in row.items()}
    if fmt == "markdown":
        head = ["metric", "value", *(["compared with"] if compare else [])]
        lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
        return "\n".join(lines + ["| " + " | ".join([k, v, *([str(compare.get(k, "-"))] if compare else [])]) + " |" for k, v in shown.items()])
    if fmt != "table":
        raise ValueError(fmt)
    width = max(map(len, shown), default=0)
    return "\n".join(f"{k:<{width}}  {v:>20}" + (f"  {compare.get(k, '-')!s:>20}" if compare else "") for k, v in shown.items())
