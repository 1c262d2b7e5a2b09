"""Fused packets: alignment, features, windows and predictions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import infer, signal
from ..operators import align, windows


def fused_packets(aligned: DataFrame, rate_hz: float = 256.0, features: bool = True, size: int = 500, stride: int = 100, by: list[str] = [], prediction: Column | None = None, waiting_class: str = "accumulating", width_ns: int | None = None, rate_column: str | None = None) -> DataFrame:  # noqa: B006
    """Packets of an alignment result (``channels``, ``x``, ``y``, ``pupil_diameter``), numbered over emitted rows.

    A row is ready for prediction from ``size`` rows on, every ``stride`` rows.
    Rows are numbered by buckets of ``width_ns`` (a minute without keys) or, with
    keys alone, key by key.  ``rate_column`` holds each row's sampling rate where
    recordings differ.
    """
    if by and width_ns is None:
        df = windows.with_row_number(aligned, "timestamp_ns", by, "__rn", ["sequence_id"])
    else:
        df = windows.with_global_row_number(aligned, "timestamp_ns", width_ns or align.MINUTE_NS, "__rn", by, ["sequence_id"])
    ready = (F.col("__rn") >= size) & (F.pmod(F.col("__rn"), F.lit(stride)) == 0)
    got = infer.with_fallback(ready, prediction if prediction is not None else infer.stub_prediction(), waiting_class)
    vector = signal.features_arrow(None if rate_column else rate_hz)("channels", *([rate_column] if rate_column else [])).cast("array<float>") if features else F.array().cast("array<float>")
    df = df.withColumn("__p", got)
    return df.select(
        *by,
        "timestamp_ns",
        (F.col("__rn") - 1).alias("sequence_id"),
        F.col("channels").alias("eeg_channels"),
        F.col("x").cast("float").alias("gaze_x"),
        F.col("y").cast("float").alias("gaze_y"),
        F.col("pupil_diameter").cast("float").alias("pupil_diameter"),
        "alignment_offset_ns",
        vector.alias("features"),
        F.col("__p.confidence").alias("confidence"),
        F.col("__p.classification").alias("classification"),
    )


def embedding_packets(packets: DataFrame, include_raw: bool = True, include_features: bool = True) -> DataFrame:
    """The projection without the class; requested parts only."""
    cut = packets.withColumnRenamed("features", "eeg_features").withColumnRenamed("eeg_channels", "raw_eeg").drop("confidence", "classification")
    if not include_raw:
        cut = cut.drop("raw_eeg")
    return cut if include_features else cut.drop("eeg_features")


def model_windows(aligned: DataFrame, size: int = 500, stride: int = 100, by: list[str] = [], ring: bool = False) -> DataFrame:  # noqa: B006
    """Full windows as flat arrays for a model: channel-major and chronological, or time-major in ring order.

    ``aligned`` needs a dense 1-based ``rn`` within ``by``.
    """
    members = windows.hop_members(aligned, size, stride)
    slot = windows.ring_slot(F.col("rn"), size) if ring else F.col("slot")
    tick = F.struct(slot.alias("slot"), F.col("channels").alias("c"), F.array(*[F.col(n).cast("float") for n in ("x", "y", "pupil_diameter")]).alias("g"))
    full = windows.complete_windows(members, size, by, [F.array_sort(F.collect_list(tick)).alias("ticks")])

    def flat(part: str) -> Column:
        rows = F.transform("ticks", lambda t: t[part])
        if ring:
            return F.flatten(rows)
        n = F.size(rows[0])
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.transform(F.col("ticks"), lambda t: t[part][c])))

    # behind a generator, so that a model's UDF over the arrays is not folded into the aggregation
    return full.select(F.inline(F.array(F.struct(*by, "window_end", flat("c").alias("eeg"), flat("g").alias("gaze")))))


def replay(eeg: DataFrame, gaze: DataFrame, rate_hz: float, gaze_rate_hz: float, mode: str = "nearest", by: list[str] = [], **kwargs) -> DataFrame:  # noqa: B006
    """Recording to packets: ``nearest`` aligns with all gaze, ``replay`` and ``bench`` with the buffers of a player."""
    columns = ["x", "y", "pupil_diameter"]
    if mode == "nearest":
        aligned = align.asof_nearest(eeg, gaze, columns, by)
    else:
        cap = int(rate_hz) if mode == "replay" else 256
        aligned = align.asof_buffered(eeg, gaze, columns, mode, gaze_rate_hz / rate_hz, cap, by)
    return fused_packets(aligned, rate_hz, by=by, **kwargs)
