"""Record types as explicit schemas.  Time is whole nanoseconds in a BIGINT."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "DECIMAL(20,0)": T.DecimalType(20, 0)}


def _struct(fields: str) -> T.StructType:
    """A schema from "name TYPE" pairs; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


EEG_FRAME = _struct("timestamp_ns BIGINT, channels ARRAY<FLOAT>, sequence_id BIGINT")
GAZE_FRAME = _struct("timestamp_ns BIGINT, x FLOAT, y FLOAT, pupil_diameter FLOAT")
FUSED_PACKET = _struct(
    "timestamp_ns BIGINT, sequence_id BIGINT, eeg_channels ARRAY<FLOAT>, gaze_x FLOAT, gaze_y FLOAT, pupil_diameter FLOAT, "
    "alignment_offset_ns BIGINT, features ARRAY<FLOAT>, confidence FLOAT, classification STRING"
)
EMBEDDING_PACKET = _struct(
    "timestamp_ns BIGINT, sequence_id BIGINT, eeg_features ARRAY<FLOAT>, gaze_x FLOAT, gaze_y FLOAT, pupil_diameter FLOAT, alignment_offset_ns BIGINT, raw_eeg ARRAY<FLOAT>"
)
#: Packet timestamps span all of unsigned 64 bits, hence the decimal.
NEURAL_PACKET = _struct("timestamp_ns DECIMAL(20,0), channel_count BIGINT, samples ARRAY<FLOAT>, sequence_id BIGINT, error STRING")
COREC_HEADER = _struct("sample_rate_hz DOUBLE, eeg_channels BIGINT, gaze_rate_hz DOUBLE, num_eeg_frames BIGINT, num_gaze_frames BIGINT")
PREDICTION = _struct("confidence FLOAT, classification STRING, inference_ns BIGINT")


@dataclass(frozen=True)
class AuditConfig:
    """Knobs of a self-measurement run."""

    packet_count: int = 100_000
    channel_count: int = 64
    samples_per_channel: int = 500
    sample_rate_hz: float = 256.0
    ring_capacity: int = 4096
    backpressure: str = "block"
    drop_rate: float = 0.0
    corrupt_rate: float = 0.0
    pin_cores: bool = False
