"""Packed telemetry packets: protobuf encoding, decoding with row-level errors.

Fields: 1 timestamp (varint), 2 channel count (varint), 3 samples (bytes of
little-endian 32-bit floats), 4 sequence (varint).  A known field of another wire
type is skipped like an unknown one, the last of repeated fields wins, absent
fields are zero or empty.  A malformed packet yields its error's name instead.
"""

from __future__ import annotations

import decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..schema import NEURAL_PACKET

MASK_64 = (1 << 64) - 1
MASK_32 = (1 << 32) - 1
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


class DecodeError(ValueError):
    """Carries the error's name, as the error column shows it."""


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    """Value and next position.  The end of the buffer is noticed before an eleventh byte is."""
    value = shift = 0
    while True:
        if at >= len(buf):
            raise DecodeError("UnexpectedEof")
        if shift >= 70:
            raise DecodeError("VarintOverflow")
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & MASK_64, at
        shift += 7


def read_tag(buf: bytes, at: int) -> tuple[int, int, int]:
    tag, at = read_varint(buf, at)
    field = tag >> 3 & MASK_32
    if field == 0:
        raise DecodeError("InvalidFieldNumber")
    return field, tag & 7, at


def read_fixed(buf: bytes, at: int, size: int) -> tuple[int, int]:
    if at + size > len(buf):
        raise DecodeError("UnexpectedEof")
    return int.from_bytes(buf[at : at + size], "little"), at + size


def read_bytes(buf: bytes, at: int) -> tuple[bytes, int]:
    size, at = read_varint(buf, at)
    if at + size > len(buf):
        raise DecodeError("InvalidLength")
    return buf[at : at + size], at + size


def skip(buf: bytes, at: int, wire: int) -> int:
    if wire == VARINT:
        return read_varint(buf, at)[1]
    if wire == BYTES:
        return read_bytes(buf, at)[1]
    if wire in (FIXED64, FIXED32):
        return read_fixed(buf, at, 8 if wire == FIXED64 else 4)[1]
    raise DecodeError(f"InvalidWireType({wire})")


def decode_packet(buf: bytes) -> tuple[int, int, bytes, int]:
    """(timestamp, channel count, sample bytes, sequence)."""
    got = {1: 0, 2: 0, 3: b"", 4: 0}
    wanted = {1: VARINT, 2: VARINT, 3: BYTES, 4: VARINT}
    at = 0
    while at < len(buf):
        field, wire, at = read_tag(buf, at)
        if wanted.get(field) != wire:
            at = skip(buf, at, wire)
        elif wire == BYTES:
            got[field], at = read_bytes(buf, at)
        else:
            got[field], at = read_varint(buf, at)
    return got[1], got[2] & MASK_32, got[3], got[4] & MASK_32


def samples_of(data: bytes) -> np.ndarray:
    """Whole 32-bit floats; one to three bytes too many are ignored."""
    return np.frombuffer(data, "<f4", count=len(data) // 4)


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode_packet(timestamp_ns: int, channel_count: int, samples: np.ndarray, sequence_id: int) -> bytes:
    """Fields in order; zeros are written, empty samples are left out."""
    data = np.asarray(samples, "<f4").tobytes()
    body = b"\x1a" + varint(len(data)) + data if data else b""
    return b"\x08" + varint(timestamp_ns & MASK_64) + b"\x10" + varint(channel_count & MASK_32) + body + b"\x20" + varint(sequence_id & MASK_32)


@pandas_udf(BinaryType())
def _encoded(timestamp_ns: pd.Series, channel_count: pd.Series, samples: pd.Series, sequence_id: pd.Series) -> pd.Series:
    return pd.Series([encode_packet(int(t), int(c), s, int(q)) for t, c, s, q in zip(timestamp_ns, channel_count, samples, sequence_id, strict=True)])


def encode_neural_packet(timestamp_ns: Column | str, channel_count: Column | str, samples: Column | str, sequence_id: Column | str) -> Column:
    """The packet of each row, null where a number is null; null samples are none.

    The encoder sees no nulls, which would make a batch's whole numbers inexact.
    """
    t, n, s, q = (F.col(c) if isinstance(c, str) else c for c in (timestamp_ns, channel_count, samples, sequence_id))
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    packet = _encoded(whole(t), whole(n), F.coalesce(s, F.array().cast("array<float>")), whole(q))
    return F.when(t.isNotNull() & n.isNotNull() & q.isNotNull(), packet)


@pandas_udf(NEURAL_PACKET)
def decode_neural_packet(payload: pd.Series) -> pd.DataFrame:
    """Every row gets values or an error, never an exception; a null payload is an empty one."""
    rows = []
    for buf in payload:
        try:
            t, c, s, q = decode_packet(bytes(buf or b""))
            rows.append((decimal.Decimal(t), c, samples_of(s), q, None))
        except DecodeError as e:
            rows.append((None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=NEURAL_PACKET.names)
