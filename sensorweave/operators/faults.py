"""Seeded fault injection: a sequential xorshift stream decides drops and corruptions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType

MASK = (1 << 64) - 1
DROP_SEED, CORRUPT_SEED = 0xDEADBEEF, 0xCAFEBABE


class Xorshift64:
    """Shifts 13, 7, 17; ``roll`` consumes a value only for rates strictly between 0 and 1."""

    def __init__(self, seed: int):
        if seed == 0:
            raise ValueError("the seed must not be 0")
        self.state = seed & MASK

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        self.state = x
        return x

    def roll(self, rate: float) -> bool:
        if rate <= 0 or rate >= 1:
            return rate >= 1
        return self.next() < min(int(rate * 2.0**64), MASK)


def _step_matrix() -> list[int]:
    """Column j is what one step makes of bit j: the step is linear over bits."""
    out = []
    for j in range(64):
        r = Xorshift64(1 << j)
        out.append(r.next())
    return out


def _apply(matrix: list[int], state: int) -> int:
    out = 0
    for j in range(64):
        if state >> j & 1:
            out ^= matrix[j]
    return out


def jumped(seed: int, steps: int) -> int:
    """The state after ``steps`` values, in O(log steps)."""
    matrix, state = _step_matrix(), seed
    while steps:
        if steps & 1:
            state = _apply(matrix, state)
        matrix = [_apply(matrix, c) for c in matrix]
        steps >>= 1
    return state


def drop_flags(spark: SparkSession, packets: int, rate: float, seed: int = DROP_SEED, slices: int = 8) -> DataFrame:
    """packet, dropped.  Each slice jumps to its place in the stream, so slices run apart and give one result."""
    rate = min(max(rate, 0.0), 1.0)
    size = -(-packets // max(1, slices)) if packets else 0

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                lo, hi = int(k) * size, min((int(k) + 1) * size, packets)
                rng = Xorshift64(jumped(seed, lo))
                for at in range(lo, hi, 65536):
                    n = min(65536, hi - at)
                    yield pd.DataFrame({"packet": np.arange(at, at + n), "dropped": [rng.roll(rate) for _ in range(n)]})

    return spark.range(0, slices if packets else 0, 1, slices).mapInPandas(roll, "packet long, dropped boolean")


def fault_plan(spark: SparkSession, packets: int, drop_rate: float, corrupt_rate: float, payload_bytes: int, drop_seed: int = DROP_SEED, corrupt_seed: int = CORRUPT_SEED) -> DataFrame:
    """packet, dropped, position (of the byte to flip, or null).

    The corruptor's stream advances only for packets that are sent, and twice for
    a hit, so its state depends on all packets before: one task streams through
    the decisions in batches of constant size, reading no input.
    """
    drop_rate, corrupt_rate = min(max(drop_rate, 0.0), 1.0), min(max(corrupt_rate, 0.0), 1.0)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                drop, corrupt = Xorshift64(drop_seed), Xorshift64(corrupt_seed)
                for at in range(0, packets, 65536):
                    rows = []
                    for i in range(at, min(at + 65536, packets)):
                        dropped = drop.roll(drop_rate)
                        hit = not dropped and corrupt.roll(corrupt_rate)
                        rows.append((i, dropped, corrupt.next() % payload_bytes if hit and payload_bytes else None))
                    yield pd.DataFrame(rows, columns=["packet", "dropped", "position"]).astype({"position": "Int64"})

    return spark.range(0, 1, 1, 1).mapInPandas(decide, "packet long, dropped boolean, position long")


@pandas_udf(BinaryType())
def flip_byte(payload: pd.Series, position: pd.Series) -> pd.Series:
    """The payload with all bits of one byte inverted; a null position changes nothing."""

    def flip(buf: bytes, at: float | None) -> bytes:
        if pd.isna(at) or not buf:
            return bytes(buf)
        out = bytearray(buf)
        out[int(at)] ^= 0xFF
        return bytes(out)

    return pd.Series([flip(b, p) for b, p in zip(payload, position, strict=True)])


class PacketCorruptor:
    """Flips ``bytes_per_corrupt`` bytes on a hit; the same position twice restores it, empty buffers draw nothing."""

    def __init__(self, rate: float, bytes_per_corrupt: int, seed: int):
        self.rate, self.count, self.rng = min(max(rate, 0.0), 1.0), bytes_per_corrupt, Xorshift64(seed)
        self.total = self.corrupted = 0

    def maybe_corrupt(self, buf: bytearray) -> bool:
        self.total += 1
        if not buf or not self.rng.roll(self.rate):
            return False
        for _ in range(self.count):
            buf[self.rng.next() % len(buf)] ^= 0xFF
        self.corrupted += 1
        return True


def fault_summary(plan: DataFrame) -> DataFrame:
    """seen, dropped, corrupted, sent and the observed drop fraction."""
    return plan.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("dropped").alias("dropped"),
        F.count("position").alias("corrupted"),
        F.count_if(~F.col("dropped")).alias("sent"),
        F.coalesce(F.avg(F.col("dropped").cast("double")), F.lit(0.0)).alias("drop_fraction"),
    )
