"""Scalar functions as column expressions; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = float(2**64)


def log2_bucket(ns: Column) -> Column:
    """floor(log2(ns)) by counting binary digits, 0 for 0; exact up to 2**63 - 1."""
    return F.when(ns <= 0, 0).otherwise(F.length(F.bin(ns)) - 1).cast("int")


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n - 1))))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) in double, as FLOAT."""
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))).cast("float")


def threshold_class(confidence: Column) -> Column:
    return F.when(confidence >= 0.5, "intent").otherwise("observe")


def xorshift(seed: Column) -> Column:
    """One stateless xorshift64 step with shifts 13, 7, 17; seed 0 counts as 1.  BIGINT holds the unsigned bits."""
    x = F.when(seed == 0, F.lit(1).cast("bigint")).otherwise(seed.cast("bigint"))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def unsigned_double(bits: Column) -> Column:
    """The unsigned value of BIGINT bits as DOUBLE."""
    return bits.cast("double") + F.when(bits < 0, TWO_64).otherwise(0.0)


def pseudo_gaussian(seed: Column) -> Column:
    """Box-Muller over the uniform values of ``seed`` and ``seed + 1``, the first floored at 1e-30."""
    u1 = F.greatest(unsigned_double(xorshift(seed)) / TWO_64, F.lit(1e-30))
    u2 = unsigned_double(xorshift(seed + 1)) / TWO_64
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def wrapped_u32(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def clamped_rate(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
