"""Spectral functions over ARRAY<DOUBLE> windows.

Two forms with one result: ``features_sql`` and its parts are pure expressions (a
discrete Fourier transform by higher-order functions, for windows of up to a few
hundred samples), ``features_arrow`` runs numpy over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Band limits in Hz and the floor below which power counts as none.
BANDS = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 100.0))
FLOOR = 1e-30
DIM = 11


def fft_size(length: int) -> int:
    """Half the next power of two, at least 2: a power-of-two window uses its newest half."""
    return max(2, (1 << max(0, length - 1).bit_length()) // 2)


def band_bins(size: int, rate_hz: float) -> list[tuple[int, int]]:
    """Half-open bin ranges of the bands; edges round half up, the upper one is clipped."""
    per_bin = rate_hz / size
    edge = lambda hz: math.floor(hz / per_bin + 0.5)
    return [(edge(lo), min(edge(hi), size // 2)) for _, lo, hi in BANDS]


def hann(size: int) -> list[float]:
    return [0.5 * (1 - math.cos(2 * math.pi * i / (size - 1))) for i in range(size)]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def newest(window: Column, size: int) -> Column:
    """The last ``size`` samples, zeros put before a shorter window."""
    missing = F.greatest(F.lit(size) - F.size(window), F.lit(0))
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), missing), window), -size, size)


def power_spectrum(samples: Column, size: int) -> Column:
    """|DFT|^2 / n^2 of Hann-weighted samples, bins 0 to n/2 - 1.  ``samples`` must be a column of ``size`` values."""
    turn = -2 * math.pi / size
    cos = F.array(*[F.lit(math.cos(turn * i)) for i in range(size)])
    sin = F.array(*[F.lit(math.sin(turn * i)) for i in range(size)])
    weighted = F.zip_with(samples, F.array(*[F.lit(w) for w in hann(size)]), lambda x, w: x * w)

    def bin_power(k: Column) -> Column:
        part = lambda table: F.aggregate(
            F.transform(weighted, lambda x, i: x * table[F.pmod(k * i, F.lit(size))]), F.lit(0.0), lambda s, x: s + x
        )
        re, im = part(cos), part(sin)
        return (re * re + im * im) / float(size * size)

    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), bin_power)


def band_powers(spectrum: Column, size: int, rate_hz: float) -> list[Column]:
    """delta, theta, alpha, beta, gamma and total; total takes every bin.  ``spectrum`` should be a column, not an expression."""
    sums = [_sum(F.slice(spectrum, lo + 1, hi - lo)) if hi > lo else F.lit(0.0) for lo, hi in band_bins(size, rate_hz)]
    named = [c.alias(name) for c, (name, _, _) in zip(sums, BANDS, strict=True)]
    return [*named, _sum(spectrum).alias("total")]


def relative(power: Column, total: Column) -> Column:
    return F.when(total < FLOOR, 0.0).otherwise(power / F.greatest(total, F.lit(FLOOR)))


def log_power(power: Column) -> Column:
    return F.ln(power + FLOOR)


def rms(window: Column) -> Column:
    return F.sqrt(_sum(F.transform(window, lambda x: x * x)) / F.size(window))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either norm is under the floor; different lengths raise."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    value = F.when((norm(a) < FLOOR) | (norm(b) < FLOOR), 0.0).otherwise(dot / (norm(a) * norm(b)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def numpy_spectrum(windows: np.ndarray, size: int) -> np.ndarray:
    """Power spectra of the newest ``size`` samples of each row."""
    held = windows[:, -size:]
    if held.shape[1] < size:
        held = np.pad(held, ((0, 0), (size - held.shape[1], 0)))
    return np.abs(np.fft.rfft(held * np.array(hann(size)), axis=1)[:, : size // 2]) ** 2 / size**2


def numpy_features(windows: np.ndarray, rate_hz: float) -> np.ndarray:
    """(rows, 11): five relative powers, five logarithms, the RMS of the whole window."""
    size = fft_size(windows.shape[1])
    spectrum = numpy_spectrum(windows, size)
    bands = np.stack([spectrum[:, lo:hi].sum(axis=1) if hi > lo else np.zeros(len(spectrum)) for lo, hi in band_bins(size, rate_hz)], axis=1)
    total = spectrum.sum(axis=1, keepdims=True)
    share = np.where(total < FLOOR, 0.0, bands / np.maximum(total, FLOOR))
    return np.hstack([share, np.log(bands + FLOOR), np.sqrt((windows**2).mean(axis=1, keepdims=True))])


def features_arrow(rate_hz: float | None):
    """A vectorised UDF from ARRAY<FLOAT or DOUBLE> to the 11 features; windows of one length are computed together.

    Without a rate each row's comes as a second column.
    """

    def of(windows: pd.Series, rates: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(windows), index=windows.index, dtype=object)
        lengths = windows.map(lambda w: -1 if w is None else len(w))
        for (n, rate), rows in windows.groupby([lengths, rates]):
            if n > 0:
                out[rows.index] = list(numpy_features(np.stack(rows.to_list()).astype(np.float64), rate))
        return out

    @pandas_udf("array<double>")
    def rated_features(windows: pd.Series, rates: pd.Series) -> pd.Series:
        return of(windows, rates)

    @pandas_udf("array<double>")
    def features(windows: pd.Series) -> pd.Series:
        return of(windows, pd.Series(rate_hz, index=windows.index))

    return rated_features if rate_hz is None else features
