"""Window classification: stub, numpy convolution model, optional ONNX model."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..schema import PREDICTION

CHANNELS, GAZE_CHANNELS, SAMPLES = 128, 3, 500
HIDDEN = 64


def stub_prediction() -> Column:
    """The constant prediction of no model: 0.5 and yet ``observe``."""
    return F.struct(F.lit(0.5).cast("float").alias("confidence"), F.lit("observe").alias("classification"), F.lit(0).cast("bigint").alias("inference_ns"))


def with_fallback(ready: Column, prediction: Column, waiting_class: str = "accumulating") -> Column:
    """Not ready gives (0.0, ``waiting_class``); a failed prediction (null) gives (0.5, observe)."""
    none = F.struct(F.lit(0.0).cast("float").alias("confidence"), F.lit(waiting_class).alias("classification"), F.lit(0).cast("bigint").alias("inference_ns"))
    return F.when(~ready, none).otherwise(F.coalesce(prediction, stub_prediction()))


def _convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Same-length 1-D convolution (batch, channels, time) with relu."""
    k = w.shape[2]
    padded = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2)))
    views = np.lib.stride_tricks.sliding_window_view(padded, k, axis=2)
    return np.maximum(np.einsum("bctk,ock->bot", views, w, optimize=True) + b[None, :, None], 0)


class ConvFusion:
    """Two convolution branches, mean pooling, two dense layers; weights drawn from a seed, as none are shipped."""

    def __init__(self, channels: int = CHANNELS, gaze_channels: int = GAZE_CHANNELS, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(np.prod(shape[1:])), shape).astype(np.float32)
        self.branches = [[(draw(HIDDEN, n, 7), draw(HIDDEN)), (draw(HIDDEN, HIDDEN, 5), draw(HIDDEN))] for n in (channels, gaze_channels)]
        self.dense = [(draw(HIDDEN, 2 * HIDDEN), draw(HIDDEN)), (draw(1, HIDDEN), draw(1))]

    def logits(self, eeg: np.ndarray, gaze: np.ndarray) -> np.ndarray:
        """(batch,) from (batch, channels, time) and (batch, 3, time)."""
        pooled = []
        for x, layers in zip((eeg, gaze), self.branches, strict=True):
            for w, b in layers:
                x = _convolved(x, w, b)
            pooled.append(x.mean(axis=2))
        x = np.concatenate(pooled, axis=1)
        (w1, b1), (w2, b2) = self.dense
        return (np.maximum(x @ w1.T + b1, 0) @ w2.T + b2)[:, 0]


@lru_cache(maxsize=4)
def _model(path: str | None, channels: int, seed: int):
    if path is None:
        return ConvFusion(channels, seed=seed).logits
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    names = [i.name for i in session.get_inputs()]
    return lambda eeg, gaze: session.run(None, dict(zip(names, (eeg, gaze), strict=True)))[0].reshape(-1)


@lru_cache(maxsize=4)
def _channels(path: str) -> int | None:
    """The EEG channels that a model file asks for, None if any."""
    import onnxruntime

    size = onnxruntime.InferenceSession(path).get_inputs()[0].shape[1]
    return size if isinstance(size, int) else None


def classifier(path: str | None = None, channels: int | None = CHANNELS, samples: int = SAMPLES, seed: int = 0):
    """A UDF (eeg, gaze) -> prediction struct over channel-major flat windows; a window of another size is null.

    The model is loaded once in each worker process.  ``channels`` None takes the
    channels that each window has; a model file's own count is held against them.
    """

    @pandas_udf(PREDICTION)
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for eeg, gaze in batches:
            fits = [len(e) // samples if len(e) and len(e) % samples == 0 and len(g) == GAZE_CHANNELS * samples else 0 for e, g in zip(eeg, gaze, strict=True)]
            known = {n for n in fits if n and (channels or n) == n and (path is None or _channels(path) in (None, n))}
            out = pd.DataFrame({"confidence": np.full(len(eeg), np.nan, np.float32), "classification": pd.Series([None] * len(eeg), dtype=object), "inference_ns": pd.array([pd.NA] * len(eeg), "Int64")})
            for n in sorted(known):
                rows, logits = np.flatnonzero(np.array(fits) == n), _model(path, n, seed)
                began = time.perf_counter_ns()
                x = np.stack([np.asarray(eeg.iloc[i], np.float32).reshape(n, samples) for i in rows])
                y = np.stack([np.asarray(gaze.iloc[i], np.float32).reshape(GAZE_CHANNELS, samples) for i in rows])
                confidence = (1 / (1 + np.exp(-logits(x, y)))).astype(np.float32)
                spent = (time.perf_counter_ns() - began) // len(rows)
                out.loc[rows, "confidence"] = confidence
                out.loc[rows, "classification"] = np.where(confidence >= 0.5, "intent", "observe")
                out.loc[rows, "inference_ns"] = spent
            yield out

    return predict
