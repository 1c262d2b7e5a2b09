"""Recordings in NumPy archives and (where its reader is installed) EEGLAB or EDF files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EEG_RATE, GAZE_RATE, PUPIL = 128.0, 60.0, 3.0
EEG = "recording string, timestamp_ns long, channels array<float>, sequence_id long"
GAZE = "recording string, timestamp_ns long, x float, y float, pupil_diameter float, idx long"


def flattened(eeg: np.ndarray) -> np.ndarray:
    """(trial, channel, time) as rows of trial and time; two dimensions stay."""
    if eeg.ndim == 3:
        return eeg.transpose(0, 2, 1).reshape(-1, eeg.shape[1])
    if eeg.ndim == 2:
        return eeg
    raise ValueError(f"EEG of {eeg.ndim} dimensions")


def _pick(archive, wanted) -> str | None:
    return next((k for k in archive.files if wanted(k, archive[k])), None)


def archive_frames(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """EEG rows and (n, 2) gaze positions, the labels resampled to the gaze rate by truncated even steps."""
    archive = np.load(io.BytesIO(data), allow_pickle=False)
    key = _pick(archive, lambda k, v: "eeg" in k.lower() or v.ndim == 3) or _pick(archive, lambda k, v: v.ndim >= 2)
    if key is None:
        raise ValueError("no EEG array")
    eeg = flattened(archive[key]).astype(np.float32)
    n = len(eeg) * int(1e9 / EEG_RATE) // int(1e9 / GAZE_RATE)
    gaze = np.zeros((n, 2), np.float32)
    label = _pick(archive, lambda k, v: "label" in k.lower() or "position" in k.lower())
    if label is not None and archive[label].ndim == 2 and archive[label].shape[1] >= 2:
        values = archive[label]
        gaze = values[np.linspace(0, len(values) - 1, n).astype(int), :2].astype(np.float32)
    return eeg, gaze


def _scan(spark: SparkSession, path: str, schema: str, frame) -> DataFrame:
    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                eeg, gaze = archive_frames(content)
                for lo in range(0, max(len(eeg), len(gaze)), 8192):
                    out = frame(eeg, gaze, lo, lo + 8192)
                    if len(out):
                        yield out.assign(recording=name.rsplit("/", 1)[-1])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def _eeg_rows(eeg, gaze, lo, hi) -> pd.DataFrame:
    rows = np.arange(lo, min(hi, len(eeg)))
    return pd.DataFrame({"timestamp_ns": rows * int(1e9 / EEG_RATE), "channels": list(eeg[lo:hi]), "sequence_id": rows})


def _gaze_rows(eeg, gaze, lo, hi) -> pd.DataFrame:
    rows = np.arange(lo, min(hi, len(gaze)))
    return pd.DataFrame({"timestamp_ns": rows * int(1e9 / GAZE_RATE), "x": gaze[lo:hi, 0], "y": gaze[lo:hi, 1], "pupil_diameter": np.full(len(rows), PUPIL, np.float32), "idx": rows})


def read_npz(spark: SparkSession, path: str, section: str = "eeg") -> DataFrame:
    """EEG or gaze frames of archives, one task a file at a time."""
    return _scan(spark, path, EEG, _eeg_rows) if section == "eeg" else _scan(spark, path, GAZE, _gaze_rows)


def read_mne(spark: SparkSession, path: str, suffix: str = ".edf") -> DataFrame:
    """EEG frames of EDF or EEGLAB files through the ``mne`` package, which must be installed on the executors."""

    def read(batches):
        import tempfile

        import mne

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tempfile.NamedTemporaryFile(suffix=suffix) as f:
                    f.write(content)
                    f.flush()
                    raw = (mne.io.read_raw_edf if suffix == ".edf" else mne.io.read_raw_eeglab)(f.name, preload=True, verbose="ERROR")
                    step, data = int(1e9 / raw.info["sfreq"]), raw.get_data().T.astype(np.float32)
                for lo in range(0, len(data), 8192):
                    rows = np.arange(lo, min(lo + 8192, len(data)))
                    yield pd.DataFrame({"recording": name.rsplit("/", 1)[-1], "timestamp_ns": rows * step, "channels": list(data[lo : lo + 8192]), "sequence_id": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, EEG)
