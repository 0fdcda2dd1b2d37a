"""Spectra of sample arrays, a batch of clips at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def centroids(samples: np.ndarray, rate: int, size: int, hop: int) -> np.ndarray:
    """The spectral centroid of each frame: frames of ``size``, ``hop`` apart, centred on samples by zeros on both sides,
    under a periodic Hann window. A silent frame has 0."""
    padded = np.pad(samples, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    power = np.abs(np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)), axis=1))
    total = power.sum(1)
    return np.where(total > 0, power @ (np.arange(size // 2 + 1) * rate / size) / np.where(total > 0, total, 1), 0.0)


def mean_centroid(samples: Column, rate: int, size: int, hop: int) -> Column:
    """Mean of a clip's centroids; 0 for no samples, null for a null clip. Null samples count as 0."""

    @pandas_udf("double")
    def mean(clips):
        one = lambda x: None if x is None else 0.0 if not len(x) else float(centroids(np.nan_to_num(np.asarray(x, np.float64)), rate, size, hop).mean())
        return clips.map(one)

    return mean(samples)
