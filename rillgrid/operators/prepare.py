"""Single-station preparation in one chain: from raw traces to whitened days.

Each step is a function of matrices with a trace a row. Steps on whole traces (trend, band) come before the cut into days, and steps
on days (running absolute mean, whitening) after it; what stands between two cuts is one pass through Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import _masked, _whiten, over_arrays

Step = Callable[[np.ndarray], np.ndarray]


def without_trend(x: np.ndarray) -> np.ndarray:
    """Less the least-squares line over the sample number."""
    n = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = (x @ n) / max((n**2).sum(), 1e-300)
    return x - x.mean(axis=1, keepdims=True) - slope[:, None] * n


def in_band(low: float, high: float) -> Step:
    """Only the frequencies from low to high, in cycles a sample."""
    return _masked(lambda f: ((f >= low) & (f <= high)).astype(float))


def one_bit(x: np.ndarray) -> np.ndarray:
    return np.sign(x)


def running_mean(half: int) -> Step:
    """Over the mean of absolute values up to `half` before and after, of those that there are; 0 where all of them are 0."""

    def run(x: np.ndarray) -> np.ndarray:
        sums = np.pad(np.cumsum(np.abs(x), axis=1), [(0, 0), (1, 0)])
        at = np.arange(x.shape[1])
        first, last = np.maximum(at - half, 0), np.minimum(at + half + 1, x.shape[1])
        weight = (sums[:, last] - sums[:, first]) / (last - first)
        return np.divide(x, weight, out=np.zeros_like(x), where=weight > 1e-12)

    return run


def whitened(half: int) -> Step:
    return lambda x: _whiten(x, half)


def chained(*steps: Step):
    """A column function: the steps one after the other."""

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    return over_arrays(run)


def cut_days(traces: DataFrame, data: str, samples: int) -> DataFrame:
    """A row for each whole day of `samples`, numbered from 0 as day; what is left of a trace drops out."""
    days = F.floor(F.size(data) / samples).cast("int")
    cut = F.transform(F.sequence(F.lit(0), days - 1), lambda d: F.struct(d.alias("day"), F.slice(data, d * samples + 1, samples).alias("x")))
    rest = [c for c in traces.columns if c != data]
    return traces.where(days > 0).select(*rest, F.explode(cut).alias("_d")).select(*rest, "_d.day", F.col("_d.x").alias(data))


def prepared_days(traces: DataFrame, data: str, samples: int, low: float, high: float, half: int, normal: Step | None = None, smooth: int = 2) -> DataFrame:
    """traces without trend, in a band, cut into days, normalised in time (by the running mean over `half`, or by `normal`) and whitened;
    null traces and those of less than a day drop out."""
    whole = traces.where(F.size(data) >= samples).withColumn(data, chained(without_trend, in_band(low, high))(F.col(data)))
    return cut_days(whole, data, samples).withColumn(data, chained(normal or running_mean(half), whitened(smooth))(F.col(data)))
