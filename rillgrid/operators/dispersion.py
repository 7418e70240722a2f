"""Dispersion curves: envelopes of a bank of narrow bands, and the arrival that is followed over the periods.

A trace's spectrum is made once and multiplied with the whole bank, a matrix with a row a period. For each period the envelope is
looked at between the arrival times of the fastest and the slowest velocity. The curve is the path of one sample a period with the
largest sum of amplitudes (each period's largest is 1) among those that move at most `jump` samples from period to period, found by
dynamic programming over the periods inside the row; of equal choices the earliest sample.

A band sees the periods in it by their amplitudes: where a trace's spectrum rises or falls steeply, velocities are those of a period
to the louder side of the band's centre. A larger alpha (narrower bands) makes that less, and arrivals less sharp.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import over_arrays, velocity, wavelength_ok


def envelopes(periods: list[float], alpha: float, delta: float):
    """A column function: the envelopes of a trace in narrow bands around 1 / period, one after the other."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        f = np.abs(np.fft.fftfreq(n, delta))
        side = np.zeros(n)
        side[0], side[1 : (n + 1) // 2] = 1, 2
        if n % 2 == 0:
            side[n // 2] = 1
        centre = 1 / np.array(periods)[:, None]
        bank = side * np.exp(-alpha * ((f - centre) / centre) ** 2)
        spectra = np.fft.fft(x)
        # a row of the batch at a time: the bank multiplies each trace's size by the number of periods
        return np.stack([np.abs(np.fft.ifft(s * bank)).ravel() for s in spectra])

    return over_arrays(run)


def _window(at: Column, jump: int, size: Column) -> tuple[Column, Column]:
    """First place and number of places (from 1) within jump of place `at` (from 0)."""
    first = F.greatest(F.lit(1), at + 1 - jump)
    return first, F.least(size, at + 1 + jump) - first + 1


def _first_largest(values: Column) -> Column:
    """The place of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def with_ridge(df: DataFrame, rows: str, jump: int, name: str) -> DataFrame:
    """df with array<int> name: the place taken in each row of the column rows (array<array<double>> of equal sizes), for the largest sum. Each
    step is a column of its own, so that lambdas refer to values and do not work them out again."""
    df = df.withColumn("_size", F.size(F.get(rows, 0)))
    size = F.col("_size")

    def further(sums: Column, row: Column) -> Column:
        last = F.element_at(sums, -1)
        return F.concat(sums, F.array(F.transform(row, lambda a, i: a + F.array_max(F.slice(last, *_window(i, jump, size))))))

    df = df.withColumn("_sums", F.reverse(F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), F.array(F.get(rows, 0)), further)))

    def back(taken: Column, row: Column) -> Column:
        first, many = _window(F.element_at(taken, -1), jump, size)
        return F.concat(taken, F.array((first - 1 + _first_largest(F.slice(row, first, many))).cast("int")))

    path = F.aggregate(F.slice("_sums", F.lit(2), F.size(rows)), F.array(_first_largest(F.get("_sums", 0))), back)
    return df.withColumn(name, F.reverse(path)).drop("_size", "_sums")


def curves(traces: DataFrame, keys: list[str], data: str, distance: Column, delta: float, periods: list[float], alpha: float = 20.0, slow: float = 0.5, fast: float = 5.0, jump: int = 4, wavelengths: float = 3.0) -> DataFrame:
    """(keys, period, sample, velocity, amplitude, far) of traces that start at time 0, for ascending periods in seconds: distance in
    km, velocity in km/s, and whether the distance is more than `wavelengths` of them. Null traces, and traces that end before
    the fastest arrival, have no rows."""
    n = F.size(data)
    first = F.greatest(F.lit(1), F.ceil(distance / fast / delta)).cast("int")
    last = F.least(n - 1, F.floor(distance / slow / delta)).cast("int")
    seen = traces.where(F.col(data).isNotNull()).select(*keys, distance.alias("_d"), first.alias("_first"), last.alias("_last"), n.alias("_n"), F.col(data).alias("_x")).where("_last >= _first")
    bands = seen.select(*keys, "_d", "_first", "_last", "_n", envelopes(periods, alpha, delta)(F.col("_x")).alias("_e"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(len(periods) - 1)), lambda p: F.slice("_e", p * F.col("_n") + F.col("_first") + 1, F.col("_last") - F.col("_first") + 1))
    cut = bands.select(*keys, "_d", "_first", cut.alias("_rows"))
    even = F.transform("_rows", lambda row: F.transform(row, lambda a: a / F.coalesce(F.nullif(F.array_max(row), F.lit(0.0)), F.lit(1.0))))
    taken = with_ridge(cut.withColumn("_even", even), "_even", jump, "_at")
    picked = F.transform("_at", lambda place, p: F.struct(F.get(F.array(*[F.lit(float(t)) for t in periods]), p).alias("period"), (F.col("_first") + place).alias("sample"), F.get(F.get("_rows", p), place).alias("amplitude")))
    rows = taken.select(*keys, "_d", F.explode(picked).alias("_p")).select(*keys, "_d", "_p.*")
    v = velocity(F.col("_d"), F.col("sample") * delta)
    return rows.select(*keys, "period", "sample", v.alias("velocity"), "amplitude", wavelength_ok(F.col("_d"), v, F.col("period"), wavelengths).alias("far"))
