"""Synthetic traces with known answers, made by Spark from row numbers and seeds; the checks of correlations and spectra use them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ricker(t: Column, peak: float) -> Column:
    """A Ricker wavelet of peak frequency `peak` at time t."""
    a = (math.pi * peak * t) ** 2
    return (1 - 2 * a) * F.exp(-a)


def ricker_pair(spark: SparkSession, n: int, delta: float, peak: float, at: float, delay: float) -> DataFrame:
    """(n, a, b): a wavelet at time `at`, and the same one `delay` later."""
    t = F.col("id") * delta
    return spark.range(n).select(F.col("id").cast("int").alias("n"), ricker(t - at, peak).alias("a"), ricker(t - at - delay, peak).alias("b"))


def ring_of_sources(spark: SparkSession, sources: int, geometry: str = "all", seed: int = 0) -> DataFrame:
    """(source_id, azimuth) around two stations on the x axis: all around, on one side of it, or across it."""
    spread = {"all": (0.0, 2 * math.pi), "one_side": (-math.pi / 6, math.pi / 6), "across": (math.pi / 2 - math.pi / 12, math.pi / 2 + math.pi / 12)}[geometry]
    return spark.range(sources).select(F.col("id").alias("source_id"), (spread[0] + (spread[1] - spread[0]) * F.rand(seed)).alias("azimuth"))


def noise_pair(sources: DataFrame, n: int, delta: float, distance: float, velocity: float, seed: int = 0) -> DataFrame:
    """(source_id, a, b): each source's noise at two stations, put apart by exact phase shifts e^(-2 pi i f tau)."""

    @F.arrow_udf("struct<a:array<double>,b:array<double>>")
    def shifted(name: pa.Array, azimuth: pa.Array) -> pa.Array:
        f = np.fft.rfftfreq(n, delta)
        noise = np.stack([np.fft.rfft(np.random.default_rng([seed, i]).normal(size=n)) for i in name.to_pylist()]) if len(name) else np.zeros((0, len(f)))
        tau = -distance / 2 * np.cos(azimuth.to_numpy())[:, None] / velocity
        sides = [np.fft.irfft(noise * np.exp(-2j * np.pi * f * s * tau), n) for s in (1, -1)]
        return pa.StructArray.from_arrays([pa.array(list(x), pa.list_(pa.float64())) for x in sides], ["a", "b"])

    return sources.select("source_id", shifted("source_id", "azimuth").alias("x")).select("source_id", "x.a", "x.b")


def group_velocity(period: Column) -> Column:
    """The dispersion of the synthetic pair: km/s by period."""
    return 0.8 + 0.55 * period


def dispersive_traces(pairs: DataFrame, distance: str, n: int, delta: float, low: float, high: float) -> DataFrame:
    """pairs with data: for each pair a wave that left at time 0 and has the group delay distance / v(1 / f). Its phase is the integral of
    the delay over frequency, and its spectrum is a cosine taper from low to high (Hz). Traces are made where their pairs are."""

    @F.arrow_udf("array<double>")
    def made(km: pa.Array) -> pa.Array:
        f = np.fft.rfftfreq(n, delta)
        inside = (f >= low) & (f <= high)
        slow = np.where(inside, 1 / (0.8 + 0.55 / np.where(f > 0, f, 1)), 0)
        taper = np.where(inside, np.sin(math.pi * (f - low) / (high - low)) ** 2, 0)
        turn = -2 * math.pi * np.cumsum(slow) * (f[1] - f[0])
        return pa.array([None if d is None else np.fft.irfft(taper * np.exp(1j * d * turn), n) for d in km.to_pylist()], pa.list_(pa.float64()))

    return pairs.withColumn("data", made(F.col(distance).cast("double")))


def dispersive_trace(spark: SparkSession, n: int, delta: float, distance: float, low: float, high: float) -> DataFrame:
    """(n, x): the wave of one pair, a row a sample."""
    one = dispersive_traces(spark.range(1).select(F.lit(float(distance)).alias("km")), "km", n, delta, low, high)
    return one.select(F.posexplode("data").alias("n", "x"))


def velocity_grid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(cell_id, ix, iy, velocity): 3 km/s with a slow basin and a fast intrusion."""
    x, y = F.col("ix") - nx * 0.35, F.col("iy") - ny * 0.4
    u, v = F.col("ix") - nx * 0.7, F.col("iy") - ny * 0.7
    grid = spark.range(nx * ny).select(F.col("id").alias("cell_id"), (F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    return grid.withColumn("velocity", 3 - 0.8 * F.exp(-(x * x + y * y) / (0.02 * nx * ny)) + 0.8 * F.exp(-(u * u + v * v) / (0.005 * nx * ny)))


def year_of_changes(spark: SparkSession, event_day: int, drop: float, recovery: float = 30.0, seasonal: float = 1e-3, noise: float = 1e-4, seed: int = 0) -> DataFrame:
    """(day, dv_v) for 365 days: a yearly cycle, and a drop at event_day that heals."""
    since = F.col("id") - event_day
    event = F.when(since >= 0, -drop * F.exp(-since / recovery)).otherwise(0.0)
    return spark.range(365).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (seasonal * F.sin(2 * math.pi * F.col("id") / 365) + event + noise * F.randn(seed)).alias("dv_v"))


def three_components(spark: SparkSession, n: int, delta: float, f0: float, gain: float, seed: int = 0) -> DataFrame:
    """(c, data) of one station: c = 0 is vertical noise, 1 and 2 are horizontal noise with a resonance at f0."""

    @F.arrow_udf("array<double>")
    def made(c: pa.Array) -> pa.Array:
        f = np.fft.rfftfreq(n, delta)
        out = []
        for one in c.to_pylist():
            r = np.random.default_rng([seed, one])
            shape = 1 + (gain * np.exp(-(((f - f0) / (0.1 * f0)) ** 2)) if one else 0)
            out.append(np.fft.irfft(np.exp(2j * np.pi * r.random(len(f))) * shape, n))
        return pa.array(out, pa.list_(pa.float64()))

    return spark.range(3).select(F.col("id").cast("int").alias("c"), made(F.col("id")).alias("data"))
