"""Sampled traces. Relational forms work on (channel, n, x) rows; spectra stay inside Arrow functions on arrays.

Choices that the definitions leave open: lag is positive from a to b, c(lag) = sum of a[n] * b[n + lag]; running means use
the part of a window that exists, and zero weights give null; an event is a sample beyond k times the root mean square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import exact_mean
from ..sources.steps import stored
from .pairs import listed
from .segments import frame, framed, numbered
from .tomography import spread


def _with(df: DataFrame, channel: str, **sums: Column) -> DataFrame:
    """df with sums over each channel, by a partial aggregate and a join, so that no window holds a channel."""
    return df.join(df.groupBy(channel).agg(*[c.alias(name) for name, c in sums.items()]), channel)


def demean(df: DataFrame, channel: str, x: str) -> DataFrame:
    return _with(df, channel, _mean=F.avg(x)).withColumn("demeaned", F.col(x) - F.col("_mean")).drop("_mean")


def detrend(df: DataFrame, channel: str, order: str, x: str) -> DataFrame:
    """Without the least-squares line over the sample number; numbers are given range by range, so that a long channel is split."""
    df = numbered(df, channel, order).withColumn("n", F.col("n").cast("double"))
    slope = F.try_divide(F.covar_pop("n", x), F.var_pop("n"))
    df = _with(df, channel, _slope=F.coalesce(slope, F.lit(0.0)), _mean=F.avg(x), _middle=F.avg("n"))
    return df.withColumn("detrended", F.col(x) - (F.col("_mean") + F.col("_slope") * (F.col("n") - F.col("_middle")))).drop("_slope", "_mean", "_middle")


def one_bit(x: Column) -> Column:
    return F.signum(x)


def clip_rms(df: DataFrame, channel: str, x: str) -> DataFrame:
    df = _with(df, channel, rms=F.sqrt(F.avg(F.col(x) * F.col(x))))
    return df.withColumn("clipped", F.greatest(-F.col("rms"), F.least(F.col("rms"), F.col(x))))


def remove_events(df: DataFrame, channel: str, x: str, k: float) -> DataFrame:
    df = _with(df, channel, _rms=F.sqrt(F.avg(F.col(x) * F.col(x))))
    return df.withColumn("quiet", F.when(F.abs(x) > k * F.col("_rms"), 0.0).otherwise(F.col(x))).drop("_rms")


def running_absolute_mean(df: DataFrame, channel: str, order: str, x: str, half: int) -> DataFrame:
    """df with the mean of absolute values up to `half` before and after, and x over it, bin by bin of each channel."""
    weight = F.avg(F.abs(x)).over(frame(channel, "_number", half))
    out = framed(numbered(df, channel, order, "_number"), channel, "_number", half, {"weight": weight}).drop("_number")
    return out.withColumn("normalised", F.col(x) / F.nullif(F.col("weight"), F.lit(0.0)))


def pairs(stations: DataFrame, key: str, group: str) -> DataFrame:
    """Unordered pairs within a group, as (group, a, b): keys are dealt into tiles as in `pairs`, and each pair of tiles meets once under a
    key of its own, so that a few large groups spread over many tasks. Rows whose key or group is null drop out."""
    return listed(stations, key, group).withColumnRenamed("group", group)


def correlate(a: Column, b: Column, lag: Column) -> Column:
    """sum of a[n] * b[n + lag] over two arrays of equal length."""
    from_a = F.slice(a, F.greatest(F.lit(1), 1 - lag), F.greatest(F.lit(0), F.size(a) - F.abs(lag)))
    from_b = F.slice(b, F.greatest(F.lit(1), 1 + lag), F.greatest(F.lit(0), F.size(b) - F.abs(lag)))
    return F.aggregate(F.zip_with(from_a, from_b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlations(traces: DataFrame, pair: DataFrame, key: str, data: str, most: int) -> DataFrame:
    """(a, b, lag, c) for lags up to most of given pairs; few lags: each pair's arrays meet once, and lags are made in place."""
    left = pair.join(traces.select(F.col(key).alias("a"), F.col(data).alias("x")), "a")
    both = left.join(traces.select(F.col(key).alias("b"), F.col(data).alias("y")), "b")
    lags = both.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    return lags.select("a", "b", "lag", correlate(F.col("x"), F.col("y"), F.col("lag")).alias("c"))


#: Values of a group that exact_median() puts in order at once.
FEW = 10_000


def exact_median(df: DataFrame, by: list[str], x: str, bins: int = 1024) -> DataFrame:
    """(by, median) of each group's values. Counts in bins between the group's ends say in which bin each middle value lies; the bin's
    own ends are the next ones, until few values are left between them or all are equal. So no task holds more than FEW different
    values of a group, however they are spread. Null values and keys drop out, nan too; values are finite."""
    v = df.select(*by, F.col(x).cast("double").alias("_x")).dropna()
    ends = v.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    ranks = F.array(F.struct(F.floor((F.col("_n") + 1) / 2).alias("_rank"), F.lit(0).alias("_side")), F.struct(F.floor((F.col("_n") + 2) / 2).alias("_rank"), F.lit(1).alias("_side")))
    names = [*by, "_side", "_rank", "_lo", "_hi", "_n", "_before"]
    asked = stored(ends.withColumn("_r", F.explode(ranks)).withColumn("_before", F.lit(0).cast("long")).select(*by, "_r._side", "_r._rank", "_lo", "_hi", "_n", "_before"), "median-ends")
    wide = (F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi"))
    while not asked.where(wide).isEmpty():
        met = v.join(asked.where(wide), by).where("_x BETWEEN _lo AND _hi")
        place = F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)  # halves cannot overflow
        counts = met.groupBy(*by, "_side", "_rank", "_before", F.least(place, F.lit(bins - 1)).alias("_bin")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        so_far = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_side").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `bins` rows a group
        inside = counts.withColumn("_before", F.col("_before") + so_far).where((F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_n") >= F.col("_rank")))
        asked = stored(asked.where(~wide).unionByName(inside.select(*names)), "median-ends", [asked])
    equal = asked.where("_lo = _hi").select(*by, "_side", F.col("_lo").alias("_x"))
    rank = F.row_number().over(Window.partitionBy(*by, "_side").orderBy("_x")) + F.col("_before")
    some = v.join(asked.where("_lo < _hi"), by).where("_x BETWEEN _lo AND _hi").withColumn("_at", rank).where("_at = _rank").select(*by, "_side", "_x")
    return equal.unionByName(some).groupBy(*by).agg(F.avg("_x").alias("median"))


def stack(ccs: DataFrame, by: list[str], c: str = "c") -> DataFrame:
    """Mean, median and number of each group's values."""
    linear = ccs.groupBy(*by).agg(F.avg(c).alias("linear"), F.count(F.lit(1)).alias("n"))
    return linear.join(exact_median(ccs, by, c), by).select(*by, "linear", "median", "n")


def symmetric(ccs: DataFrame, by: list[str]) -> DataFrame:
    return ccs.groupBy(*by, F.abs("lag").alias("lag")).agg(F.avg("c").alias("c"))


def pick_max(df: DataFrame, by: list[str], key: str, amplitude: Column) -> DataFrame:
    """The key of the largest amplitude, the least key of equals."""
    return df.withColumn("_v", amplitude).groupBy(*by).agg(F.max_by(key, F.struct("_v", -F.col(key))).alias(key), F.max("_v").alias("amplitude"))


def over_arrays(make: Callable[..., np.ndarray]):
    """A column function that applies make to arrays, in Arrow batches: arrays of equal lengths are the rows of matrices, one for
    each argument, and make works on their last axis. Null arrays give null."""

    def column(*columns: Column) -> Column:
        @F.arrow_udf("array<double>")
        def run(*arrays: pa.Array) -> pa.Array:
            sizes = np.column_stack([np.asarray(a.value_lengths().fill_null(-1)) for a in arrays])
            out: list = [None] * len(sizes)
            for shape in np.unique(sizes, axis=0) if len(sizes) else []:
                rows = np.flatnonzero((sizes == shape).all(axis=1))
                if (shape < 0).any():
                    continue
                made = make(*[np.asarray(a.take(pa.array(rows)).flatten(), float).reshape(len(rows), n) for a, n in zip(arrays, shape)])
                for row, values in zip(rows.tolist(), made):
                    out[row] = values
            return pa.array(out, pa.list_(pa.float64()))

        return run(*columns)

    return column


def _whiten(x: np.ndarray, half: int = 2) -> np.ndarray:
    s = np.fft.rfft(x)
    size = np.abs(s)
    edge = np.pad(size, [(0, 0), (half, half)], mode="edge")
    smooth = np.lib.stride_tricks.sliding_window_view(edge, 2 * half + 1, axis=1).mean(axis=2)
    return np.fft.irfft(np.divide(s, smooth, out=np.zeros_like(s), where=smooth > 1e-12), x.shape[1])


def _cross(x: np.ndarray, y: np.ndarray, weigh=lambda a, b: 1.0) -> np.ndarray:
    n = x.shape[1] + y.shape[1] - 1
    a, b = np.fft.rfft(x, n), np.fft.rfft(y, n)
    return np.roll(np.fft.irfft(np.conj(a) * b * weigh(a, b), n), x.shape[1] - 1, axis=1)


def _inverse(size: np.ndarray) -> np.ndarray:
    """1 / size above a water level of a millionth of the largest of its row."""
    least = 1e-6 * np.maximum(size.max(axis=1, keepdims=True), 1e-300)
    return np.divide(1.0, size, out=np.zeros_like(size), where=size > least)


def _analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def _phases(x: np.ndarray) -> np.ndarray:
    return np.exp(1j * np.angle(_analytic(x)))


def _phase_cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The real part of sum of conj(e^(i phase of x[n])) * e^(i phase of y[n + lag])."""
    u, v = _phases(x), _phases(y)
    return _cross(u.real, v.real) + _cross(u.imag, v.imag)


def _masked(mask: Callable[[np.ndarray], np.ndarray]):
    """Keeps a share of each frequency (in cycles a sample)."""
    return lambda x: np.fft.irfft(np.fft.rfft(x) * mask(np.fft.rfftfreq(x.shape[1])), x.shape[1])


whiten = over_arrays(_whiten)
cross_correlation = over_arrays(_cross)
coherency = over_arrays(lambda x, y: _cross(x, y, lambda a, b: _inverse(np.abs(a) * np.abs(b))))
deconvolution = over_arrays(lambda x, y: _cross(x, y, lambda a, b: _inverse(np.abs(a) ** 2)))
phase_correlation = over_arrays(_phase_cross)
envelope = over_arrays(lambda x: np.abs(_analytic(x)))
amplitudes = over_arrays(lambda x: np.abs(np.fft.rfft(x)))
power = over_arrays(lambda x: np.abs(np.fft.rfft(x)) ** 2 / x.shape[1])


def _pick_lag(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = _cross(x, y)
    at = np.argmax(np.round(c, 9), axis=1)
    return np.column_stack([at - (x.shape[1] - 1), c[np.arange(len(c)), at]])


#: array [lag, value] of the largest cross-correlation, the least lag of equals.
pick_lag = over_arrays(_pick_lag)


def gaussian_filter(centre: float, alpha: float):
    """Narrow band around a centre in cycles a sample."""
    return over_arrays(_masked(lambda f: np.exp(-alpha * ((f - centre) / centre) ** 2)))


def bandpass(low: float, high: float):
    """Only the frequencies from low to high, in cycles a sample."""
    return over_arrays(_masked(lambda f: ((f >= low) & (f <= high)).astype(float)))


def stretch(reference: np.ndarray, eps: float) -> np.ndarray:
    """reference(t * (1 - eps)) around the middle sample, by linear interpolation on the last axis."""
    n = reference.shape[-1]
    t = (np.arange(n) - (n - 1) / 2) * (1 - eps) + (n - 1) / 2
    low = np.clip(np.floor(t).astype(int), 0, n - 2 if n > 1 else 0)
    share = np.clip(t - low, 0, 1)
    return reference[..., low] * (1 - share) + reference[..., np.minimum(low + 1, n - 1)] * share


def stretching(most: float = 0.05, steps: int = 101):
    """array [dv/v, correlation]: the best stretch of the reference, the first of equals; dv/v is minus the best eps."""

    def run(reference: np.ndarray, current: np.ndarray) -> np.ndarray:
        grid = np.linspace(-most, most, steps)
        norm = lambda v: np.sqrt((v**2).sum(axis=1))
        own, best = norm(current), np.full((len(current), 2), -np.inf)
        for e in grid:
            s = stretch(reference, e)
            size = norm(s) * own
            c = np.divide((s * current).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0)
            better = c > best[:, 1]
            best[better] = np.column_stack([np.full(better.sum(), -e), c[better]])
        return best

    return over_arrays(run)


def phase_weighted_stack(ccs: DataFrame, by: list[str], data: str, power: float = 2.0) -> DataFrame:
    """Linear stack times the coherence of phases, in two sums: each array adds its samples and its phases' unit vectors."""

    def parts(x: np.ndarray) -> np.ndarray:
        u = _phases(x)
        return np.concatenate([x, u.real, u.imag], axis=1)

    terms = ccs.where(F.col(data).isNotNull()).select(*by, F.posexplode(over_arrays(parts)(F.col(data))).alias("i", "v"), (F.size(data)).alias("n"))
    means = terms.withColumn("part", F.floor(F.col("i") / F.col("n")).cast("int")).withColumn("sample", F.pmod("i", "n")).groupBy(*by, "sample").agg(*[F.avg(F.when(F.col("part") == p, F.col("v"))).alias(name) for p, name in enumerate(("mean", "re", "im"))])
    return means.select(*by, "sample", (F.col("mean") * F.pow(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.lit(power))).alias("pws"))


def wavelength_ok(distance_km: Column, velocity: Column, period: Column, wavelengths: float = 3.0) -> Column:
    return distance_km > wavelengths * velocity * period


def resonance(vs: Column, thickness: Column) -> Column:
    return vs / (4 * F.nullif(thickness, F.lit(0.0)))


def lognormal(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Median and logarithmic standard deviation of positive values."""
    v = F.ln(F.col(x))
    return df.where(F.col(x) > 0).groupBy(*by).agg(F.exp(F.avg(v)).alias("median"), F.stddev_samp(v).alias("sigma_ln"), F.count(F.lit(1)).alias("n"))


def travel_times(incidence: DataFrame, grid: DataFrame) -> DataFrame:
    """t = sum of length * slowness along each ray."""
    return incidence.join(grid, "cell_id").groupBy("ray_id").agg(F.sum(F.col("length") / F.col("velocity")).alias("t"))


#: Products that a task of normal_matrix() adds up: what it holds is bounded by that, not by the input.
PRODUCTS = 1 << 20


def normal_matrix(incidence: DataFrame) -> DataFrame:
    """(i, j, g): the entries of G'G with i <= j, by a self-join on the ray, and as many tasks as the products need at PRODUCTS each."""
    a, b = incidence.select("ray_id", F.col("cell_id").alias("i"), F.col("length").alias("p")), incidence.select("ray_id", F.col("cell_id").alias("j"), F.col("length").alias("q"))
    n = F.count(F.lit(1))
    entries = incidence.groupBy("ray_id").agg(n.alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()
    least = int(incidence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda rows: max(least, math.ceil((rows or 0) / PRODUCTS))
    by_ray = lambda df: df.repartition(parts(entries[0]), "ray_id")
    products = by_ray(a).join(by_ray(b).hint("merge"), "ray_id").where("i <= j").select("i", "j", (F.col("p") * F.col("q")).alias("g"))
    return products.repartition(parts(entries[1]), "i", "j").groupBy("i", "j").agg(F.sum("g").alias("g"))


# windows, selection and quality


def samples(traces: DataFrame, keys: list[str], data: str) -> DataFrame:
    """(keys, n, x): one row a sample, n from 0."""
    return traces.select(*keys, F.posexplode(data).alias("n", "x")).withColumn("x", F.col("x").cast("double"))


def cumulative_stack(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """samples() rows with the mean of the windows so far: w, how many they are, and stack."""
    w = Window.partitionBy(*by, "n").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("w", F.count(F.lit(1)).over(w)).withColumn("stack", F.avg("x").over(w))


def snr(rows: DataFrame, by: list[str], x: str, signal: int, noise: int) -> DataFrame:
    """The largest absolute value of the samples below `signal` over the root mean square of those from `noise` on; null without noise."""
    top, rest = F.max(F.when(F.col("n") < signal, F.abs(x))), F.sqrt(F.avg(F.when(F.col("n") >= noise, F.col(x) * F.col(x))))
    return rows.groupBy(*by).agg((top / F.nullif(rest, F.lit(0.0))).alias("snr"))


def growth(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The power p of y ~ x^p: the slope of the logarithms."""
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*by).agg(F.regr_slope(F.ln(y), F.ln(F.col(x).cast("double"))).alias("power"))


def selected(distance: Column, velocity: Column, period: Column, snr: Column, spread: Column, least_snr: float = 10.0, most_spread: float = 0.1) -> Column:
    """Far enough, clear enough, and the same in all seasons (km/s)."""
    return wavelength_ok(distance, velocity, period) & (snr > least_snr) & (spread <= most_spread)


def seasonal_spread(df: DataFrame, by: list[str], season: Column, v: str) -> DataFrame:
    """How far the seasons' mean velocities lie apart."""
    seasons = df.groupBy(*by, season.alias("_season")).agg(F.avg(v).alias("_v"))
    return seasons.groupBy(*by).agg((F.max("_v") - F.min("_v")).alias("spread"))


def events_above(daily: DataFrame, by: str, day: str, x: str, half: int, k: float) -> DataFrame:
    """daily rows with the background (mean of the days around, up to half before and after), the residual, and whether it is
    beyond k standard deviations of the group's residuals."""
    days = F.unix_date(day)
    out = daily.withColumn("background", F.avg(x).over(Window.partitionBy(by).orderBy(days).rangeBetween(-half, half)))
    out = out.withColumn("residual", F.col(x) - F.col("background"))
    return out.withColumn("event", F.abs("residual") > k * F.stddev_samp("residual").over(Window.partitionBy(by)))


def without_outliers(df: DataFrame, by: list[str], x: str, k: float = 2.0, rounds: int = 3) -> DataFrame:
    """Positive values, less those that lie beyond k standard deviations in log space, in a fixed number of rounds."""
    v = F.ln(F.col(x))
    df = df.where(F.col(x) > 0)
    for _ in range(rounds):
        of = df.groupBy(*by).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sigma"))
        df = df.join(of, by).where(F.abs(v - F.col("_mean")) <= k * F.coalesce("_sigma", F.lit(0.0)) + 1e-12).drop("_mean", "_sigma")
    return df


def clear_peak(f0: Column, amplitude: Column, record_s: Column, window_s: Column) -> Column:
    """Long enough a record and window for the frequency, and a peak above 2."""
    return (record_s > 200 / f0) & (window_s > 10 / f0) & (amplitude > 2)


def thickness(vs: Column, f0: Column) -> Column:
    return vs / (4 * F.nullif(f0, F.lit(0.0)))


def velocity(distance: Column, time: Column) -> Column:
    return distance / F.nullif(time, F.lit(0.0))


def near_axis(azimuth: Column, least: float) -> Column:
    """Whether a source (its azimuth in radians) lies near the line through two stations, on either side."""
    return F.abs(F.cos(azimuth)) > least


def horizontal_over_vertical(spectra: DataFrame) -> DataFrame:
    """(station, k, hv) of spectra(station, c, a) with c = 0 (vertical), 1 and 2 (horizontal): the root of the mean square of
    the horizontal ones over the vertical one. Stations without all three components drop out."""
    side = lambda c, name: spectra.where(F.col("c") == c).select("station", F.posexplode("a").alias("k", name))
    met = side(0, "z").join(side(1, "north"), ["station", "k"]).join(side(2, "east"), ["station", "k"])
    return met.select("station", "k", (F.sqrt((F.col("north") ** 2 + F.col("east") ** 2) / 2) / F.nullif("z", F.lit(0.0))).alias("hv"))


def correlated_again(ccs: DataFrame) -> DataFrame:
    """(a, shared, b, c3) of ccs(a, b, lag, c): correlations a-shared and shared-b, multiplied and summed over lags."""
    left = ccs.select("a", F.col("b").alias("shared"), "lag", F.col("c").alias("c1"))
    right = ccs.select(F.col("a").alias("shared"), "b", "lag", F.col("c").alias("c2"))
    return left.join(right, ["shared", "lag"]).groupBy("a", "shared", "b").agg(F.sum(F.col("c1") * F.col("c2")).alias("c3"))


def gather(stations: DataFrame, key: str, group: str) -> DataFrame:
    """Each station as a source with the others of its group as receivers: how many, and the first and last of them, from sums over the
    group; a station alone has no receivers and no row."""
    ends = stations.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_n > 1")
    inner = stations.join(ends, group).groupBy(group).agg(F.min(F.when(F.col(key) > F.col("_lo"), F.col(key))).alias("_lo2"), F.max(F.when(F.col(key) < F.col("_hi"), F.col(key))).alias("_hi2"))
    other = lambda end, second, name: F.when(F.col(key) == F.col(end), F.col(second)).otherwise(F.col(end)).alias(name)
    return stations.join(ends, group).join(inner, group).select(group, F.col(key).alias("source"), (F.col("_n") - 1).alias("receivers"), other("_lo", "_lo2", "first"), other("_hi", "_hi2", "last"))


def ray_quality(incidence: DataFrame) -> DataFrame:
    """Rays a cell, whether they are more than two, and the whole's number of rays for each cell."""
    cells = incidence.distinct().groupBy("cell_id").agg(F.count(F.lit(1)).alias("rays"))
    ratio = incidence.agg((F.countDistinct("ray_id") / F.countDistinct("cell_id")).alias("ratio"))
    return cells.withColumn("enough", F.col("rays") > 2).crossJoin(F.broadcast(ratio))  # one row


def bessel_j0(x: Column, steps: int = 128) -> Column:
    """J0(x) = mean of cos(x sin(theta)) over half a turn, by the midpoint rule (exact to rounding for |x| well below steps)."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, i: s + F.cos(x * F.sin(math.pi * (i + 0.5) / steps))) / steps


def cumulative_integral(df: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    """The trapezoid sum of y over x up to each row of its group."""
    w = Window.partitionBy(by).orderBy(order)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_area", F.coalesce(area, F.lit(0.0))).withColumn("integral", F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_area")


def water_level(df: DataFrame, channel: str, x: str, rounds: int = 2, level: float = 2.0) -> DataFrame:
    """Samples beyond `level` times the root mean square are brought down by that ratio, in a fixed number of rounds."""
    df = df.withColumn("levelled", F.col(x).cast("double"))
    for _ in range(rounds):
        of = df.groupBy(channel).agg((level * F.sqrt(F.avg(F.col("levelled") * F.col("levelled")))).alias("_most"))
        df = df.join(of, channel).withColumn("levelled", F.when(F.abs("levelled") > F.col("_most"), F.col("levelled") * F.col("_most") / F.abs("levelled")).otherwise(F.col("levelled"))).drop("_most")
    return df


def decimated(rows: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """samples() rows by bins of `factor`, each with its mean (a plain anti-alias filter)."""
    return rows.groupBy(*keys, F.floor(F.col("n") / factor).cast("int").alias("bin")).agg(F.avg("x").alias("x"))


def merged(segments: DataFrame, channel: str, start: Column, x: str, gap_s: float) -> DataFrame:
    """A channel's samples as runs without a gap of more than gap_s: (channel, run, samples, first, last, mean)."""
    w = Window.partitionBy(channel).orderBy("_t")
    timed = segments.withColumn("_t", start)
    cut = timed.withColumn("_new", F.when(F.col("_t") - F.lag("_t").over(w) <= gap_s, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(channel, "run").agg(F.count(F.lit(1)).alias("samples"), F.min("_t").alias("first"), F.max("_t").alias("last"), exact_mean(F.col(x)).alias("mean"))


def robust_stack(rows: DataFrame, by: list[str], x: str, rounds: int = 3) -> DataFrame:
    """Mean by groups that starts at the median and, in a fixed number of rounds, weighs each value by the inverse of its distance."""
    centre = exact_median(rows, by, x).withColumnRenamed("median", "stack")
    for _ in range(rounds):
        weight = 1 / F.greatest(F.abs(F.col(x) - F.col("stack")), F.lit(1e-6))
        centre = rows.join(centre, by).groupBy(*by).agg((F.sum(weight * F.col(x)) / F.sum(weight)).alias("stack"))
    return centre


def transfer_residuals(values: DataFrame, pair: str, window: str, t: str, g: str) -> DataFrame:
    """(window, f, e2): for each window the factor f of best fit t = f * g over its pairs, and the mean square of what is left."""
    fit = values.groupBy(window).agg((F.sum(F.col(t) * F.col(g)) / F.nullif(F.sum(F.col(g) * F.col(g)), F.lit(0.0))).alias("f"))
    return values.join(fit, window).groupBy(window).agg(F.first("f").alias("f"), F.avg((F.col(t) - F.col("f") * F.col(g)) ** 2).alias("e2"))


def ray_cells(rays: DataFrame, size: float, steps: int) -> DataFrame:
    """(ray_id, ix, iy, length) of rays(ray_id, x0, y0, x1, y1): each ray as `steps` equal parts, in the cells of their middles. Rays are dealt
    in bounded numbers, and their parts are put together where they are."""
    part = (F.col("i") + 0.5) / steps
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * part) / size).cast("long")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2) / steps
    parts = spread(rays).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return parts.select("ray_id", at("x0", "x1").alias("ix"), at("y0", "y1").alias("iy"), length.alias("_l")).groupBy("ray_id", "ix", "iy").agg(F.sum("_l").alias("length"))


def damped_steps(incidence: DataFrame, times: DataFrame, damping: float, smoothing: float, rounds: int) -> DataFrame:
    """(cell_id, slowness) of travel times t = G s, from G'G + damping + smoothing * L'L with L the difference to the next cell id:
    a fixed number of Jacobi rounds, each a join with the matrix of normal_matrix()."""
    g = normal_matrix(incidence)
    full = g.select("i", "j", "g").unionByName(g.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    cells = incidence.select(F.col("cell_id").alias("i")).distinct()
    next_ = cells.join(cells.select((F.col("i") - 1).alias("i")), "i", "left_semi").select("i", (F.col("i") + 1).alias("j"))
    rough = next_.select("i", F.col("i").alias("j")).unionByName(next_.select(F.col("j").alias("i"), "j")).withColumn("g", F.lit(float(smoothing)))
    rough = rough.unionByName(next_.withColumn("g", F.lit(-float(smoothing)))).unionByName(next_.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(-float(smoothing)).alias("g")))
    whole = full.unionByName(rough).unionByName(cells.select("i", F.col("i").alias("j"), F.lit(float(damping)).alias("g"))).groupBy("i", "j").agg(F.sum("g").alias("g"))
    matrix = stored(whole, "normal-matrix")
    right = stored(incidence.join(times, "ray_id").groupBy(F.col("cell_id").alias("i")).agg(F.sum(F.col("length") * F.col("t")).alias("b")), "normal-right")
    scale = matrix.groupBy("i").agg(F.sum(F.abs("g")).alias("d"))  # the sum of a row bounds it, so that rounds cannot grow
    x = right.join(scale, "i").select("i", (F.col("b") / F.col("d")).alias("x"))
    for _ in range(rounds):
        x = stored(x, "normal-solution")
        product = matrix.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("g") * F.col("x")).alias("ax"))
        x = x.join(product, "i").join(right, "i").join(scale, "i").select("i", (F.col("x") + (F.col("b") - F.col("ax")) / F.col("d")).alias("x"))
    return x.select(F.col("i").alias("cell_id"), F.col("x").alias("slowness"))
