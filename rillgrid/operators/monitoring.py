"""Velocity changes from correlations to events: stretching against a reference, a seasonal fit, and what stands out of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import exact_median, stretching

#: Days of a year, and how many of its harmonics are fitted.
YEAR, HARMONICS = 365.25, 2


def changes(traces: DataFrame, group: str, day: str, data: str, most: float = 0.05, steps: int = 101) -> DataFrame:
    """(group, day, dv_v, correlation): each trace's best stretch against its group's reference, the mean of all its traces."""
    rows = traces.select(group, F.posexplode(data).alias("_n", "_x")).groupBy(group, "_n").agg(F.avg("_x").alias("_x"))
    reference = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", "_x"))).alias("_r")).select(group, F.col("_r._x").alias("_r"))  # as long as a trace
    best = traces.join(reference, group).where(F.size(data) == F.size("_r")).select(group, day, stretching(most, steps)(F.col("_r"), F.col(data)).alias("_s"))
    return best.select(group, day, F.col("_s")[0].alias("dv_v"), F.col("_s")[1].alias("correlation"))


def solve_small(matrix: Column, n: int) -> Column:
    """array<double>: the solution of n equations given as array<array<double>> of n + 1 columns, by elimination in place. A pivot of
    (nearly) 0 gives 0 for its unknown, so that a series too short for all terms is fitted by the first of them."""

    def step(m: Column, k: Column) -> Column:
        own = F.get(m, k)
        pivot = F.get(own, k)
        scaled = F.when(F.abs(pivot) > 1e-9, F.transform(own, lambda v: v / pivot)).otherwise(F.transform(own, lambda v, j: F.lit(0.0)))
        return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - F.get(row, k) * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)
    return F.transform(done, lambda row: F.get(row, n))


def terms(day: Column) -> list[Column]:
    """1, and sine and cosine of the year and of its parts."""
    waves = [f(2 * math.pi * h / YEAR * day) for h in range(1, HARMONICS + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), *waves]


def seasonal(series: DataFrame, by: list[str], day: str, x: str, k: float = 4.0, rounds: int = 3) -> DataFrame:
    """series with seasonal (the fit), residual, event and amplitude (of the yearly wave), by normal equations from sums over each group.
    Days beyond k robust deviations (1.4826 times the median of absolute residuals) are events; they take no part in the next
    fit, `rounds` fits in all. day is a date. Null values drop out."""
    n = 1 + 2 * HARMONICS
    rows = series.where(F.col(x).isNotNull() & F.col(day).isNotNull()).withColumn("_t", F.unix_date(day).cast("double")).withColumn("event", F.lit(False))
    for _ in range(rounds):
        own = [*terms(F.col("_t")), F.col(x)]
        quiet = rows.where("NOT event")
        sums = quiet.groupBy(*by).agg(*[F.sum(own[i] * own[j]).alias(f"_{i}_{j}") for i in range(n) for j in range(i, n + 1)])
        at = lambda i, j: F.col(f"_{min(i, j)}_{max(i, j)}")
        matrix = F.array(*[F.array(*[at(i, j) for j in range(n + 1)]) for i in range(n)])
        fits = sums.select(*by, solve_small(matrix, n).alias("_c"))
        fitted = rows.drop("event", "seasonal", "residual", "amplitude").join(fits, by)
        made = sum((F.col("_c")[i] * t for i, t in enumerate(terms(F.col("_t")))), F.lit(0.0))
        fitted = fitted.withColumn("seasonal", made).withColumn("residual", F.col(x) - F.col("seasonal")).withColumn("amplitude", F.hypot(F.col("_c")[1], F.col("_c")[2])).drop("_c")
        spread = exact_median(fitted.withColumn("_a", F.abs("residual")), by, "_a").withColumnRenamed("median", "_m")
        rows = fitted.join(spread, by).withColumn("event", F.abs("residual") > k * 1.4826 * F.col("_m") + 1e-15).drop("_m")
    return rows.drop("_t")
