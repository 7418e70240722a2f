"""Transfer coefficients of many pairs in many windows as a product of a factor a window and one a pair, and what is left of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import stored


def rank_one(values: DataFrame, pair: str, window: str, t: str, rounds: int | None = None, tolerance: float = 1e-10, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(window, f) and (pair, g) of least squares for t = f * g + e, by alternating: g from f by sums over a pair's windows, then f from g by
    sums over a window's pairs, f with a mean square of 1, until f moves by less than `tolerance` of itself (root mean square),
    or for a fixed number of rounds. Any (pair, window) may be missing, and null values drop out; a factor that no value tells is 0."""
    rows = stored(values.select(F.col(pair).alias("p"), F.col(window).alias("w"), F.col(t).cast("double").alias("t")).dropna(), "transfer")
    f = stored(rows.select("w").distinct().withColumn("f", F.lit(1.0)), "transfer-f")
    done = 0
    while True:
        ratio = lambda by: F.coalesce(F.sum(F.col("t") * F.col(by)) / F.nullif(F.sum(F.col(by) * F.col(by)), F.lit(0.0)), F.lit(0.0))
        g = stored(rows.join(f, "w").groupBy("p").agg(ratio("f").alias("g")), "transfer-g")
        fresh = rows.join(g, "p").groupBy("w").agg(ratio("g").alias("u"))
        met = stored(f.join(fresh, "w"), "transfer-f")
        size = met.agg(F.sqrt(F.avg(F.col("u") * F.col("u")))).first()[0] or 1.0  # one number
        done += 1
        scaled = met.select("w", "f", (F.col("u") / size).alias("u"))
        moved = scaled.agg(F.sqrt(F.avg((F.col("u") - F.col("f")) ** 2))).first()[0] or 0.0
        f = scaled.select("w", F.col("u").alias("f"))
        if done == rounds or rounds is None and moved <= tolerance:
            break
        if done == most:
            raise RuntimeError(f"factors still move by {moved:.2g} after {most} rounds")
    f = stored(f, "transfer-f")
    g = rows.join(f, "w").groupBy("p").agg(ratio("f").alias("g"))  # those that fit the last f
    return f.select(F.col("w").alias(window), "f"), g.select(F.col("p").alias(pair), "g")


def residuals(values: DataFrame, pair: str, window: str, t: str, f: DataFrame, g: DataFrame) -> DataFrame:
    """values with f, g and e = t - f * g."""
    return values.join(f, window).join(g, pair).withColumn("e", F.col(t) - F.col("f") * F.col("g"))
