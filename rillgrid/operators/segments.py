"""Long channels in bounded pieces: numbering, frames of neighbours, and merging overlapping segments.

No window here holds a channel: rows are cut into ranges or bins, worked on there, and what crosses a border is sent over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import stored

#: Samples of a channel that one window holds.
BIN = 4096


def numbered(df: DataFrame, channel: str, order: str, name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 within each channel, in the given order. Rows are cut at fixed bounds of (channel, order), as many as
    there are shuffle partitions, so that a channel that holds most rows is cut too; a part is numbered on its own and shifted
    by the counts of its channel's parts before it. Only the bounds reach the driver. Rows without a channel count as one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col(channel).alias("c"), F.col(order).alias("o"))
    found = df.select(place.alias("p")).repartitionByRange(parts, "p").groupBy(F.spark_partition_id()).agg(F.min("p").alias("low"))
    bounds = sorted(((r.low.c, r.low.o) for r in found.collect() if r.low.c is not None and r.low.o is not None))
    kinds = dict(df.dtypes)
    lit = lambda v, c: F.lit(v).cast(kinds[c])
    at = F.lit(0)
    if bounds:  # how many bounds are not after it: by halves, since a row that meets every bound costs as much as there are partitions
        ordered = F.sort_array(F.array(*[F.struct(lit(c, channel).alias("c"), lit(o, order).alias("o")) for c, o in bounds]))
        jumps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        past = lambda k, jump: (k + jump <= len(bounds)) & (F.get(ordered, k + jump - 1) <= place)
        at = F.aggregate(jumps, F.lit(0), lambda k, jump: F.when(past(k, jump), k + jump).otherwise(k))
    cut = df.withColumn("_part", at)
    counts = cut.groupBy(channel, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(channel).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    shifts = counts.select(F.col(channel).alias("_c"), F.col("_part").alias("_p"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(channel, "_part").orderBy(order))
    met = cut.withColumn("_within", within).join(shifts, F.col(channel).eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return met.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before", "_c", "_p")


def following(df: DataFrame, channel: str, order: str) -> DataFrame:
    """(a, b): each row's order column with that of the next row of its channel, by their numbers; the last has no pair. Rows without a
    channel count as one, as in numbered()."""
    n = numbered(df.select(channel, order), channel, order, "_n")
    one, two = n.select(F.col(channel).alias("_c"), F.col(order).alias("a"), "_n"), n.select(F.col(channel).alias("_d"), F.col(order).alias("b"), (F.col("_n") - 1).alias("_m"))
    return one.join(two, F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_n") == F.col("_m"))).select("a", "b")


def framed(df: DataFrame, channel: str, n: str, half: int, columns: dict[str, Column], bin_size: int = BIN) -> DataFrame:
    """df with columns worked out over frame(channel, n, half): each row's neighbours up to `half` before and after it. n counts from 1
    without gaps. Channels are cut into bins; rows near a border are sent to the next bin too and serve there as neighbours only."""
    size = max(bin_size, half)
    home = F.floor((F.col(n) - 1) / size)
    low, high = F.floor((F.col(n) - 1 - half) / size), F.floor((F.col(n) - 1 + half) / size)
    spread = df.withColumn("_home", home).withColumn("_bin", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), high)))
    return spread.withColumns(columns).where("_bin = _home").drop("_bin", "_home")


def frame(channel: str, n: str, half: int):
    """The window that framed() works on."""
    return Window.partitionBy(channel, "_bin").orderBy(n).rowsBetween(-half, half)


def merge_samples(samples: DataFrame, channel: str, t: str, x: str, rank: str, most_gap: int = 0, bin_size: int = BIN) -> DataFrame:
    """(channel, t, x, filled, run) of samples of overlapping segments on one grid of whole numbers t. Of samples at one t that of
    the largest rank stays (ties: the largest x), so a later segment of higher rank has precedence sample by sample. Gaps of up to
    most_gap missing samples are filled by straight lines (filled = true); longer ones part runs, counted from 1. Rows
    whose channel, t or x is null drop out; a segment without samples has no say."""
    one = samples.select(F.col(channel).alias("c"), F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"), F.col(rank).alias("r")).dropna(subset=["c", "t", "x"])
    one = one.groupBy("c", "t").agg(F.max(F.struct("r", "x")).alias("best")).select("c", "t", F.floor(F.col("t") / bin_size).alias("bin"), F.col("best.x").alias("x"))
    one = stored(one, "merged-samples")
    bins = Window.partitionBy("c").orderBy("bin")  # a row a bin
    edges = one.groupBy("c", "bin").agg(F.min(F.struct("t", "x")).alias("first"), F.max("t").alias("last"))
    edges = edges.select("c", "bin", F.lag("last").over(bins).alias("before"), F.lead("first").over(bins).alias("after"))
    w = Window.partitionBy("c", "bin").orderBy("t")
    met = one.join(edges, ["c", "bin"])
    before, after = F.coalesce(F.lag("t").over(w), "before"), F.coalesce(F.lead(F.struct("t", "x")).over(w), "after")
    starts = F.when(F.col("t") - before <= most_gap + 1, 0).otherwise(1)
    marked = met.withColumn("after", after).withColumn("starts", starts).withColumn("so_far", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = stored(marked.select("c", "bin", "t", "x", "after", "starts", "so_far"), "merged-marks", [one])
    earlier = marked.groupBy("c", "bin").agg(F.sum("starts").alias("k")).select("c", "bin", F.coalesce(F.sum("k").over(bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    runs = marked.join(earlier, ["c", "bin"]).select("c", "t", "x", "after", (F.col("earlier") + F.col("so_far")).alias("run"))
    wide = F.col("after.t") - F.col("t")
    line = F.col("x") + (F.col("after.x") - F.col("x")) * (F.col("s") - F.col("t")) / wide
    gaps = runs.where((wide > 1) & (wide <= most_gap + 1)).withColumn("s", F.explode(F.sequence(F.col("t") + 1, F.col("after.t") - 1)))
    filled = gaps.select("c", F.col("s").alias("t"), line.alias("x"), F.lit(True).alias("filled"), "run")
    return runs.select("c", "t", "x", F.lit(False).alias("filled"), "run").unionByName(filled).select(F.col("c").alias(channel), "t", "x", "filled", F.col("run").cast("long").alias("run"))
