"""Straight rays through a grid, and slowness or velocity from their travel times.

The unknowns lie in cells (cell_id, ix, iy); a ray's row of the matrix holds its length in each cell. What is minimised is

    |t - G s|^2 + damping |s - s0|^2 + smoothing |L (s - s0)|^2

with L the Laplacian over the neighbours above, below, left and right that are there. No matrix product G'G is made. A grid of up to
CELLS cells: each ray is one row, stored once, and a round multiplies by G and by its transpose in one pass over the rows, which
get the vector of cells (512 KB at most) and hand on sums by cells. A wider grid: two joins with sums. The product with damping +
smoothing * L'L, of thirteen entries a cell at most, is one more join. Vectors are tables; the driver gets five sums a round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import stored

#: Parts of a ray's length under which a crossing is taken as one with the next.
POINT = 1e-12
#: Cells whose vector is sent to the rays; with more, rays and cells meet by joins.
CELLS = 1 << 16


def _crossings(a: Column, b: Column, size: float) -> Column:
    """Where on the way from a to b (0 to 1) multiples of size are passed."""
    first, last = F.floor(F.least(a, b) / size) + 1, F.ceil(F.greatest(a, b) / size) - 1
    lines = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * size - a) / (b - a))


#: Rays of a task: what it holds of their cells is bounded by that, not by the input.
RAYS = 1 << 16


def spread(rays: DataFrame) -> DataFrame:
    """rays dealt by ray_id to as many tasks as they need at RAYS each, so that sums over a ray's cells stay in its task and are small."""
    least = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rays.repartition(max(least, math.ceil(rays.count() / RAYS)), "ray_id")


def traverse(rays: DataFrame, size: float) -> DataFrame:
    """(ray_id, ix, iy, length) of rays(ray_id, x0, y0, x1, y1): the exact length of each ray in each cell of a grid of squares. The
    ray's crossings with both kinds of grid lines are put in order within its row, and the middle of each stretch says in which cell
    it lies; a ray along a line lies in the cell after it. Rays without a length, and those with a null, have no rows."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _crossings(x0, x1, size), _crossings(y0, y1, size)))
    whole = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    ways = spread(rays).select("ray_id", "x0", "y0", "x1", "y1", whole.alias("_whole"), cuts.alias("_cuts")).where("_whole > 0")
    parts = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.get("_cuts", i - 1).alias("p"), F.get("_cuts", i).alias("q")))
    rows = ways.withColumn("_part", F.explode(parts)).withColumn("_share", F.col("_part.q") - F.col("_part.p")).where(F.col("_share") > POINT)
    middle = (F.col("_part.p") + F.col("_part.q")) / 2
    cell = lambda a, b: F.floor((a + (b - a) * middle) / size).cast("long")
    return rows.select("ray_id", cell(x0, x1).alias("ix"), cell(y0, y1).alias("iy"), (F.col("_share") * F.col("_whole")).alias("length"))


def smoothness(cells: DataFrame, damping: float, smoothing: float) -> DataFrame:
    """(i, j, h): damping + smoothing * L'L over cells(cell_id, ix, iy). L has 1 for each neighbour and minus their number in place."""
    sides = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    towards = cells.select("cell_id", "ix", "iy", F.explode(sides).alias("s")).select(F.col("cell_id").alias("i"), (F.col("ix") + F.col("s.u")).alias("ix"), (F.col("iy") + F.col("s.v")).alias("iy"))
    edges = towards.join(cells, ["ix", "iy"]).select("i", F.col("cell_id").alias("j"), F.lit(1.0).alias("l"))
    laplace = edges.unionByName(edges.groupBy("i").agg((-F.sum("l")).alias("l")).select("i", F.col("i").alias("j"), "l"))
    square = laplace.select("i", F.col("j").alias("k"), "l").join(laplace.select(F.col("i").alias("k"), "j", F.col("l").alias("m")), "k").select("i", "j", (smoothing * F.col("l") * F.col("m")).alias("h"))
    return square.unionByName(cells.select(F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), F.lit(float(damping)).alias("h"))).groupBy("i", "j").agg(F.sum("h").alias("h"))


class System:
    """(G'G + R) x = b for G(ray_id, cell_id, g) and a symmetric R(i, j, h) of smoothness(). G is kept by ray and by cell, and R by column,
    so that a round shuffles vectors only; what an executor loses is dealt again from the stored tables."""

    def __init__(self, matrix: DataFrame, rough: DataFrame):
        parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        matrix = stored(matrix.select("ray_id", "cell_id", "g"), "rays")
        dealt = lambda df, key: df.repartition(parts, key).persist(StorageLevel.DISK_ONLY)
        self.by_ray, self.by_cell, self.rough = dealt(matrix, "ray_id"), dealt(matrix, "cell_id"), dealt(stored(rough, "roughness"), "j")

    def transposed(self, rays: DataFrame) -> DataFrame:
        """G'v of rays(ray_id, v): (cell_id, v)."""
        return self.by_ray.join(rays, "ray_id").groupBy("cell_id").agg(F.sum(F.col("g") * F.col("v")).alias("v"))

    def along(self, cells: DataFrame) -> DataFrame:
        """G v of cells(cell_id, v): (ray_id, v)."""
        return self.by_cell.join(cells, "cell_id").groupBy("ray_id").agg(F.sum(F.col("g") * F.col("v")).alias("v"))

    def smoothed(self, cells: DataFrame) -> DataFrame:
        """R v: (cell_id, v)."""
        return self.rough.join(cells.withColumnRenamed("cell_id", "j"), "j").groupBy(F.col("i").alias("cell_id")).agg(F.sum(F.col("h") * F.col("v")).alias("v"))

    def times(self, cells: DataFrame) -> DataFrame:
        """(G'G + R) v: (cell_id, v)."""
        return self.transposed(self.along(cells)).unionByName(self.smoothed(cells)).groupBy("cell_id").agg(F.sum("v").alias("v"))

    def close(self) -> None:
        for df in (self.by_ray, self.by_cell, self.rough):
            df.unpersist()


def by_rays(incidence: DataFrame) -> DataFrame:
    """(ray_id, cells, lengths) of (ray_id, cell_id, length): a row a ray. What is so already stays."""
    if "cells" in incidence.columns:
        return incidence
    listed = incidence.groupBy("ray_id").agg(F.collect_list(F.struct("cell_id", "length")).alias("_e"))
    return listed.select("ray_id", F.col("_e.cell_id").alias("cells"), F.col("_e.length").alias("lengths"))


def by_cells(incidence: DataFrame) -> DataFrame:
    """The other way: (ray_id, cell_id, length), a row a ray and cell."""
    if "cell_id" in incidence.columns:
        return incidence
    return incidence.select("ray_id", F.inline(F.arrays_zip(F.col("cells").alias("cell_id"), F.col("lengths").alias("length")))).groupBy("ray_id", "cell_id").agg(F.sum("length").alias("length"))


class RaySystem:
    """(D G'G D + R) x = b for rays(cells, lengths, t), D = diag(scale) and R(i, j, h) of smoothness(), over up to CELLS cells. Cells of rays
    that are not among `cells` have no say."""

    def __init__(self, rays: DataFrame, cells: DataFrame, rough: DataFrame):
        self.rays, self.rough, self.cells = rays, rough, cells
        self.ids = np.sort(np.array([r[0] for r in cells.select("cell_id").distinct().collect()], np.int64))
        self.scale = np.ones(len(self.ids))

    def vector(self, cells: DataFrame) -> np.ndarray:
        """cells(cell_id, v) in the order of ids; 0 where there is none."""
        held = cells.select("cell_id", F.col("v").cast("double")).toArrow()
        out = np.zeros(len(self.ids))
        out[np.searchsorted(self.ids, held.column("cell_id").to_numpy())] = held.column("v").to_numpy()
        return out

    def passed(self, v: np.ndarray, late: bool) -> DataFrame:
        """(cell_id, v, square, rays): D G'd by cells, with d = G v of each ray, or what G v leaves of its t if late; rays without a t are then
        left out. In rows of their own, without a cell: the sum of d * d and the number of rays."""
        ids, scale = self.ids, self.scale

        def run(batches):
            sums, square, many = np.zeros(len(ids)), 0.0, 0
            for batch in batches:
                lists = batch.column("cells")
                cells, g = lists.flatten().to_numpy(zero_copy_only=False), batch.column("lengths").flatten().to_numpy(zero_copy_only=False)
                ray = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                at = np.minimum(np.searchsorted(ids, cells), len(ids) - 1)
                known = ids[at] == cells
                at, g, ray = at[known], g[known], ray[known]
                d = np.bincount(ray, g * v[at], batch.num_rows)
                if late:
                    t = batch.column("t").to_numpy(zero_copy_only=False)
                    there = ~np.isnan(t)
                    d, many = np.where(there, t - d, 0.0), many + int(there.sum())
                    square += float(d @ d)
                sums += np.bincount(at, g * d[ray], len(ids))
            met = np.flatnonzero(sums)
            columns = [pa.array([*ids[met].tolist(), None], pa.int64()), pa.array([*(sums * scale)[met], None], pa.float64()), pa.array([*[0.0] * len(met), square]), pa.array([*[0] * len(met), many], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["cell_id", "v", "square", "rays"])

        if not len(ids):
            return self.rays.sparkSession.createDataFrame([], "cell_id long, v double, square double, rays long")
        return self.rays.select("cells", "lengths", "t").mapInArrow(run, "cell_id long, v double, square double, rays long")

    def late(self, v: np.ndarray) -> DataFrame:
        """D G'(t - G v): (cell_id, v)."""
        return self.passed(v, True).where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.sum("v").alias("v"))

    def misfit(self, v: np.ndarray) -> float | None:
        """The root mean square of t - G v."""
        s = self.passed(v, True).where("cell_id IS NULL").agg(F.sum("square").alias("d"), F.sum("rays").alias("n")).first()
        return math.sqrt(s.d / s.n) if s.n else None

    def smoothed(self, cells: DataFrame) -> DataFrame:
        return self.rough.join(cells.withColumnRenamed("cell_id", "j"), "j").groupBy(F.col("i").alias("cell_id")).agg(F.sum(F.col("h") * F.col("v")).alias("v"))

    def times(self, cells: DataFrame) -> DataFrame:
        """(D G'G D + R) v: (cell_id, v)."""
        along = self.passed(self.scale * self.vector(cells), False).where("cell_id IS NOT NULL").select("cell_id", "v")
        return along.unionByName(self.smoothed(cells)).groupBy("cell_id").agg(F.sum("v").alias("v"))


def with_times(incidence: DataFrame, times: DataFrame | None) -> DataFrame:
    """Rays as rows with their t, stored once; without times the rays have theirs."""
    rays = by_rays(incidence)
    if times is None:
        return rays if hasattr(rays, "stored_at") else stored(rays, "rays")
    return stored(rays.join(times.select("ray_id", F.col("t").cast("double")), "ray_id", "left"), "rays")


def solve(system: System, right: DataFrame, tolerance: float = 1e-10, rounds: int | None = None, most: int = 2000) -> DataFrame:
    """(cell_id, x, residual) of right(cell_id, b), by conjugate gradients from 0 until |b - A x| <= tolerance * |b|, or after a given
    number of rounds. residual is |b - A x| / |b|, made from x at the end. Cells that no ray meets are solved for by R."""
    state = right.select("cell_id", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p"))
    size, done, before = None, 0, None
    while True:
        product = system.times(state.select("cell_id", F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        state = stored(state.join(product, "cell_id", "left").select("cell_id", "x", "r", "p", F.coalesce("ap", F.lit(0.0)).alias("ap")), "gradients", before)
        before = [state]
        dot = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(a + b)
        s = state.agg(dot("p", "ap"), dot("r", "p"), dot("r", "r"), dot("r", "ap"), dot("ap", "ap")).first()
        size = s.rr if size is None else size
        if s.pap <= 0 or s.rr <= tolerance * tolerance * size and rounds is None or done == rounds:
            break
        if done == most:
            raise RuntimeError(f"the residual is {math.sqrt(s.rr / size):.2g} after {most} rounds")
        alpha = s.rp / s.pap
        left = max(0.0, s.rr - 2 * alpha * s.rap + alpha * alpha * s.apap)
        r = F.col("r") - alpha * F.col("ap")
        state = state.select("cell_id", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r + left / s.rr * F.col("p")).alias("p"))
        done += 1
    met = right.join(state.select("cell_id", "x"), "cell_id").join(system.times(state.select("cell_id", F.col("x").alias("v"))), "cell_id", "left")
    met = stored(met.select("cell_id", "x", F.col("b"), (F.col("b") - F.coalesce("v", F.lit(0.0))).alias("d")), "gradients", before)
    off = met.agg(F.sum(F.col("d") * F.col("d")).alias("d"), F.sum(F.col("b") * F.col("b")).alias("b")).first()
    return met.select("cell_id", "x", F.lit(math.sqrt(off.d / off.b) if off.b else 0.0).alias("residual"))


def slowness(incidence: DataFrame, times: DataFrame | None, cells: DataFrame, start: float, damping: float, smoothing: float, tolerance: float = 1e-10, rounds: int | None = None) -> DataFrame:
    """(cell_id, slowness, residual): travel times(ray_id, t) of incidence(ray_id, cell_id, length) solved for the slowness of
    cells(cell_id, ix, iy), damped and smoothed towards `start`. incidence may be rows of rays too, (ray_id, cells, lengths), and
    with times None these have their t."""
    rough = smoothness(cells, damping, smoothing)
    if cells.count() <= CELLS:
        rays = with_times(incidence, times)
        straight = F.aggregate("lengths", F.lit(0.0), lambda s, x: s + x)
        system = RaySystem(rays.withColumn("t", F.col("t") - start * straight), cells, stored(rough, "roughness"))
        back = system.late(np.zeros(len(system.ids)))
    else:
        times, incidence = times if times is not None else incidence.select("ray_id", "t"), by_cells(incidence)
        system = System(incidence.withColumnRenamed("length", "g"), rough)
        straight = incidence.groupBy("ray_id").agg((start * F.sum("length")).alias("t0"))
        back = system.transposed(times.join(straight, "ray_id").select("ray_id", (F.col("t") - F.col("t0")).alias("v")))
    right = stored(cells.select("cell_id").join(back, "cell_id", "left").select("cell_id", F.coalesce("v", F.lit(0.0)).alias("b")), "right")
    found = solve(system, right, tolerance, rounds)
    if isinstance(system, System):
        system.close()
    return found.select("cell_id", (F.col("x") + start).alias("slowness"), "residual")


def velocities(incidence: DataFrame, times: DataFrame | None, cells: DataFrame, start: float, damping: float, smoothing: float, outer: int = 5, tolerance: float = 1e-8, change: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """(cell_id, velocity, misfit, rounds) by Gauss-Newton rounds: travel times are made anew from the last velocities, their
    derivative by velocity is -length / velocity^2, and each round solves for the step (by `rounds` of gradients, or to the tolerance)
    until the largest step is below `change` of the start, or `outer` rounds are done. misfit is the root mean square of what is left of the times."""
    rough = stored(smoothness(cells, damping, smoothing), "roughness")
    model = stored(cells.select("cell_id", F.lit(float(start)).alias("velocity")), "velocities")
    if cells.count() <= CELLS:
        return _velocities_of_rays(RaySystem(with_times(incidence, times), cells, rough), model, start, outer, tolerance, change, rounds)
    times, incidence = times if times is not None else incidence.select("ray_id", "t"), by_cells(incidence)
    for done in range(1, outer + 1):
        here = incidence.join(model, "cell_id")
        jacobian = here.select("ray_id", "cell_id", (-F.col("length") / (F.col("velocity") * F.col("velocity"))).alias("g"))
        system = System(jacobian, rough)
        made = here.groupBy("ray_id").agg(F.sum(F.col("length") / F.col("velocity")).alias("made"))
        late = times.join(made, "ray_id").select("ray_id", (F.col("t") - F.col("made")).alias("v"))
        back = system.smoothed(model.select("cell_id", (F.col("velocity") - start).alias("v"))).withColumnRenamed("v", "back")
        right = cells.select("cell_id").join(system.transposed(late), "cell_id", "left").join(back, "cell_id", "left")
        right = stored(right.select("cell_id", (F.coalesce("v", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))).alias("b")), "right")
        step = solve(system, right, tolerance, rounds)
        system.close()
        model = stored(model.join(step, "cell_id").select("cell_id", (F.col("velocity") + F.col("x")).alias("velocity"), F.abs("x").alias("step")), "velocities")
        if model.agg(F.max("step")).first()[0] <= change * start:
            break
        model = model.drop("step")
    made = incidence.join(model, "cell_id").groupBy("ray_id").agg(F.sum(F.col("length") / F.col("velocity")).alias("made"))
    misfit = times.join(made, "ray_id").agg(F.sqrt(F.avg((F.col("t") - F.col("made")) ** 2))).first()[0]
    return model.select("cell_id", "velocity", F.lit(misfit).alias("misfit"), F.lit(done).alias("rounds"))


def _velocities_of_rays(system: RaySystem, model: DataFrame, start: float, outer: int, tolerance: float, change: float, rounds: int | None) -> DataFrame:
    """velocities() over rays as rows: the derivative is G times a diagonal, so that G stays as it is stored."""
    slow = lambda: 1 / system.vector(model.select("cell_id", F.col("velocity").alias("v"))) if len(system.ids) else np.zeros(0)
    for done in range(1, outer + 1):
        now = slow()
        system.scale = -now * now
        back = system.smoothed(model.select("cell_id", (F.col("velocity") - start).alias("v"))).withColumnRenamed("v", "back")
        right = model.select("cell_id").join(system.late(now), "cell_id", "left").join(back, "cell_id", "left")
        right = stored(right.select("cell_id", (F.coalesce("v", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))).alias("b")), "right")
        step = solve(system, right, tolerance, rounds)
        model = stored(model.join(step, "cell_id").select("cell_id", (F.col("velocity") + F.col("x")).alias("velocity"), F.abs("x").alias("step")), "velocities")
        if (model.agg(F.max("step")).first()[0] or 0.0) <= change * start:
            break
        model = model.drop("step")
    return model.select("cell_id", "velocity", F.lit(system.misfit(slow())).cast("double").alias("misfit"), F.lit(done).alias("rounds"))
