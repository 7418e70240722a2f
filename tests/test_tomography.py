import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.operators import signal, tomography
from rillgrid.sources import synthetic


def rays_of(spark, n, nx, ny, seed=0):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, nx), r.uniform(0, ny), r.uniform(0, nx), r.uniform(0, ny)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ray_id long, x0 double, y0 double, x1 double, y1 double")


def test_lengths_sum_to_the_ray(spark):
    rows, rays = rays_of(spark, 200, 9, 7)
    rows = [*rows, (200, 0.0, 0.0, 9.0, 7.0), (201, 1.0, 1.0, 5.0, 5.0), (202, 3.0, 0.5, 3.0, 6.5), (203, 8.0, 2.0, 1.0, 2.0)]
    rays = spark.createDataFrame([*rows, (204, 2.0, 2.0, 2.0, 2.0), (205, None, 2.0, 2.0, 2.0)], rays.schema)
    got = tomography.traverse(rays, 1.0).groupBy("ray_id").agg(F.sum("length").alias("l"), F.count(F.lit(1)).alias("n"), F.count_distinct("ix", "iy").alias("cells")).collect()
    assert {r.ray_id for r in got} == set(range(204))  # a point and a null have no rows
    for r in got:
        _, x0, y0, x1, y1 = rows[r.ray_id]
        assert abs(r.l - np.hypot(x1 - x0, y1 - y0)) < 1e-9 and r.n == r.cells <= 9 + 7 + 1


def test_cells_of_a_ray_by_fine_steps(spark):
    """Against the cells that many points of each ray lie in."""
    rows, rays = rays_of(spark, 60, 6, 6, seed=3)
    got = {}
    for r in tomography.traverse(rays, 1.0).collect():
        got.setdefault(r.ray_id, {})[r.ix, r.iy] = r.length
    for i, x0, y0, x1, y1 in rows:
        t = (np.arange(40_000) + 0.5) / 40_000
        cells, n = np.unique(np.column_stack([np.floor(x0 + (x1 - x0) * t), np.floor(y0 + (y1 - y0) * t)]).astype(int), axis=0, return_counts=True)
        near = {tuple(c): k / 40_000 * np.hypot(x1 - x0, y1 - y0) for c, k in zip(cells.tolist(), n)}
        assert near.keys() <= got[i].keys() and all(abs(got[i][c] - near.get(c, 0)) < 2e-3 for c in got[i])


def dense(spark, nx, ny, rays):
    cells = synthetic.velocity_grid(spark, nx, ny)
    lengths = tomography.traverse(rays, 1.0).withColumn("cell_id", F.col("iy") * nx + F.col("ix"))
    incidence = lengths.groupBy("ray_id", "cell_id").agg(F.sum("length").alias("length"))
    g = np.zeros((rays.count(), nx * ny))
    for r in incidence.collect():
        g[r.ray_id, r.cell_id] = r.length
    laplace = np.zeros((nx * ny, nx * ny))
    for y in range(ny):
        for x in range(nx):
            for u, v in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                if 0 <= x + u < nx and 0 <= y + v < ny:
                    laplace[y * nx + x, (y + v) * nx + x + u] += 1
                    laplace[y * nx + x, y * nx + x] -= 1
    return cells, incidence, g, laplace


def test_slowness_equals_the_dense_solution(spark):
    nx, ny = 5, 4
    _, rays = rays_of(spark, 60, nx, ny, seed=1)
    cells, incidence, g, laplace = dense(spark, nx, ny, rays)
    s = np.array([1 / r.velocity for r in cells.orderBy("cell_id").collect()])
    times = spark.createDataFrame([(i, float(t)) for i, t in enumerate(g @ s)], "ray_id long, t double")
    a = g.T @ g + 0.1 * np.eye(nx * ny) + 0.05 * laplace.T @ laplace
    want = 0.3 + np.linalg.solve(a, g.T @ (g @ s - g @ np.full(nx * ny, 0.3)))
    got = tomography.slowness(incidence, times, cells, 0.3, 0.1, 0.05, tolerance=1e-11).orderBy("cell_id").collect()
    assert np.abs(np.array([r.slowness for r in got]) - want).max() < 1e-8 and got[0].residual < 1e-10


def test_velocities_by_gauss_newton(spark):
    nx, ny = 5, 4
    _, rays = rays_of(spark, 120, nx, ny, seed=2)
    cells, incidence, g, laplace = dense(spark, nx, ny, rays)
    true = np.array([r.velocity for r in cells.orderBy("cell_id").collect()])
    times = spark.createDataFrame([(i, float(t)) for i, t in enumerate(g @ (1 / true))], "ray_id long, t double")
    v, rough = np.full(nx * ny, 3.0), 1e-4 * np.eye(nx * ny) + 1e-4 * laplace.T @ laplace
    for _ in range(3):
        j = -g / v**2
        v = v + np.linalg.solve(j.T @ j + rough, j.T @ (g @ (1 / true) - g @ (1 / v)) - rough @ (v - 3.0))
    got = tomography.velocities(incidence, times, cells, 3.0, 1e-4, 1e-4, outer=3, tolerance=1e-11, change=0.0).orderBy("cell_id").collect()
    found = np.array([r.velocity for r in got])
    assert np.abs(found - v).max() < 1e-7 and np.abs(found - true).max() < 0.05 and got[0].misfit < 1e-2 and got[0].rounds == 3


def test_cells_without_rays_and_no_rays(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 5, 5)], "cell_id long, ix long, iy long")
    incidence = spark.createDataFrame([(1, 0, 2.0)], "ray_id long, cell_id long, length double")
    times = spark.createDataFrame([(1, 1.0)], "ray_id long, t double")
    got = {r.cell_id: r.slowness for r in tomography.slowness(incidence, times, cells, 0.25, 1e-6, 1e-3).collect()}
    assert abs(got[0] - 0.5) < 1e-3 and abs(got[1] - 0.5) < 1e-2 and got[2] == pytest.approx(0.25)
    none = tomography.slowness(incidence.limit(0), times.limit(0), cells, 0.25, 1.0, 1.0).collect()
    assert {r.slowness for r in none} == {0.25} and {r.residual for r in none} == {0.0}


def test_a_wide_grid_by_joins_gives_the_same(spark, monkeypatch):
    nx, ny = 5, 4
    _, rays = rays_of(spark, 40, nx, ny, seed=5)
    cells, incidence, g, _ = dense(spark, nx, ny, rays)
    times = spark.createDataFrame([(i, float(t)) for i, t in enumerate(g.sum(axis=1) * 0.3)][:35], "ray_id long, t double")
    made = []
    for most in (tomography.CELLS, 0):
        monkeypatch.setattr(tomography, "CELLS", most)
        slow = tomography.slowness(incidence, times, cells, 0.25, 0.1, 0.05, rounds=3).orderBy("cell_id").collect()
        fast = tomography.velocities(incidence, times, cells, 3.0, 0.1, 0.05, outer=2, change=0.0, rounds=2).orderBy("cell_id").collect()
        made.append(np.array([[a.slowness, a.residual, b.velocity, b.misfit] for a, b in zip(slow, fast)]))
    assert np.abs(made[0] - made[1]).max() < 1e-9


def test_a_round_shuffles_cells_and_not_rays(spark):
    """Each task hands on at most a row a cell; it was a row a ray and cell."""
    _, rays = rays_of(spark, 4000, 4, 3, seed=6)
    cells, incidence, _, _ = dense(spark, 4, 3, rays)
    held = tomography.with_times(incidence, rays.select("ray_id", F.lit(1.0).alias("t")))
    system = tomography.RaySystem(held, cells, tomography.smoothness(cells, 1.0, 1.0))
    assert system.passed(np.ones(12), False).count() <= held.rdd.getNumPartitions() * 13


def test_a_task_has_a_bounded_number_of_rays(spark, monkeypatch):
    """More rays, more tasks, and a ray's cells are summed where they are."""
    monkeypatch.setattr(tomography, "RAYS", 50)
    _, rays = rays_of(spark, 1000, 4, 3)
    for made in (tomography.traverse(rays, 1.0).groupBy("ray_id", "ix", "iy").agg(F.sum("length")), signal.ray_cells(rays, 1.0, 32)):
        assert made.rdd.getNumPartitions() == 20
        assert "ENSURE_REQUIREMENTS" not in made._jdf.queryExecution().executedPlan().toString()
