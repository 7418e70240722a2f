"""Operators without a query of their own, and signal operators on synthetic traces with known answers."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillgrid.functions import parse
from rillgrid.operators import jobs, lines, scoring, signal
from rillgrid.sources import files, steps, synthetic
from rillgrid.streaming import follow


def column(spark, make, *arrays):
    df = spark.createDataFrame([tuple(a.tolist() for a in arrays)], ", ".join(f"x{i} array<double>" for i in range(len(arrays))))
    return np.array(df.select(make(*[F.col(f"x{i}") for i in range(len(arrays))]).alias("y")).first().y)


def test_phase_correlation_is_its_definition(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=64), r.normal(size=64)
    u, v = (np.exp(1j * np.angle(signal._analytic(a[None])[0])) for a in (x, y))
    want = [sum((np.conj(u[n]) * v[n + lag]).real for n in range(64) if 0 <= n + lag < 64) for lag in range(-63, 64)]
    assert np.allclose(column(spark, signal.phase_correlation, x, y), want)
    assert abs(column(spark, signal.phase_correlation, x, x)[63] - 64) < 1e-9


def test_arrays_of_unequal_lengths_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0]), (2, None, [1.0]), (3, [0.0, 1.0, 0.0], [2.0]), (4, [3.0, 4.0], [2.0])], "i int, x array<double>, y array<double>")
    got = {r.i: r.c for r in df.select("i", signal.cross_correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got[2] is None and np.allclose(got[1], [2, 1]) and np.allclose(got[3], [0, 2, 0]) and np.allclose(got[4], [8, 6])


def test_names_of_zero_are_left_out_of_the_leaderboard(spark):
    for kind, rows in (("int", [(1, 5), (0, 9), (None, 7)]), ("string", [("a", 5), ("", 9), (None, 7)])):
        df = spark.createDataFrame([(n, float(p), 1.0, i) for i, (n, p) in enumerate(rows)], f"name {kind}, pct double, time double, i int")
        assert [r.i for r in scoring.leaderboard(df, "i").collect()] == [0]


def test_percentages_are_exact(spark):
    df = spark.createDataFrame([(1, 16), (3, 2000), (2, 3), (0, 0), (1, 8)], "a long, b long")
    assert [r.p for r in df.select(parse.percent(F.col("a"), F.col("b")).alias("p")).collect()] == [6.3, 0.2, 66.7, None, 12.5]


def test_levels_of_long_chains_and_cycles(spark):
    edges = lambda rows: spark.createDataFrame(rows, "job_id long, depends_on long")
    nodes = spark.range(6).withColumnRenamed("id", "job_id")
    assert dict(map(tuple, jobs.levels(nodes, edges([(i, i - 1) for i in range(1, 6)] + [(5, 0)])).collect())) == {i: i for i in range(6)}
    for cycle in ([(i, (i + 1) % 6) for i in range(6)], [(1, 2), (2, 1), (1, 0)]):
        with pytest.raises(ValueError):
            jobs.levels(nodes, edges(cycle))


def test_iteration_resumes_from_the_last_whole_state(spark, tmp_path):
    calls = []

    def step(state, r):
        calls.append(r)
        if r == 5 and calls.count(5) == 1:
            raise RuntimeError("lost")
        return state.withColumn("x", F.col("x") + r)

    start, folder = spark.createDataFrame([(0,)], "x int"), f"file://{tmp_path}/state"
    with pytest.raises(RuntimeError):
        steps.iterate(start, step, 7, folder, every=2)
    assert steps.iterate(start, step, 7, folder, every=2).first().x == 28 and calls == [1, 2, 3, 4, 5, 5, 6, 7]


def test_stored_tables_are_deleted_when_done_with(spark):
    a = steps.stored(spark.range(3), "a")
    b = steps.stored(a.select((F.col("id") + 1).alias("id")), "b", [a])
    assert b.count() == 3 and not steps.exists(spark, a.stored_at) and steps.exists(spark, b.stored_at)


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep" / "er").mkdir(parents=True)
    for name, text in (("b.txt", "one\ntwo"), ("a.txt", "three"), ("deep/c.txt", "two more"), ("deep/er/d.txt", "x")):
        (tmp_path / "in" / name).write_text(text)
    path = str(tmp_path / "in")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.list_files(spark, path, depth=1)) == ["a.txt", "b.txt"] and names(files.list_files(spark, path, depth=2)) == ["a.txt", "b.txt", "c.txt"]
    assert names(files.list_files(spark, path, without="%/deep/%")) == ["a.txt", "b.txt"] and files.list_files(spark, path, modified_after="2999-01-01T00:00:00").count() == 0
    assert [r.path.rsplit("/", 1)[1] for r in files.numbered_files(spark, path).orderBy("row").collect()] == ["a.txt", "b.txt", "c.txt", "d.txt"]
    assert tuple(files.used_bytes(files.list_files(spark, path)).first()) == (4, 21)
    assert sorted(r.value for r in files.search_files(spark, path, "^two").collect()) == ["two", "two more"]
    (tmp_path / "p.yaml").write_text("delta: 0.5\n# comment\nmax_lag: 100  # s\n")
    assert files.Parameters.read(spark, str(tmp_path / "p.yaml")) == files.Parameters(delta=0.5, max_lag=100.0)
    (tmp_path / "q.yaml").write_text("detla: 0.5\n")
    with pytest.raises(ValueError):
        files.Parameters.read(spark, str(tmp_path / "q.yaml"))


def test_sinks_and_bodies(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.5), (1, "a", 2.5), (3, "c", 0.5)], "id int, name string, pct double")
    out = str(tmp_path / "t")
    files.write_table(df, out, parts=["name"])
    files.write_table(df.where("id = 1"), out, append=True, parts=["name"])
    assert spark.read.parquet(out).count() == 4 and (tmp_path / "t" / "name=a").is_dir()
    files.write_table(df.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    assert files.append_result(df, str(tmp_path / "r")) == files.append_result(df, str(tmp_path / "r")) == {"status": "ok"}
    assert spark.read.parquet(str(tmp_path / "r")).where("date IS NOT NULL").count() == 6
    assert [r["id"] for r in json.loads(files.ordered_json(df, [F.desc("pct")]).first().body)] == [1, 2, 3] and len(json.loads(files.ordered_json(df, [F.desc("pct")], 2).first().body)) == 2
    files.write_ordered(df, [F.desc("pct")], str(tmp_path / "o"))
    assert [json.loads(x)["id"] for p in sorted((tmp_path / "o").glob("*.json")) for x in p.read_text().splitlines()] == [1, 2, 3]
    files.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 3
    files.write_texts(df.withColumn("text", jobs.config_text({"ID": F.col("id")})), str(tmp_path / "c"), "text", ["id"])
    assert next((tmp_path / "c" / "id=2").glob("*.txt")).read_text().startswith("ID 2\n")
    bodies = spark.createDataFrame([('{"name": "x", "pct": 3}',), ("bad",)], "body string")
    assert [tuple(r) for r in files.parse_requests(bodies, "body", "name string, pct double").collect()] == [("x", 3.0), (None, None)]
    assert sorted(r.stream for r in files.tagged(df, df.limit(1)).collect()) == ["err", "out", "out", "out"]


def test_job_predicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 4), (3, 1), (2, 2)], "t int, c int")
    assert [r.k for r in df.select(jobs.parallelism(F.col("t"), F.col("c")).alias("k")).collect()] == ["single", "threaded", "mpi", "hybrid"]
    assert df.limit(1).select(jobs.violations({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}).alias("v")).first().v == ["b", "c"]
    runs = spark.createDataFrame([("x", 10, 2.0), ("x", 1000, 3.0)], "job string, files int, used double")
    assert abs(jobs.extrapolated(runs, ["job"], "files", "used", 100).first().estimate - 2.5) < 1e-9


def test_field_order_and_difference(spark):
    df = spark.createDataFrame([("  a  b\tc ",), ("x",), (None,)], "v string")
    assert [tuple(r) for r in df.select(*lines.fields(F.col("v"), 1, 3)).collect()] == [("a", "c"), ("x", None), (None, None)]
    assert [tuple(r) for r in df.select(*lines.split_fields(F.lit("a,b,c,d"), ",", 3)).limit(1).collect()] == [("a", "b", "c,d")]
    a, b = (spark.createDataFrame([(x,) for x in t], "v string") for t in ("aab", "abc"))
    assert sorted(map(tuple, lines.bag_difference(a, b).collect())) == [("a", "<"), ("c", ">")]


def test_a_late_row_falls_behind_the_watermark(spark, tmp_path):
    schema, t0 = "ts timestamp, key string, value double", dt.datetime(2024, 1, 1)
    put = lambda *minutes: spark.createDataFrame([(t0 + dt.timedelta(minutes=m), "k", 1.0) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0, 1)
    stream = follow.windowed(follow.follow_table(spark, str(tmp_path / "in"), schema), "ts", "key", "value", "10 minutes", late="20 minutes")

    def run():
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted((r.start.minute + 60 * r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    run()
    put(100)
    run()
    put(5, 101)
    put(200)
    assert run() == [(0, 2), (100, 2)]


def test_a_log_is_followed(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("a\nb\n")
    query = lambda: follow.append_to(follow.follow_lines(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    query()
    (tmp_path / "log" / "2.txt").write_text("c\n")
    query()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_the_delay_of_a_wavelet_is_found(spark):
    pair = synthetic.ricker_pair(spark, 256, 0.05, 1.5, 4.0, 1.2).orderBy("n").collect()
    lag = column(spark, signal.pick_lag, np.array([r.a for r in pair]), np.array([r.b for r in pair]))[0]
    assert lag == round(1.2 / 0.05)


def stacked(spark, geometry):
    noise = synthetic.noise_pair(synthetic.ring_of_sources(spark, 400, geometry, 5), 256, 0.1, 6.0, 2.0, 9)
    ccs = noise.select("source_id", F.posexplode(signal.cross_correlation(F.col("a"), F.col("b"))).alias("i", "c"))
    return np.array([r.c for r in ccs.groupBy("i").agg(F.avg("c").alias("c")).orderBy("i").collect()])


def test_noise_gives_the_travel_time(spark):
    """Sources all around give both peaks at 3 s, those on one side one of them, and those across none."""
    around, one, across = (stacked(spark, g) for g in ("all", "one_side", "across"))
    at, mid = round(6.0 / 2.0 / 0.1), 255
    near = lambda c, side: np.abs(c[mid + side * at - 3 : mid + side * at + 4]).max() / np.abs(c).max()
    assert near(around, 1) > 0.3 and near(around, -1) > 0.3
    assert max(near(one, 1), near(one, -1)) > 0.9 and min(near(one, 1), near(one, -1)) < 0.3
    assert max(near(across, 1), near(across, -1)) < 0.3


def test_group_velocities_of_a_dispersive_trace(spark):
    delta, distance = 0.05, 15.0
    x = np.array([r.x for r in synthetic.dispersive_trace(spark, 2048, delta, distance, 0.1, 2.5).orderBy("n").collect()])
    for period in (1.0, 2.0, 3.0):
        band = column(spark, signal.gaussian_filter(delta / period, 50.0), x)
        at = np.argmax(column(spark, signal.envelope, band)) * delta
        v = spark.range(1).select(signal.velocity(F.lit(distance), F.lit(float(at))).alias("v"), synthetic.group_velocity(F.lit(period)).alias("true")).first()
        assert abs(v.v - v.true) < 0.12 * v.true


def test_travel_times_through_the_grid_and_back(spark):
    grid = synthetic.velocity_grid(spark, 12, 12)
    assert grid.agg(F.min("velocity")).first()[0] < 2.4 and grid.agg(F.max("velocity")).first()[0] > 3.4
    rays = spark.range(60).select(F.col("id").alias("ray_id"), (F.rand(1) * 12).alias("x0"), (F.rand(2) * 12).alias("y0"), (F.rand(3) * 12).alias("x1"), (F.rand(4) * 12).alias("y1"))
    cells = signal.ray_cells(rays, 1.0, 64).withColumn("cell_id", F.col("iy") * 12 + F.col("ix"))
    whole = rays.withColumn("d", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)).join(cells.groupBy("ray_id").agg(F.sum("length").alias("l")), "ray_id")
    assert whole.where("abs(d - l) > 1e-9").count() == 0
    times = signal.travel_times(cells, grid)
    length = cells.groupBy("ray_id").agg(F.sum("length").alias("l"))
    assert times.join(length, "ray_id").where("t < l / 3.9 OR t > l / 2.1").count() == 0


def test_damped_rounds_approach_the_solution(spark):
    r = np.random.default_rng(2)
    g = r.random((30, 6)) * (r.random((30, 6)) < 0.6) + 0.1
    t = g @ np.array([0.3, 0.5, 0.4, 0.2, 0.6, 0.1])
    incidence = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(30) for j in range(6)], "ray_id long, cell_id long, length double")
    times = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "ray_id long, t double")
    rough = np.diff(np.eye(6), axis=0)
    want = np.linalg.solve(g.T @ g + 2.0 * np.eye(6) + 1.0 * rough.T @ rough, g.T @ t)
    off = [np.abs(np.array([x.slowness for x in signal.damped_steps(incidence, times, 2.0, 1.0, n).orderBy("cell_id").collect()]) - want).max() for n in (1, 5)]
    assert off[1] < off[0] and off[1] < 0.2


def test_an_event_stands_out_of_a_year(spark):
    year = synthetic.year_of_changes(spark, 200, 5e-3, recovery=5.0).withColumn("g", F.lit("x"))
    found = signal.events_above(year, "g", "day", "dv_v", 10, 5.0).where("event").collect()
    first = dt.date(2024, 1, 1) + dt.timedelta(days=200)
    assert found and min(abs((r.day - first).days) for r in found) == 0 and all(abs((r.day - first).days) < 12 for r in found)


def test_the_resonance_of_three_components(spark):
    delta, f0 = 0.02, 3.0
    spectra = synthetic.three_components(spark, 1024, delta, f0, 6.0).select(F.lit(1).alias("station"), "c", signal.amplitudes(F.col("data")).alias("a"))
    hv = signal.horizontal_over_vertical(spectra).withColumn("f", F.col("k") / (1024 * delta))
    peak = signal.pick_max(hv.where("k > 2"), ["station"], "f", F.col("hv")).select("f", "amplitude", signal.clear_peak(F.col("f"), F.col("amplitude"), F.lit(600.0), F.lit(30.0)).alias("clear"), signal.thickness(F.lit(300.0), F.col("f")).alias("h")).first()
    assert abs(peak.f - f0) < 0.1 and peak.clear and abs(peak.h - 25.0) < 1


def test_bessel_values_and_bands(spark):
    xs = [0.0, 1.0, 2.404825557695773, 10.0, 40.0]
    want = [1.0, 0.7651976865579666, 0.0, -0.2459357644513483, 0.007366890]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(signal.bessel_j0(F.col("x")).alias("y")).collect()]
    assert np.allclose(got, want, atol=1e-8)
    t = np.arange(128)
    both = np.cos(2 * math.pi * t * 8 / 128) + np.cos(2 * math.pi * t * 32 / 128)
    assert np.allclose(column(spark, signal.bandpass(0.05, 0.1), both), np.cos(2 * math.pi * t * 8 / 128))


def test_snr_grows_with_the_stack(spark):
    r = np.random.default_rng(4)
    signal_ = np.concatenate([np.hanning(16), np.zeros(48)])
    df = spark.createDataFrame([(1, i, (signal_ + r.normal(size=64)).tolist()) for i in range(200)], "g int, w int, data array<double>")
    rows = signal.cumulative_stack(signal.samples(df, ["g", "w"], "data").withColumnRenamed("w", "o"), ["g"], "o")
    ratio = signal.snr(rows, ["g", "o", "w"], "stack", 16, 32)
    assert abs(signal.growth(ratio.where("w > 20"), ["g"], "w", "snr").first().power - 0.5) < 0.2
    robust = signal.robust_stack(signal.samples(df, ["g"], "data"), ["g", "n"], "x", 2)
    assert robust.count() == 64 and robust.where("n = 8").first().stack > 0.5


def test_medians_are_exact(spark):
    r = np.random.default_rng(7)
    groups = {"a": r.normal(size=101), "b": r.normal(size=100) ** 5, "c": np.array([2.0]), "d": np.array([1.0] * 50 + [9.0]), "e": np.array([1.0, 4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    for bins in (1, 3, 1024):
        got = dict(map(tuple, signal.exact_median(df, ["k"], "v", bins).collect()))
        assert all(abs(got[k] - np.median(v)) < 1e-12 for k, v in groups.items()) and got.keys() == groups.keys()


def test_running_scores_do_not_depend_on_the_bins(spark):
    df = spark.createDataFrame([(i % 3, i, i % 2 == 0) for i in range(50)], "who int, q int, ok boolean")
    w = Window.partitionBy("who").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(tuple, df.withColumn("score", F.sum(F.col("ok").cast("int")).over(w)).withColumn("total", F.count(F.lit(1)).over(w)).collect()))
    for bins in (1, 7, 200):
        assert sorted(map(tuple, scoring.running_score(df, "who", "q", F.col("ok"), bins).select("who", "q", "ok", "score", "total").collect())) == want


def test_the_question_bank_is_graded(spark):
    from rillgrid.sources.bank import question_bank

    bank = question_bank(spark)
    assert dict(map(tuple, bank.groupBy("kind").count().collect())) == {"mc": 28, "fill": 7, "tf": 4}
    asked = bank.select(F.explode(F.array(F.lit("right"), F.lit("none"))).alias("student"), "q", "accepted")
    answers = asked.select("student", "q", F.when(F.col("student") == "right", F.concat(F.lit(" "), F.lower(F.get("accepted", F.lit(0))), F.lit("\n"))).alias("answer"))
    scores = scoring.summary(scoring.grade(answers, bank), "student", F.col("correct")).collect()
    assert {r.student: (r.correct, r.total, r.band) for r in scores} == {"right": (39, 39, "perfect"), "none": (0, 39, "poor")}
