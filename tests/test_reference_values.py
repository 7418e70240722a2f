"""Values worked out by hand, and array operators against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import parse
from rillgrid.operators import jobs, lines, scoring, signal
from rillgrid.sources import files
from rillgrid.streaming import follow

STATIONS = "station,latitude,longitude,elevation\nsouth-2,-31.5,18.25,1204\nnorth,64.125,-21.5,12\npeak,27.75,86.5,5364\nsouth-1,-33.0,18.5,12\nbuoy,0.0,-140.0,\nridge,39.5,-105.75,3712\nshelf,-77.75,166.75,38\n"


def test_stations(spark, tmp_path):
    """Equal elevations, one that is missing, and negative numbers."""
    (tmp_path / "stations.csv").write_text(STATIONS)
    df = files.read_records(spark, str(tmp_path / "stations.csv"))
    assert [r.station for r in df.where("latitude > 0.0").orderBy("station").collect()] == ["north", "peak", "ridge"]
    assert [r.station for r in df.orderBy("elevation", "station").collect()] == ["buoy", "north", "south-1", "shelf", "south-2", "ridge", "peak"]
    assert df.count() == 7 and signal.pairs(df.withColumn("g", F.lit(1)), "station", "g").count() == 21
    assert [r.station for r in df.where("elevation > 1000").orderBy("station").collect()] == ["peak", "ridge", "south-2"]
    assert files.list_files(spark, str(tmp_path), "*.csv").count() == 1 and files.read_lines(spark, str(tmp_path)).count() == 8


def test_parsers(spark):
    df = spark.createDataFrame([("2-00:00:00", "10G", "0-999%50", "titan:2", "afterok:17", "CH.GENV..HHZ"), ("00:15:00", "1000", "4-4", "2,VramPerGpu:40G", "singleton", "x"), (None, "bad", "9", "?", "", None)], "t string, m string, a string, g string, d string, s string")
    got = df.select(parse.duration_seconds(F.col("t")).alias("t"), parse.memory_mb(F.col("m")).alias("m"), parse.array_spec(F.col("a")).alias("a"), parse.gpu_spec(F.col("g")).alias("g"), parse.dependency(F.col("d")).alias("d"), parse.trace_id(F.col("s")).alias("s")).collect()
    assert [r.t for r in got] == [172800, 900, None] and [r.m for r in got] == [10240, 1000, None]
    assert [tuple(r.a) if r.a else None for r in got] == [(0, 999, 50), (4, 4, None), None]
    assert [tuple(r.g) if r.g else None for r in got] == [("titan", 2, None), (None, 2, 40960), None]
    assert [tuple(r.d) if r.d else None for r in got] == [("afterok", 17), ("singleton", None), None]
    assert got[0].s.station == "GENV" and got[0].s.component == "Z"
    name = df.limit(1).select(parse.output_name(F.lit("out/%x-%A_%a"), F.lit("job"), F.lit(7), F.lit(3))).first()[0]
    assert name == "out/job-7_3"


def test_array_tasks_and_batches(spark):
    tasks = jobs.fan_out(spark.createDataFrame([("0-999%50",), (None,)], "array_spec string"))
    assert tasks.count() == 1000 and tasks.agg(F.max("wave")).first()[0] == 19
    rows = lines.row_index(spark.range(4000), "id")
    batches = lines.in_batches(rows, "row", 100).groupBy("batch").count().collect()
    assert len(batches) == 40 and {r["count"] for r in batches} == {100}
    legacy = lines.in_batches(rows, "row", 100, legacy=True).groupBy("batch").count().collect()
    assert len(legacy) == 41
    got = jobs.task_parameters(spark.range(3).withColumnRenamed("id", "task_id"), [1.5, 2.0]).orderBy("task_id").collect()
    assert [r.parameter for r in got] == [1.5, 2.0, None]


def test_dependencies(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 1)], "job_id long, depends_on long")
    assert {tuple(r) for r in jobs.levels(nodes, edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 1)}


def test_grading_and_documents(spark):
    bank = spark.createDataFrame([(1, "mc", ["B"], "x"), (2, "fill", ["cut", "awk"], "x"), (3, "tf", ["T"], "y")], "q int, kind string, accepted array<string>, category string")
    said = spark.createDataFrame([("s", 1, " b\n"), ("s", 2, "use CUT -d"), ("s", 3, "f"), ("s2", 1, None)], "student string, q int, answer string")
    graded = scoring.grade(said, bank)
    assert {(r.student, r.q): r.correct for r in graded.collect()} == {("s", 1): True, ("s", 2): True, ("s", 3): False, ("s2", 1): False}
    doc = scoring.result_document(graded, "student").where("student = 's'").first()
    assert doc.score == 2 and doc.percentage == 66.7 and tuple(doc.categories["x"]) == (2, 2) and [a.q for a in doc.answers] == [1, 2, 3]
    bands = spark.createDataFrame([(p,) for p in (100.0, 85.0, 84.9, 70.0, 50.0, 49.9)], "pct double").select(scoring.band(F.col("pct")).alias("b")).collect()
    assert [r.b for r in bands] == ["perfect", "excellent", "good", "good", "fair", "poor"]


def array_of(spark, column, *arrays):
    names = [f"x{i}" for i in range(len(arrays))]
    df = spark.createDataFrame([tuple(a.tolist() for a in arrays)], ", ".join(f"{n} array<double>" for n in names))
    return np.array(df.select(column(*[F.col(n) for n in names]).alias("y")).first().y)


def test_spectra_against_numpy(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=64), r.normal(size=64)
    assert np.allclose(array_of(spark, signal.cross_correlation, x, y), np.correlate(y, x, "full"))
    delayed = np.roll(x, 5)
    assert np.argmax(array_of(spark, signal.deconvolution, x, np.concatenate([np.zeros(5), x[:-5]]))) - 63 == 5
    assert np.argmax(array_of(spark, signal.phase_correlation, x, delayed)) - 63 == 5
    t = np.arange(256)
    assert np.allclose(array_of(spark, signal.envelope, np.cos(2 * np.pi * t * 8 / 256)), 1)
    white = np.abs(np.fft.rfft(array_of(spark, signal.whiten, x)))
    assert white[3:-3].std() / white[3:-3].mean() < np.abs(np.fft.rfft(x))[3:-3].std() / np.abs(np.fft.rfft(x))[3:-3].mean()


def test_time_and_frequency_correlations_agree(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=32), r.normal(size=32)
    df = spark.createDataFrame([(1, x.tolist()), (2, y.tolist())], "id long, d array<double>")
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    got = {c.lag: c.c for c in signal.correlations(df, pair, "id", "d", 4).collect()}
    want = np.correlate(y, x, "full")
    assert all(abs(got[k] - want[31 + k]) < 1e-9 for k in range(-4, 5))


@pytest.mark.parametrize("change", [0.01, -0.02])
def test_stretching_recovers_the_change(spark, change):
    t = np.arange(401) - 200
    wave = lambda s: np.exp(-((np.abs(t) * s - 90) ** 2) / 400) * np.cos(t * s / 4)
    got = array_of(spark, signal.stretching(), wave(1.0), wave(1 + change))
    assert abs(got[0] - change) < 2e-3 and got[1] > 0.98


def test_equal_traces_stack_to_themselves(spark):
    x = np.sin(np.arange(40) / 3)
    df = spark.createDataFrame([(1, x.tolist())] * 3, "g long, d array<double>")
    got = [r.pws for r in signal.phase_weighted_stack(df, ["g"], "d").orderBy("sample").collect()]
    assert np.allclose(got, x)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    part = lambda a, b: spark.createDataFrame([(t0 + dt.timedelta(minutes=i), f"k{i % 3}", i * 0.5) for i in range(a, b)], "ts timestamp, key string, value double")
    part(0, 50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: follow.append_to(follow.follow_table(spark, str(tmp_path / "in"), "ts timestamp, key string, value double"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    part(50, 90).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 90
    stream = follow.windowed(follow.follow_table(spark, str(tmp_path / "in"), "ts timestamp, key string, value double"), "ts", "key", "value", "10 minutes")
    asked = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    asked.awaitTermination(60)
    batch = follow.windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "key", "value", "10 minutes")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
