import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from rillgrid.operators import dispersion, lines, monitoring, prepare, segments, signal, transfer
from rillgrid.sources import synthetic


def test_the_dispersion_of_the_synthetic_pair_is_recovered(spark):
    """v = 0.8 + 0.55 T within 5 %, and the curve is followed past a louder burst at another time."""
    delta, periods = 0.05, [0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]
    x = np.array([r.x for r in synthetic.dispersive_trace(spark, 4096, delta, 15.0, 0.05, 3.0).orderBy("n").collect()])
    t = np.arange(len(x)) * delta
    burst = 0.02 * np.exp(-((t - 25) ** 2)) * np.cos(2 * np.pi * t / 1.25)
    df = spark.createDataFrame([("clean", x.tolist()), ("burst", (x + burst).tolist()), ("none", None), ("short", [1.0, 2.0])], "pair string, data array<double>")
    got = dispersion.curves(df, ["pair"], "data", F.lit(15.0), delta, periods, alpha=50.0, slow=0.5, fast=5.0, jump=60).collect()
    assert {r.pair for r in got} == {"clean", "burst"} and len(got) == 2 * len(periods)
    for r in got:
        assert abs(r.velocity / (0.8 + 0.55 * r.period) - 1) < 0.05, (r.pair, r.period, r.velocity)
        assert r.far == (15.0 > 3 * r.velocity * r.period)


def test_ridges_equal_an_exhaustive_search(spark):
    r = np.random.default_rng(2)
    for jump in (0, 1, 3):
        rows = r.random((4, 6))
        best, path = -1, None
        for p in np.ndindex(6, 6, 6, 6):
            if max(abs(np.diff(p))) <= jump and (s := sum(rows[i, n] for i, n in enumerate(p))) > best:
                best, path = s, list(p)
        df = spark.createDataFrame([(rows.tolist(),)], "rows array<array<double>>")
        assert dispersion.with_ridge(df, "rows", jump, "r").first().r == path


def test_the_drop_of_a_year_is_found_and_its_season_fitted(spark):
    year = synthetic.year_of_changes(spark, event_day=200, drop=6e-3, recovery=10.0, seasonal=1e-3, noise=1e-4, seed=3).withColumn("g", F.lit("a"))
    year = year.unionByName(spark.createDataFrame([(dt.date(2024, 1, 5), None, "a"), (None, 1.0, "a"), (dt.date(2024, 1, 5), 0.25, "one day")], "day date, dv_v double, g string"))
    got = monitoring.seasonal(year, ["g"], "day", "dv_v", k=4.0, rounds=4).collect()
    days = sorted((r.day - dt.date(2024, 1, 1)).days for r in got if r.event)
    assert 200 in days and all(200 <= d <= 245 for d in days) and len(days) > 15
    assert abs(next(r.amplitude for r in got if r.g == "a") / 1e-3 - 1) < 0.1
    one = [r for r in got if r.g == "one day"]
    assert len(one) == 1 and abs(one[0].residual) < 1e-12 and not one[0].event and len(got) == 366


def test_changes_are_those_of_the_stretch(spark):
    t = np.arange(401) - 200
    ref = np.cos(t / 4.0) * np.exp(-np.abs(t) / 150)
    rows = [("g", d, signal.stretch(ref, -v).tolist()) for d, v in enumerate([0.0] * 40 + [0.01])]
    got = {r.d: r for r in monitoring.changes(spark.createDataFrame(rows, "g string, d int, x array<double>"), "g", "d", "x").collect()}
    assert len(got) == 41 and abs(got[40].dv_v - 0.01) < 1.1e-3 and abs(got[0].dv_v) < 1.1e-3 and got[0].correlation > 0.99


def test_small_systems(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=(5, 5))
    a = a @ a.T + np.eye(5)
    b = r.normal(size=5)
    df = spark.createDataFrame([(np.column_stack([a, b]).tolist(),)], "m array<array<double>>")
    assert np.allclose(df.select(monitoring.solve_small(F.col("m"), 5).alias("x")).first().x, np.linalg.solve(a, b))


def test_factors_are_recovered(spark):
    r = np.random.default_rng(5)
    f, g = r.uniform(0.5, 2, 12), r.uniform(1, 3, 30)
    f = f / np.sqrt((f**2).mean())
    rows = [(k, i, float(f[i] * g[k] + r.normal() * 1e-3)) for k in range(30) for i in range(12) if (k + i) % 7]
    df = spark.createDataFrame([*rows, (None, 1, 2.0), (1, None, 2.0), (2, 2, None)], "pair int, win int, t double")
    made = transfer.rank_one(df, "pair", "win", "t")
    found = [{x[0]: x[1] for x in part.collect()} for part in made]
    assert max(abs(found[0][i] - f[i]) for i in range(12)) < 2e-3 and max(abs(found[1][k] - g[k]) for k in range(30)) < 5e-3
    e = transfer.residuals(spark.createDataFrame(rows, df.schema), "pair", "win", "t", *made).select(F.sqrt(F.avg(F.col("e") ** 2))).first()[0]
    assert e < 2e-3


def test_segments_are_merged_sample_by_sample(spark):
    rows = [("a", t, 1.0, 1) for t in range(0, 10)] + [("a", t, 2.0, 2) for t in range(6, 14)] + [("a", 16, 8.0, 1), ("a", 30, 5.0, 1), ("a", 31, 6.0, 1), ("a", None, 1.0, 1), ("b", 3, None, 1), (None, 3, 1.0, 1)]
    df = spark.createDataFrame(rows, "c string, t long, x double, r int")
    for size in (4, 1000):
        got = {x.t: x for x in segments.merge_samples(df, "c", "t", "x", "r", most_gap=2, bin_size=size).collect()}
        assert sorted(got) == [*range(0, 17), 30, 31]
        assert [got[t].x for t in (5, 6, 13, 14, 15, 16)] == [1.0, 2.0, 2.0, 4.0, 6.0, 8.0]
        assert [got[t].filled for t in (13, 14, 15, 16)] == [False, True, True, False]
        assert [got[t].run for t in (0, 16, 30, 31)] == [1, 1, 2, 2]


def test_a_hot_channel_is_numbered_and_framed_in_parts(spark):
    rows = [("hot", i * 3, float((i * 37) % 11 - 5)) for i in range(500)] + [("b", 5, 2.0), ("b", 4, -4.0), (None, 1, 1.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "c string, o long, x double")
    got = sorted((r.o, r.n) for r in segments.numbered(df, "c", "o").where("c = 'hot'").collect())
    assert [n for _, n in got] == list(range(1, 501)) and len(segments.numbered(df, "c", "o").collect()) == len(rows)
    means = {}
    for size in (8, 4096):
        n = segments.numbered(df, "c", "o")
        out = segments.framed(n, "c", "n", 3, {"m": F.avg(F.abs("x")).over(segments.frame("c", "n", 3))}, bin_size=size).collect()
        means[size] = sorted(((r.c or "", r.o, round(r.m, 9)) for r in out))
    assert means[8] == means[4096] and len(means[8]) == len(rows)
    x = [abs(r[2]) for r in rows[:500]]
    assert all(abs(m - np.mean(x[max(0, o // 3 - 3) : o // 3 + 4])) < 1e-8 for c, o, m in means[8] if c == "hot")


def test_medians_with_far_outliers(spark, monkeypatch):
    """Bins are halved again until few values are left, in however bad a spread."""
    monkeypatch.setattr(signal, "FEW", 10)
    r = np.random.default_rng(6)
    groups = {
        "far": [*r.random(301).tolist(), 1e300], "both": [*r.random(300).tolist(), -1.5e308, 1.5e308], "same": [4.0] * 100, "halves": [1.0] * 50 + [2.0] * 50, "powers": [10.0**k for k in range(-200, 200)], "one": [7.0], "two": [1.0, 4.0],
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), (None, 1.0), ("far", float("nan"))], "g string, v double")
    got = {r.g: r.median for r in signal.exact_median(df, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == float(np.median(vs)), g


def test_the_chain_is_its_steps(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(3, 50)) + np.linspace(0, 4, 50)
    df = spark.createDataFrame([*enumerate(x.tolist()), (9, None), (10, [1.0, 2.0]), (11, [])], "k long, data array<double>")
    got = {(row.k, row.day): row.data for row in prepare.prepared_days(df, "data", 20, 0.05, 0.3, 3).collect()}
    assert set(got) == {(k, d) for k in range(3) for d in range(2)}
    n = np.arange(50)
    for k in range(3):
        y = x[k] - np.polyval(np.polyfit(n, x[k], 1), n)
        f = np.fft.rfftfreq(50)
        y = np.fft.irfft(np.fft.rfft(y) * ((f >= 0.05) & (f <= 0.3)), 50)
        for d in range(2):
            z = y[d * 20 : d * 20 + 20]
            z = np.array([z[i] / np.abs(z[max(0, i - 3) : i + 4]).mean() for i in range(20)])
            assert np.allclose(got[k, d], signal._whiten(z[None, :])[0])
    bits = prepare.prepared_days(df, "data", 20, 0.05, 0.3, 3, normal=prepare.one_bit).count()
    assert bits == 6


def test_neighbours_of_a_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(segments.framed, "__defaults__", (8,))
    rows = [("a", i, "xxy"[i // 3 % 3]) for i in range(60)] + [(None, i, None if i % 4 < 2 else "z") for i in range(9)] + [("", 1, "x")]
    df = spark.createDataFrame(rows, "g string, o long, v string")
    want = sorted((g or "-", o) for i, (g, o, v) in enumerate(rows) if i == 0 or rows[i - 1][0] != g or rows[i - 1][2] != v)
    assert sorted((r.g or "-", r.o) for r in lines.collapse_adjacent(df, "v", "o", "g").collect()) == want
    assert sorted(map(tuple, segments.following(df, "g", "o").collect())) == sorted([(i, i + 1) for i in range(59)] + [(i, i + 1) for i in range(8)])
