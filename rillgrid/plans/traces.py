"""Queries on traces: embeddings are traces of 64 samples, events are sampled channels, line items are picks and rays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import pairs, segments, signal
from .registry import query, read

S = "s AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings)"
#: Spectra by the definition: X(k) = sum of x(n) e^(-2 pi i k n / 64).
DFT = f"{S}, f AS (SELECT vec_id, any_value(label) AS label, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, -sum(x * sin(2 * pi() * k * n / 64)) AS im FROM s, range(0, 33) AS r(k) GROUP BY vec_id, k)"
#: And back: the trace and its quadrature from (re, im) of k = 0 to 32.
BACK = "sum(CASE WHEN k IN (0, 32) THEN re * cos(2 * pi() * k * n / 64) ELSE 2 * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)) END) / 64"
QUADRATURE = "sum(CASE WHEN k IN (0, 32) THEN 0 ELSE 2 * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64)) END) / 64"
NEXT = "p AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


def _traces(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("data"))


def _rows(df, *columns):
    """One row a sample of arrays of equal length."""
    zipped = df.select(*[c for c in df.columns if c not in columns], F.posexplode(F.arrays_zip(*columns)).alias("n", "_z"))
    return zipped.select(*[c for c in zipped.columns if c != "_z"], *[F.col("_z")[c].alias(c) for c in columns])


def _next(traces):
    return segments.following(traces, "label", "vec_id")


def _both(traces, pairs):
    one = lambda key, name: traces.select(F.col("vec_id").alias(key), F.col("data").alias(name))
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b")


def _rounded(c, digits):
    """c to so many digits, halves away from zero, in plain arithmetic: round() makes a decimal of each value, which costs more than the
    correlation of two short traces. Very large values and nan go by round()."""
    by = float(10**digits)
    return F.when(F.abs(c) < 1e9, F.signum(c) * F.floor(F.abs(c) * by + 0.5) / by).otherwise(F.round(c, digits)) + 0.0


def _round(df, digits, *columns):
    """Rounded, and without a negative zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query(f"WITH {DFT} SELECT vec_id, k, round(sqrt(re * re + im * im), 6) + 0 AS amplitude FROM f")
def amplitude_spectra(spark, d):
    return _round(_traces(spark, d).select("vec_id", F.posexplode(signal.amplitudes(F.col("data"))).alias("k", "amplitude")).withColumn("k", F.col("k").cast("long")), 6, "amplitude")


@query(f"WITH {DFT} SELECT label, k, round(avg((re * re + im * im) / 64), 6) + 0 AS psd FROM f GROUP BY label, k")
def psd_mean(spark, d):
    """Power spectra, averaged by group."""
    psd = _traces(spark, d).select("label", F.posexplode(signal.power(F.col("data"))).alias("k", "p"))
    return _round(psd.groupBy("label", F.col("k").cast("long").alias("k")).agg(F.avg("p").alias("psd")), 6, "psd")


@query(f"WITH {DFT}, g AS (SELECT * FROM f WHERE k / 64.0 BETWEEN 0.1 AND 0.3) SELECT vec_id, CAST(n AS INTEGER) AS n, round({BACK}, 6) + 0 AS x FROM g, range(0, 64) AS r(n) GROUP BY vec_id, n")
def bandpass_traces(spark, d):
    return _round(_rows(_traces(spark, d).select("vec_id", signal.bandpass(0.1, 0.3)(F.col("data")).alias("x")), "x"), 6, "x")


@query(f"WITH {DFT}, g AS (SELECT vec_id, k, re * w AS re, im * w AS im FROM (SELECT *, exp(-20 * ((k / 64.0 - 0.2) / 0.2) ^ 2) AS w FROM f)), t AS (SELECT vec_id, n, {BACK} AS x, {QUADRATURE} AS h FROM g, range(0, 64) AS r(n) GROUP BY vec_id, n) SELECT vec_id, arg_max(CAST(n AS INTEGER), e) AS n, round(max(e), 6) AS amplitude, CASE WHEN arg_max(n, e) > 0 THEN round(15.0 / (arg_max(n, e) * 0.5), 6) END AS velocity FROM (SELECT vec_id, n, sqrt(x * x + h * h) AS e FROM t) GROUP BY vec_id")
def group_velocity(spark, d):
    """A narrow band's envelope, its largest value, and the velocity of its arrival over 15 km at two samples a second."""
    bands = _rows(_traces(spark, d).select("vec_id", signal.envelope(signal.gaussian_filter(0.2, 20.0)(F.col("data"))).alias("e")), "e")
    picks = signal.pick_max(bands, ["vec_id"], "n", F.col("e"))
    return picks.select("vec_id", "n", F.round("amplitude", 6).alias("amplitude"), F.round(signal.velocity(F.lit(15.0), F.col("n") * 0.5), 6).alias("velocity"))


WHITE = f"""{DFT}, a AS (SELECT *, sqrt(re * re + im * im) AS a FROM f), m AS (SELECT x.vec_id, x.k, sum(y.a) / 5 AS m FROM a x, range(-2, 3) AS o(j), a y WHERE y.vec_id = x.vec_id AND y.k = greatest(0, least(32, x.k + j)) GROUP BY x.vec_id, x.k),
w AS (SELECT a.vec_id, a.k, CASE WHEN m > 1e-12 THEN re / m ELSE 0 END AS re, CASE WHEN m > 1e-12 THEN im / m ELSE 0 END AS im FROM a JOIN m ON m.vec_id = a.vec_id AND m.k = a.k),
t AS (SELECT vec_id, n, {BACK} AS white, {QUADRATURE} AS h FROM w, range(0, 64) AS r(n) GROUP BY vec_id, n)"""


@query(f"WITH {WHITE} SELECT vec_id, CAST(n AS INTEGER) AS n, round(white, 6) + 0 AS white, round(sqrt(white * white + h * h), 6) + 0 AS envelope FROM t")
def whitened_envelopes(spark, d):
    """Spectral whitening and envelope of every trace."""
    white = _traces(spark, d).select("vec_id", signal.whiten(F.col("data")).alias("white"))
    return _round(_rows(white.withColumn("envelope", signal.envelope(F.col("white"))), "white", "envelope"), 6, "white", "envelope")


PHASES = f"z AS (SELECT vec_id, any_value(label) AS label, n, {BACK} AS x, {QUADRATURE} AS h FROM f, range(0, 64) AS r(n) GROUP BY vec_id, n)"


@query(f"WITH {DFT}, {PHASES} SELECT label, CAST(n AS BIGINT) AS sample, round(avg(x) * (avg(x / sqrt(x * x + h * h)) ^ 2 + avg(h / sqrt(x * x + h * h)) ^ 2), 6) + 0 AS pws FROM z GROUP BY label, n")
def pws(spark, d):
    """Phase-weighted stack of each group's traces."""
    out = signal.phase_weighted_stack(_traces(spark, d), ["label"], "data")
    return _round(out.withColumn("sample", F.col("sample").cast("long")), 6, "pws")


@query(f"WITH {DFT}, {PHASES}, {NEXT}, u AS (SELECT vec_id, n, x / sqrt(x * x + h * h) AS c, h / sqrt(x * x + h * h) AS s FROM z) SELECT a, b, CAST(v.n - u.n AS INTEGER) AS lag, round(sum(u.c * v.c + u.s * v.s), 6) + 0 AS c FROM p JOIN u ON u.vec_id = a JOIN u AS v ON v.vec_id = b GROUP BY a, b, v.n - u.n")
def phase_correlations(spark, d):
    traces = _traces(spark, d)
    ccs = _both(traces, _next(traces)).select("a", "b", signal.phase_correlation(F.col("x"), F.col("y")).alias("c"))
    return _round(_rows(ccs, "c").select("a", "b", (F.col("n") - 63).alias("lag"), "c"), 6, "c")


@query(f"""WITH {S}, {NEXT}, f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * n / 127)) AS re, -sum(x * sin(2 * pi() * k * n / 127)) AS im FROM s, range(0, 64) AS r(k) GROUP BY vec_id, k),
g AS (SELECT p.a, p.b, u.k, u.re * v.re + u.im * v.im AS re, u.re * v.im - u.im * v.re AS im, sqrt(u.re ^ 2 + u.im ^ 2) * sqrt(v.re ^ 2 + v.im ^ 2) AS ab, u.re ^ 2 + u.im ^ 2 AS aa FROM p JOIN f u ON u.vec_id = p.a JOIN f v ON v.vec_id = p.b AND v.k = u.k),
w AS (SELECT *, CASE WHEN ab > 1e-6 * max(ab) OVER m THEN 1 / ab ELSE 0 END AS wc, CASE WHEN aa > 1e-6 * max(aa) OVER m THEN 1 / aa ELSE 0 END AS wd FROM g WINDOW m AS (PARTITION BY a, b)),
e AS (SELECT a, b, lag, CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * lag / 127) - im * sin(2 * pi() * k * lag / 127)) / 127 AS t, wc, wd FROM w, range(-63, 64) AS r(lag))
SELECT a, b, CAST(lag AS INTEGER) AS lag, round(sum(t), 6) + 0 AS cc, round(sum(t * wc), 6) + 0 AS coherency, round(sum(t * wd), 5) + 0 AS deconvolution FROM e GROUP BY a, b, lag""")
def spectral_correlations(spark, d):
    """Cross-correlation, coherency and deconvolution at all lags of each trace with the next of its group."""
    traces, x, y = _traces(spark, d), F.col("x"), F.col("y")
    ccs = _both(traces, _next(traces)).select("a", "b", signal.cross_correlation(x, y).alias("cc"), signal.coherency(x, y).alias("coherency"), signal.deconvolution(x, y).alias("deconvolution"))
    out = _rows(ccs, "cc", "coherency", "deconvolution").withColumn("lag", F.col("n") - 63).drop("n")
    return _round(_round(out, 6, "cc", "coherency"), 5, "deconvolution")


@query(f"""WITH {S}, {NEXT}, e AS (SELECT i, -0.05::DOUBLE + i * 0.001::DOUBLE AS eps FROM range(0, 101) AS r(i)), g AS (SELECT i, eps, n, greatest(0, least(62, floor(t))) AS low, t FROM (SELECT *, (n - 31.5) * (1 - eps) + 31.5 AS t FROM e, range(0, 64) AS r(n))),
c AS (SELECT p.a, p.b, g.i, any_value(eps) AS eps, sum((u.x * (1 - q) + v.x * q) * y.x) / sqrt(sum((u.x * (1 - q) + v.x * q) ^ 2)) / sqrt(sum(y.x ^ 2)) AS c
FROM p JOIN (SELECT *, greatest(0, least(1, t - low)) AS q FROM g) g ON true JOIN s u ON u.vec_id = p.a AND u.n = g.low JOIN s v ON v.vec_id = p.a AND v.n = g.low + 1 JOIN s y ON y.vec_id = p.b AND y.n = g.n WHERE p.b IS NOT NULL GROUP BY p.a, p.b, g.i)
SELECT a, b, round(-arg_max(eps, c), 4) + 0 AS dv_v, round(max(c), 6) AS correlation FROM c GROUP BY a, b""")
def velocity_changes(spark, d):
    """The stretch of each trace that is most like the next of its group."""
    traces = _traces(spark, d)
    best = _both(traces, _next(traces)).select("a", "b", signal.stretching()(F.col("x"), F.col("y")).alias("s"))
    return best.select("a", "b", (F.round(F.col("s")[0], 4) + 0.0).alias("dv_v"), F.round(F.col("s")[1], 6).alias("correlation"))


@query(f"WITH {S}, c AS (SELECT x.vec_id AS a, y.vec_id AS b, y.n - x.n AS lag, sum(x.x * y.x) AS c FROM s x JOIN s y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY ALL) SELECT a, b, CAST(arg_max(lag, c) AS INTEGER) AS lag, round(max(c), 6) AS amplitude FROM c GROUP BY a, b")
def all_pairs_pick(spark, d):
    """All N(N-1)/2 pairs of each group at all lags, by tiles: the lag of the largest correlation."""
    picks = pairs.tiled(read(spark, d, "embeddings"), "vec_id", "label", "embedding", pairs.picks)
    return picks.select("a", "b", F.col("values")[0].cast("int").alias("lag"), _rounded(F.col("values")[1], 6).alias("amplitude"))


@query(f"WITH {S} SELECT x.vec_id, CAST(y.n - x.n AS INTEGER) AS lag, round(sum(x.x * y.x), 6) + 0 AS c FROM s x JOIN s y ON x.vec_id = y.vec_id AND y.n >= x.n GROUP BY ALL")
def autocorrelation(spark, d):
    """Each trace with itself, at lags from 0 on."""
    c = F.slice(signal.cross_correlation(F.col("data"), F.col("data")), 64, 64)
    return _round(_rows(_traces(spark, d).select("vec_id", c.alias("c")), "c").withColumnRenamed("n", "lag"), 6, "c")


@query(f"WITH {S}, {NEXT}, c AS (SELECT a, b, y.n - x.n AS lag, sum(x.x * y.x) AS c FROM p JOIN s x ON x.vec_id = a JOIN s y ON y.vec_id = b GROUP BY ALL) SELECT a, b, round(avg(c) FILTER (lag > 0), 6) + 0 AS causal, round(avg(c) FILTER (lag < 0), 6) + 0 AS acausal, round(max(c) FILTER (lag = 0), 6) + 0 AS zero FROM c GROUP BY a, b")
def causal_parts(spark, d):
    """The two sides of each correlation."""
    traces = _traces(spark, d)
    ccs = _rows(_both(traces, _next(traces)).select("a", "b", signal.cross_correlation(F.col("x"), F.col("y")).alias("c")), "c").withColumn("lag", F.col("n") - 63)
    side = lambda which, name: F.avg(F.when(which, F.col("c"))).alias(name)
    return _round(ccs.groupBy("a", "b").agg(side(F.col("lag") > 0, "causal"), side(F.col("lag") < 0, "acausal"), side(F.col("lag") == 0, "zero")), 6, "causal", "acausal", "zero")


@query(f"WITH {S}, {NEXT}, w AS (SELECT a, b, x.n // 16 AS win, sum(x.x * y.x) AS c, sqrt(avg(x.x * x.x)) AS rx, sqrt(avg(y.x * y.x)) AS ry FROM p JOIN s x ON x.vec_id = a JOIN s y ON y.vec_id = b AND y.n = x.n GROUP BY ALL) SELECT a, b, count(*) FILTER (greatest(rx, ry) <= 1.5 * least(rx, ry)) AS kept, round(avg(c) FILTER (greatest(rx, ry) <= 1.5 * least(rx, ry)), 6) + 0 AS c FROM w GROUP BY a, b")
def windowed_correlations(spark, d):
    """Correlations of windows of 16 samples at lag 0; a window in which one side is far louder is rejected, the others are stacked."""
    traces = _traces(spark, d)
    rows = _rows(_both(traces, _next(traces)), "x", "y")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    windows = rows.groupBy("a", "b", F.floor(F.col("n") / 16).alias("win")).agg(F.sum(F.col("x") * F.col("y")).alias("c"), rms("x").alias("rx"), rms("y").alias("ry"))
    good = F.greatest("rx", "ry") <= 1.5 * F.least("rx", "ry")
    return _round(windows.groupBy("a", "b").agg(F.count_if(good).alias("kept"), F.avg(F.when(good, F.col("c"))).alias("c")), 6, "c")


@query(f"WITH {S}, r AS (SELECT label, n, avg(x) AS r FROM s GROUP BY label, n) SELECT vec_id, round(sum(x * r) / sqrt(sum(x * x)) / sqrt(sum(r * r)), 6) + 0 AS c FROM s JOIN r USING (label, n) GROUP BY vec_id")
def reference_correlations(spark, d):
    """Each trace with its group's reference, the mean of all."""
    rows = signal.samples(_traces(spark, d), ["vec_id", "label"], "data")
    reference = rows.groupBy("label", "n").agg(F.avg("x").alias("r"))
    of = rows.join(reference, ["label", "n"]).groupBy("vec_id").agg((F.sum(F.col("x") * F.col("r")) / F.sqrt(F.sum(F.col("x") ** 2)) / F.sqrt(F.sum(F.col("r") ** 2))).alias("c"))
    return _round(of, 6, "c")


@query(f"WITH {S}, {NEXT}, c AS (SELECT a, b, y.n - x.n AS lag, sum(x.x * y.x) AS c FROM p JOIN s x ON x.vec_id = a JOIN s y ON y.vec_id = b AND abs(y.n - x.n) <= 8 GROUP BY ALL) SELECT f.a, f.b AS shared, g.b, round(sum(f.c * g.c), 6) + 0 AS c3 FROM c f JOIN c g ON g.a = f.b AND g.lag = f.lag GROUP BY ALL")
def correlations_of_correlations(spark, d):
    """Two correlations that share a trace, correlated in turn over lags up to 8."""
    traces = _traces(spark, d)
    ccs = signal.correlations(traces, _next(traces), "vec_id", "data", 8)
    return _round(signal.correlated_again(ccs), 6, "c3")


@query(f"WITH {S}, c AS (SELECT label, vec_id, n, count(*) OVER w AS w, avg(x) OVER w AS c FROM s WINDOW w AS (PARTITION BY label, n ORDER BY vec_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT label, vec_id, any_value(w) AS w, max(abs(c)) FILTER (n < 16) / nullif(sqrt(avg(c * c) FILTER (n >= 32)), 0) AS snr FROM c GROUP BY label, vec_id) SELECT label, count(*) AS windows, round(regr_slope(ln(snr), ln(w)), 6) + 0 AS power, round(arg_max(snr, w), 6) AS snr FROM q GROUP BY label")
def snr_convergence(spark, d):
    """How the signal-to-noise ratio of a growing stack grows with the number of its windows."""
    rows = signal.cumulative_stack(signal.samples(_traces(spark, d), ["vec_id", "label"], "data"), ["label"], "vec_id")
    ratio = signal.snr(rows, ["label", "vec_id", "w"], "stack", 16, 32)
    last = ratio.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.max_by("snr", "w").alias("snr"))
    return last.join(signal.growth(ratio, ["label"], "w", "snr"), "label").select("label", "windows", (F.round("power", 6) + 0.0).alias("power"), F.round("snr", 6).alias("snr"))


@query(f"""WITH {S}, r AS (SELECT label, n, x FROM s), m0 AS (SELECT label, n, median(x) AS k FROM r GROUP BY ALL), m1 AS (SELECT label, n, sum(x / greatest(abs(x - k), 1e-6)) / sum(1 / greatest(abs(x - k), 1e-6)) AS k FROM r JOIN m0 USING (label, n) GROUP BY ALL),
m2 AS (SELECT label, n, sum(x / greatest(abs(x - k), 1e-6)) / sum(1 / greatest(abs(x - k), 1e-6)) AS k FROM r JOIN m1 USING (label, n) GROUP BY ALL) SELECT label, CAST(n AS INTEGER) AS n, round(k, 5) + 0 AS stack FROM m2""")
def robust_stacks(spark, d):
    rows = signal.samples(_traces(spark, d), ["label"], "data")
    return _round(signal.robust_stack(rows, ["label", "n"], "x", rounds=2), 5, "stack")


@query("SELECT w AS window, round(f, 6) + 0 AS f, round(avg((t - f * g) ^ 2), 4) + 0 AS e2 FROM (SELECT l_linenumber AS w, l_quantity AS t, l_extendedprice / 1000 AS g FROM lineitem) JOIN (SELECT l_linenumber AS w, sum(l_quantity * (l_extendedprice / 1000)) / sum((l_extendedprice / 1000) ^ 2) AS f FROM lineitem GROUP BY 1) USING (w) GROUP BY w, f")
def transfer_residuals(spark, d):
    """What a common factor a window leaves of the transfer coefficients of all pairs."""
    values = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("window"), F.col("l_quantity").alias("t"), (F.col("l_extendedprice") / 1000).alias("g"))
    return _round(_round(signal.transfer_residuals(values, "pair", "window", "t", "g"), 6, "f"), 4, "e2")


@query("WITH r AS (SELECT l_suppkey, l_quantity AS distance, l_extendedprice / 20000 AS v, 1.0 + l_discount * 10 AS period, l_tax * 200 AS snr, quarter(l_shipdate) AS q FROM lineitem), s AS (SELECT l_suppkey, max(m) - min(m) AS spread FROM (SELECT l_suppkey, q, avg(v) AS m FROM r GROUP BY ALL) GROUP BY 1) SELECT l_suppkey, count(*) AS picks, CAST(count(*) FILTER (distance > 3 * v * period AND snr > 7 AND spread <= 0.5) AS BIGINT) AS kept FROM r JOIN s USING (l_suppkey) GROUP BY 1")
def selection(spark, d):
    """Picks that are three wavelengths apart, clear, and the same in all seasons."""
    picks = read(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("distance"), (F.col("l_extendedprice") / 20000).alias("v"), (1.0 + F.col("l_discount") * 10).alias("period"), (F.col("l_tax") * 200).alias("snr"), F.quarter("l_shipdate").alias("season"))
    met = picks.join(signal.seasonal_spread(picks, ["l_suppkey"], F.col("season"), "v"), "l_suppkey")
    good = signal.selected(F.col("distance"), F.col("v"), F.col("period"), F.col("snr"), F.col("spread"), 7.0, 0.5)
    return met.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("picks"), F.count_if(good).alias("kept"))


DAILY = "SELECT date_trunc('day', ts)::DATE AS day, event_type, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS m FROM events GROUP BY 1, 2"


@query(f"SELECT day, event_type, round(r, 6) + 0 AS residual, coalesce(abs(r) > 1.5 * stddev_samp(r) OVER (PARTITION BY event_type), false) AS event FROM (SELECT day, event_type, m - avg(m) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 5 DAY FOLLOWING) AS r FROM ({DAILY}))")
def dvv_events(spark, d):
    """Days that stand out from the days around them."""
    daily = read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(parse.exact_mean(F.col("value")).alias("m"))
    out = signal.events_above(daily, "event_type", "day", "m", 5, 1.5)
    return out.select("day", "event_type", (F.round("residual", 6) + 0.0).alias("residual"), F.coalesce("event", F.lit(False)).alias("event"))


HV = f"{DFT}, a AS (SELECT vec_id // 3 AS station, vec_id % 3 AS c, k, sqrt(re * re + im * im) AS a FROM f), hv AS (SELECT z.station, z.k, sqrt((n.a ^ 2 + e.a ^ 2) / 2) / z.a AS hv FROM a z JOIN a n ON n.station = z.station AND n.k = z.k AND n.c = 1 JOIN a e ON e.station = z.station AND e.k = z.k AND e.c = 2 WHERE z.c = 0 AND z.k BETWEEN 1 AND 31)"


@query(f"WITH {HV} SELECT station, CAST(arg_max(k, hv) AS INTEGER) AS k, round(max(hv), 5) AS peak, round(arg_max(k, hv) / 64.0 * 50, 6) AS f0, round(300 / (4 * (arg_max(k, hv) / 64.0 * 50)), 6) AS thickness, 1800 > 200 / (arg_max(k, hv) / 64.0 * 50) AND 4 > 10 / (arg_max(k, hv) / 64.0 * 50) AND max(hv) > 2 AS clear FROM hv GROUP BY station")
def hvsr_peaks(spark, d):
    """Horizontal over vertical spectra of three components, their peak, the layer that it means, and whether the peak is clear."""
    spectra = _traces(spark, d).select(F.floor(F.col("vec_id") / 3).alias("station"), (F.col("vec_id") % 3).alias("c"), signal.amplitudes(F.col("data")).alias("a"))
    peaks = signal.pick_max(signal.horizontal_over_vertical(spectra).where("k BETWEEN 1 AND 31"), ["station"], "k", F.col("hv"))
    f0 = F.col("k") / 64.0 * 50
    return peaks.select("station", "k", F.round("amplitude", 5).alias("peak"), F.round(f0, 6).alias("f0"), F.round(signal.thickness(F.lit(300.0), f0), 6).alias("thickness"), signal.clear_peak(f0, F.col("amplitude"), F.lit(1800.0), F.lit(4.0)).alias("clear"))


@query("""WITH v0 AS (SELECT event_type, value AS x FROM events WHERE value > 0), k0 AS (SELECT event_type, avg(ln(x)) AS m, coalesce(stddev_samp(ln(x)), 0) AS s FROM v0 GROUP BY 1), v1 AS (SELECT v0.* FROM v0 JOIN k0 USING (event_type) WHERE abs(ln(x) - m) <= 2 * s + 1e-12), k1 AS (SELECT event_type, avg(ln(x)) AS m, coalesce(stddev_samp(ln(x)), 0) AS s FROM v1 GROUP BY 1),
v2 AS (SELECT v1.* FROM v1 JOIN k1 USING (event_type) WHERE abs(ln(x) - m) <= 2 * s + 1e-12) SELECT event_type, round(exp(avg(ln(x))), 6) AS median, round(stddev_samp(ln(x)), 6) AS sigma_ln, count(*) AS n FROM v2 GROUP BY 1""")
def lognormal_rejection(spark, d):
    """The lognormal median and spread without windows far off, in two rounds."""
    kept = signal.without_outliers(read(spark, d, "events").select("event_type", "value"), ["event_type"], "value", 2.0, rounds=2)
    return signal.lognormal(kept, ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), F.round("sigma_ln", 6).alias("sigma_ln"), "n")


@query("SELECT p_partkey, round(list_sum(list_transform(range(0, 128), lambda i: cos(p_size * 0.5 * sin(pi() * (i + 0.5) / 128)))) / 128, 9) + 0 AS j0 FROM part")
def j0_coherence(spark, d):
    """The coherence of an isotropic field between two stations: J0 of wave number times distance."""
    return read(spark, d, "part").select("p_partkey", (F.round(signal.bessel_j0(F.col("p_size") * 0.5), 9) + 0.0).alias("j0"))


@query("WITH o AS (SELECT l_orderkey, l_linenumber AS f, CAST(avg(l_quantity) AS DOUBLE) AS g FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, f, round(sum(coalesce(a, 0)) OVER (PARTITION BY l_orderkey ORDER BY f ROWS UNBOUNDED PRECEDING), 6) + 0 AS phase FROM (SELECT *, (f - lag(f) OVER w) * (g + lag(g) OVER w) / 2.0 AS a FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY f))")
def group_delay_phase(spark, d):
    """The phase as the integral of the group delay over frequency."""
    delays = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("f")).agg(F.avg("l_quantity").alias("g"))
    return signal.cumulative_integral(delays, "l_orderkey", "f", "f", "g").select("l_orderkey", "f", (F.round("integral", 6) + 0.0).alias("phase"))


@query("""WITH v0 AS (SELECT event_id, user_id, value AS x FROM events), m0 AS (SELECT user_id, 1.2 * sqrt(avg(x * x)) AS m FROM v0 GROUP BY 1), v1 AS (SELECT event_id, user_id, CASE WHEN abs(x) > m THEN x * m / abs(x) ELSE x END AS x FROM v0 JOIN m0 USING (user_id)), m1 AS (SELECT user_id, 1.2 * sqrt(avg(x * x)) AS m FROM v1 GROUP BY 1)
SELECT event_id, round(CASE WHEN abs(x) > m THEN x * m / abs(x) ELSE x END, 6) AS levelled FROM v1 JOIN m1 USING (user_id)""")
def water_levels(spark, d):
    out = signal.water_level(read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value", rounds=2, level=1.2)
    return out.select("event_id", F.round("levelled", 6).alias("levelled"))


@query("SELECT event_id, CASE WHEN abs(value) > 1.5 * r THEN 0.0 ELSE value END AS quiet FROM (SELECT *, sqrt(avg(value * value) OVER (PARTITION BY user_id)) AS r FROM events)")
def event_removal(spark, d):
    return signal.remove_events(read(spark, d, "events"), "user_id", "value", 1.5).select("event_id", "quiet")


@query(f"WITH {S} SELECT vec_id, CAST(n // 4 AS INTEGER) AS bin, round(avg(x), 8) + 0 AS x FROM s GROUP BY ALL")
def decimated_traces(spark, d):
    return _round(signal.decimated(signal.samples(_traces(spark, d), ["vec_id"], "data"), ["vec_id"], 4), 8, "x")


@query("WITH t AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c) SELECT user_id, run, count(*) AS samples, min(t) AS first, max(t) AS last, round(CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / count(*), 6) AS mean FROM r GROUP BY user_id, run")
def merged_traces(spark, d):
    """A channel's samples as runs without a gap of more than a day."""
    events = read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    return signal.merged(events, "user_id", F.col("t"), "value", 86_400_000_000).withColumn("mean", F.round("mean", 6))


@query("SELECT date_trunc('day', ts)::DATE AS day, user_id, count(*) AS n, sum(CAST(value AS DECIMAL(28,4))) AS total FROM events GROUP BY 1, 2")
def day_cuts(spark, d):
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).alias("total"))
    return days.withColumn("total", F.col("total").cast("decimal(38,4)"))


@query("""WITH a AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS n, value FROM events), b AS (SELECT event_id, user_id, value - (avg(value) OVER w + coalesce(regr_slope(value, n) OVER w, 0) * (n - avg(n) OVER w)) AS x FROM a WINDOW w AS (PARTITION BY user_id)),
c AS (SELECT event_id, user_id, greatest(-r, least(r, x)) AS x FROM (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY user_id)) AS r FROM b)) SELECT event_id, round(x / nullif(avg(abs(x)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0), 5) + 0 AS prepared FROM c""")
def prepared_channels(spark, d):
    """The single-station chain: without trend, clipped, and divided by the running absolute mean."""
    out = signal.detrend(read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    out = signal.clip_rms(out, "user_id", "detrended")
    return _round(signal.running_absolute_mean(out, "user_id", "event_id", "clipped", 3).select("event_id", F.col("normalised").alias("prepared")), 5, "prepared")


@query("WITH r AS (SELECT l_orderkey AS ray, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) / 2000 AS y0, max(l_extendedprice) / 2000 AS y1 FROM lineitem GROUP BY 1) SELECT ray AS ray_id, CAST(floor((x0 + (x1 - x0) * ((i + 0.5) / 32)) / 5) AS BIGINT) AS ix, CAST(floor((y0 + (y1 - y0) * ((i + 0.5) / 32)) / 5) AS BIGINT) AS iy, round(sum(sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) / 32), 6) + 0 AS length FROM r, range(0, 32) AS q(i) GROUP BY 1, 2, 3")
def ray_cells(spark, d):
    """The length of each straight ray in the cells that it meets."""
    rays = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ray_id")).agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), (F.min("l_extendedprice") / 2000).alias("y0"), (F.max("l_extendedprice") / 2000).alias("y1"))
    return _round(signal.ray_cells(rays, 5.0, 32), 6, "length")


@query("SELECT l_suppkey AS cell_id, count(DISTINCT l_orderkey) AS rays, count(DISTINCT l_orderkey) > 2 AS enough, round((SELECT count(DISTINCT l_orderkey) FROM lineitem) / CAST((SELECT count(DISTINCT l_suppkey) FROM lineitem) AS DOUBLE), 6) AS ratio FROM lineitem GROUP BY 1")
def ray_quality(spark, d):
    """Rays a cell, and data for each parameter."""
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ray_id"), F.col("l_suppkey").alias("cell_id"))
    return signal.ray_quality(items).withColumn("ratio", F.round("ratio", 6))


INCIDENCE = "g AS (SELECT l_orderkey AS r, l_suppkey AS c, sum(l_quantity) AS l FROM lineitem GROUP BY 1, 2), t AS (SELECT r, sum(l / (4 + c % 5)) AS t FROM g GROUP BY 1)"
MATRIX = "m AS (SELECT i, j, sum(g) AS g FROM (SELECT a.c AS i, b.c AS j, a.l * b.l AS g FROM g a JOIN g b USING (r) UNION ALL SELECT c, c, 100.0 FROM (SELECT DISTINCT c FROM g) UNION ALL SELECT c + u, c + v, CASE WHEN u = v THEN 10.0 ELSE -10.0 END FROM (SELECT DISTINCT c FROM g WHERE c + 1 IN (SELECT c FROM g)), range(0, 2) AS p(u), range(0, 2) AS q(v)) GROUP BY i, j)"


@query(f"WITH {INCIDENCE}, {MATRIX}, b AS (SELECT c AS i, sum(l * t) AS b FROM g JOIN t USING (r) GROUP BY 1), d AS (SELECT i, sum(abs(g)) AS d FROM m GROUP BY 1), x0 AS (SELECT i, b / d AS x FROM b JOIN d USING (i)), x1 AS (SELECT i, x0.x + (b - a) / d AS x FROM x0 JOIN b USING (i) JOIN d USING (i) JOIN (SELECT m.i, sum(g * x) AS a FROM m JOIN x0 ON x0.i = m.j GROUP BY 1) USING (i)), x2 AS (SELECT i, x1.x + (b - a) / d AS x FROM x1 JOIN b USING (i) JOIN d USING (i) JOIN (SELECT m.i, sum(g * x) AS a FROM m JOIN x1 ON x1.i = m.j GROUP BY 1) USING (i)) SELECT i AS cell_id, round(x, 6) AS slowness FROM x2")
def damped_solution(spark, d):
    """Slowness from travel times by damped, smoothed least squares, after two Jacobi rounds."""
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ray_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum("l_quantity").alias("length"))
    t = g.groupBy("ray_id").agg(F.sum(F.col("length") / (4 + F.col("cell_id") % 5)).alias("t"))
    return signal.damped_steps(g, t, 100.0, 10.0, 2).select("cell_id", F.round("slowness", 6).alias("slowness"))


@query(f"WITH {NEXT} SELECT label, a.vec_id AS source, count(*) AS receivers, min(b.vec_id) AS first, max(b.vec_id) AS last FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id GROUP BY 1, 2")
def source_gather(spark, d):
    """Each trace as a virtual source, with the receivers of its group."""
    return signal.gather(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("SELECT c_custkey, round(degrees(atan2(c_nationkey - 12, c_acctbal / 400 - 12)), 6) + 0 AS azimuth, abs(cos(atan2(c_nationkey - 12, c_acctbal / 400 - 12))) > 0.9 AS end_fire FROM customer")
def end_fire(spark, d):
    """Sources near the line through two stations on the x axis."""
    azimuth = F.atan2(F.col("c_nationkey") - 12, F.col("c_acctbal") / 400 - 12)
    return read(spark, d, "customer").select("c_custkey", (F.round(F.degrees(azimuth), 6) + 0.0).alias("azimuth"), signal.near_axis(azimuth, 0.9).alias("end_fire"))


@query("SELECT s_suppkey, s_acctbal AS hv, n AS dispersion FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_suppkey = s_suppkey")
def joint_inputs(spark, d):
    """Stations for which both kinds of data are there."""
    dispersion = read(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("dispersion"))
    return read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("hv")).join(dispersion, "s_suppkey")


@query("SELECT vec_id, CAST(generate_subscripts([0.5, 1.0, 2.0, 5.0], 1) - 1 AS INTEGER) AS i, unnest([0.5, 1.0, 2.0, 5.0]::DOUBLE[]) AS period, round((0.8 + 0.55 * unnest([0.5, 1.0, 2.0, 5.0]::DOUBLE[])) * unnest([0.5, 1.0, 2.0, 5.0]::DOUBLE[]) / 3, 6) AS depth FROM embeddings")
def period_rows(spark, d):
    """A row a period of each trace, with the depth that it senses."""
    periods = F.array(*[F.lit(p) for p in (0.5, 1.0, 2.0, 5.0)])
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(periods).alias("i", "period"))
    return rows.withColumn("depth", F.round((0.8 + 0.55 * F.col("period")) * F.col("period") / 3, 6))
