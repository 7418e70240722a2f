"""Registered queries of the package and the SQL that checks them.

The driver's tables stand in for the inputs of each family: events are sampled channels, embeddings are traces, documents
are logs, labels are graded answers, orders are submissions, parts and line items are jobs and their tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import jobs, lines, scoring, segments, signal
from ..streaming import follow
from . import batch, correlations, inversion, records, traces  # noqa: F401
from .registry import QUERIES, SQL, query, read

@query("SELECT s_suppkey, s_name || ' nation=' || CAST(s_nationkey AS VARCHAR) AS label, s_acctbal FROM supplier WHERE s_acctbal > 4620.0")
def station_filter_sort(spark, d):
    """Strict numeric filter, computed label, numeric order with a tie key."""
    label = F.concat_ws(" ", "s_name", F.concat(F.lit("nation="), F.col("s_nationkey").cast("string"))).alias("label")
    return read(spark, d, "supplier").where(F.col("s_acctbal") > 4620.0).select("s_suppkey", label, "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE regexp_matches(text, 'the') GROUP BY source")
def line_frequency(spark, d):
    return lines.line_frequency(read(spark, d, "documents").where(F.col("text").rlike("the")), F.col("source"))


@query("SELECT count(*) AS lines, CAST(sum(CASE WHEN trim(url) = '' THEN 0 ELSE len(string_split_regex(trim(url), '[ \\t]+')) END) AS BIGINT) AS words, CAST(sum(strlen(url)) + count(*) AS BIGINT) AS bytes FROM pages")
def word_line_counts(spark, d):
    return lines.count_lines(read(spark, d, "pages"), "url")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM b")
def adjacent_dedup(spark, d):
    return lines.collapse_adjacent(read(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id", "user_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_n_size(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT p_partkey, r AS row, (r - 1) // 100 AS batch, (r - 1) % 100 AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part)")
def batch_assign(spark, d):
    rows = lines.row_index(read(spark, d, "part").select("p_partkey"), "p_partkey")
    return lines.in_batches(rows, "row", 100).select("p_partkey", "row", "batch", "place")


@query("SELECT r // 100 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1")
def batch_coverage_legacy(spark, d):
    rows = lines.row_index(read(spark, d, "part").select("p_partkey"), "p_partkey")
    return lines.in_batches(rows, "row", 100, legacy=True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, CAST(([1.5, 2.0, 2.5, 3.0, 3.5])[label + 1] AS DOUBLE) AS parameter, round(CAST(([1.5, 2.0, 2.5, 3.0, 3.5])[label + 1] AS DOUBLE) / 3, 1) AS depth FROM embeddings")
def param_positional_join(spark, d):
    """A list's element by 0-based index; beyond the list null. Depth is a third of a wavelength of one second."""
    out = jobs.task_parameters(read(spark, d, "embeddings").select("vec_id", "label"), [1.5, 2.0, 2.5, 3.0, 3.5], "label")
    return out.select("vec_id", "parameter", F.round(F.col("parameter") / 3, 1).alias("depth"))


@query("SELECT doc_id, lang, CAST(sum(quality) OVER w AS BIGINT) AS score, count(*) OVER w AS total FROM labels JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def running_score(spark, d):
    answers = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return scoring.running_score(answers, "lang", "doc_id", F.col("quality") == 1).select("doc_id", "lang", "score", "total")


BAND = "CASE WHEN pct >= 100 THEN 'perfect' WHEN pct >= 85 THEN 'excellent' WHEN pct >= 70 THEN 'good' WHEN pct >= 50 THEN 'fair' ELSE 'poor' END"


@query(f"SELECT *, {BAND} AS band FROM (SELECT source, CAST(sum(quality) AS BIGINT) AS correct, count(*) AS total, CAST((2000 * sum(quality) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS pct FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def category_scores(spark, d):
    answers = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return scoring.summary(answers, "source", F.col("quality") == 1).orderBy("source")


@query("SELECT o_orderkey, o_custkey AS name, o_totalprice AS pct, o_orderdate AS time FROM orders WHERE o_custkey <> 0")
def leaderboard(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name"), F.col("o_totalprice").alias("pct"), F.col("o_orderdate").alias("time"))
    return scoring.leaderboard(rows, "o_orderkey")


@query("SELECT source, CAST(sum(quality) AS BIGINT) AS score, count(*) AS total, CAST((2000 * sum(quality) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS percentage FROM labels JOIN documents USING (doc_id) GROUP BY source")
def result_document(spark, d):
    """Each source's score, by sums; result_json has whole documents, of conversations, whose turns bound them."""
    answers = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return scoring.summary(answers, "source", F.col("quality") == 1).select("source", F.col("correct").alias("score"), "total", F.col("pct").alias("percentage"))


@query("SELECT p_partkey, CAST(t AS INTEGER) AS task_id, CAST(t // 3 AS BIGINT) AS wave FROM part, unnest(range(0, p_size + 1)) AS x(t)")
def array_expand(spark, d):
    specs = read(spark, d, "part").select("p_partkey", F.format_string("0-%d%%3", "p_size").alias("array_spec"))
    return jobs.fan_out(specs).select("p_partkey", "task_id", "wave")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS j, p_partkey // 2 AS k FROM part WHERE p_partkey >= 2 AND p_partkey // 2 IN (SELECT p_partkey FROM part)), l AS (SELECT p_partkey AS job_id, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT j FROM e) UNION ALL SELECT e.j, l.level + 1 FROM l JOIN e ON e.k = l.job_id) SELECT job_id, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY job_id")
def dag_levels(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("job_id"))
    edges = nodes.where("job_id >= 2").select("job_id", F.floor(F.col("job_id") / 2).cast("long").alias("depends_on"))
    return jobs.levels(nodes, edges.join(nodes.select(F.col("job_id").alias("depends_on")).hint("merge"), "depends_on", "left_semi"))


@query("SELECT o_orderkey, bool_and(l_linestatus = 'F') AS ready, count(*) AS n_tasks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def corr_task_ready(spark, d):
    tasks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return jobs.ready(read(spark, d, "orders").select("o_orderkey"), tasks, "o_orderkey", F.col("l_linestatus") == "F").select("o_orderkey", "ready", "n_tasks")


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_quantity, round(100.0 * CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / (count(*) * 0.1), 4) AS efficiency FROM lineitem GROUP BY l_orderkey")
def cpu_efficiency(spark, d):
    used = F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double")
    out = read(spark, d, "lineitem").groupBy("l_orderkey").agg(parse.exact_mean(F.col("l_quantity")).alias("mean_quantity"), used.alias("used"), F.count(F.lit(1)).alias("n"))
    return out.select("l_orderkey", "mean_quantity", F.round(jobs.efficiency(F.col("used"), F.col("n"), F.lit(0.1)), 4).alias("efficiency"))


@query("SELECT c_custkey, round(30000 * (c_acctbal + 1000) / 11000 + 300 * (c_nationkey / 25.0) + 15000 * CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.25 END, 4) AS priority FROM customer")
def priority_order(spark, d):
    factors = {"fairshare": (F.col("c_acctbal") + 1000) / 11000, "age": F.col("c_nationkey") / 25.0, "partition": F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.25)}
    return read(spark, d, "customer").select("c_custkey", F.round(jobs.priority(factors), 4).alias("priority")).orderBy(F.desc("priority"), "c_custkey")


@query("SELECT id, source_size, target_size, CASE WHEN target_size IS NULL THEN 'missing' WHEN source_size IS NULL THEN 'extra' WHEN source_size <> target_size THEN 'differs' ELSE 'equal' END AS status FROM (SELECT p_partkey AS id, p_size AS source_size FROM part) FULL JOIN (SELECT vec_id AS id, label AS target_size FROM embeddings) USING (id)")
def manifest_diff(spark, d):
    """Parts and traces as two listings of ids with sizes."""
    source = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    target = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("size"))
    return lines.manifest_difference(source, target, "id", "size")


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 8) AS demeaned FROM events")
def demean(spark, d):
    return signal.demean(read(spark, d, "events"), "user_id", "value").select("event_id", F.round(F.col("demeaned"), 8).alias("demeaned"))


@query("SELECT event_id, round(value - (avg(value) OVER w + coalesce(regr_slope(value, n) OVER w, 0) * (n - avg(n) OVER w)), 5) AS detrended FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS n FROM events) WINDOW w AS (PARTITION BY user_id)")
def detrend(spark, d):
    return signal.detrend(read(spark, d, "events"), "user_id", "event_id", "value").select("event_id", F.round(F.col("detrended"), 5).alias("detrended"))


@query("SELECT event_id, CAST(sign(value - 50) AS DOUBLE) AS bit, round(greatest(-r, least(r, value)), 6) AS clipped FROM (SELECT *, sqrt(avg(value * value) OVER (PARTITION BY user_id)) AS r FROM events)")
def one_bit_and_clip(spark, d):
    return signal.clip_rms(read(spark, d, "events"), "user_id", "value").select("event_id", signal.one_bit(F.col("value") - 50).alias("bit"), F.round(F.col("clipped"), 6).alias("clipped"))


@query("SELECT event_id, round(value / nullif(avg(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0), 6) AS normalised FROM events")
def ram_norm(spark, d):
    return signal.running_absolute_mean(read(spark, d, "events"), "user_id", "event_id", "value", 2).select("event_id", F.round(F.col("normalised"), 6).alias("normalised"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(28,4))) AS total FROM events GROUP BY 1, 2")
def segment_windows(spark, d):
    out = follow.windowed(read(spark, d, "events"), "ts", "event_type", "value", "30 minutes")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.col("total").cast("decimal(38,4)"))


@query("SELECT day, event_type, round(avg(m) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW), 6) AS moving FROM (SELECT date_trunc('day', ts)::DATE AS day, event_type, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS m FROM events GROUP BY 1, 2)")
def moving_stack(spark, d):
    daily = read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(parse.exact_mean(F.col("value")).alias("m"))
    w = Window.partitionBy("event_type").orderBy(F.unix_date("day")).rangeBetween(-4, 0)
    return daily.select("day", "event_type", F.round(F.avg("m").over(w), 6).alias("moving"))


@query("SELECT event_type, round(exp(avg(ln(value))), 6) AS median, round(stddev_samp(ln(value)), 6) AS sigma_ln, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def lognormal_stats(spark, d):
    out = signal.lognormal(read(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", F.round(F.col("median"), 6).alias("median"), F.round(F.col("sigma_ln"), 6).alias("sigma_ln"), "n")


@query("SELECT label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id < b.vec_id")
def pair_list(spark, d):
    return signal.pairs(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


def _next_pairs(spark, d):
    """Each trace with the next of its group: one pair a trace."""
    traces = read(spark, d, "embeddings")
    return traces, segments.following(traces, "label", "vec_id")


CCS = """p AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS n FROM embeddings),
cc AS (SELECT p.a, p.b, CAST(y.n - x.n AS INTEGER) AS lag, sum(x.v * y.v) AS c FROM p JOIN s x ON x.vec_id = p.a JOIN s y ON y.vec_id = p.b AND abs(y.n - x.n) <= 5 GROUP BY ALL)"""


@query(f"WITH {CCS} SELECT a, b, lag, round(c, 6) AS c FROM cc")
def xcorr_time(spark, d):
    traces, pair = _next_pairs(spark, d)
    return signal.correlations(traces, pair, "vec_id", "embedding", 5).withColumn("c", F.round(F.col("c"), 6))


@query(f"WITH {CCS} SELECT lag, round(avg(c), 6) AS linear, round(median(c), 6) AS median, count(*) AS n FROM cc GROUP BY lag")
def linear_and_median_stack(spark, d):
    traces, pair = _next_pairs(spark, d)
    out = signal.stack(signal.correlations(traces, pair, "vec_id", "embedding", 5), ["lag"])
    return out.select("lag", F.round(F.col("linear"), 6).alias("linear"), F.round(F.col("median"), 6).alias("median"), "n")


@query(f"WITH {CCS} SELECT a, b, abs(lag) AS lag, round(avg(c), 6) AS c FROM cc GROUP BY a, b, abs(lag)")
def cc_symmetric(spark, d):
    traces, pair = _next_pairs(spark, d)
    return signal.symmetric(signal.correlations(traces, pair, "vec_id", "embedding", 5), ["a", "b"]).withColumn("c", F.round(F.col("c"), 6))


@query(f"WITH {CCS} SELECT a, b, arg_max(lag, c) AS lag, round(max(c), 6) AS amplitude FROM cc GROUP BY a, b")
def pick_max(spark, d):
    traces, pair = _next_pairs(spark, d)
    out = signal.pick_max(signal.correlations(traces, pair, "vec_id", "embedding", 5), ["a", "b"], "lag", F.col("c"))
    return out.withColumn("amplitude", F.round(F.col("amplitude"), 6))


@query("SELECT l_orderkey AS ray_id, round(CAST(sum(CAST(l_quantity / (p_size + 1) AS DOUBLE)) AS DOUBLE), 5) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def ray_forward(spark, d):
    rays = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ray_id"), F.col("l_partkey").alias("cell_id"), F.col("l_quantity").alias("length"))
    grid = read(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), (F.col("p_size") + 1).cast("double").alias("velocity"))
    return signal.travel_times(rays, grid).withColumn("t", F.round(F.col("t"), 5))


@query("SELECT a.l_suppkey AS i, b.l_suppkey AS j, round(sum(a.l_quantity * b.l_quantity), 2) AS g FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey <= b.l_suppkey GROUP BY 1, 2")
def normal_equations(spark, d):
    rays = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ray_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_quantity").alias("length"))
    return signal.normal_matrix(rays).withColumn("g", F.round("g", 2))


@query("SELECT l_partkey AS cell_id, count(*) AS rays, round(sum(l_quantity), 2) AS length FROM lineitem GROUP BY 1")
def ray_coverage(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("rays"), F.round(F.sum("l_quantity"), 2).alias("length"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
