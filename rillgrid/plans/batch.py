"""Queries on batch jobs: limits, dependencies, checks, configurations and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import jobs
from .registry import query, read

NAMES = ", ".join(f"'{name}'" for name, *_ in jobs.PARTITIONS)
LIMITS = ", ".join(f"('{name}', {minutes}, {nodes}, {'NULL' if cores is None else cores})" for name, minutes, nodes, cores in jobs.PARTITIONS)


def _jobs(spark, d):
    names = F.array(*[F.lit(name) for name, *_ in jobs.PARTITIONS])
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.get(names, (F.col("o_custkey") % len(jobs.PARTITIONS)).cast("int")).alias("partition"),
        F.floor(F.col("o_totalprice") / 20).cast("long").alias("minutes"), (F.col("o_orderkey") % 5 + 1).alias("nodes"), (F.col("o_orderkey") % 7 + 1).alias("cores"),
    )


JOBS = f"SELECT o_orderkey AS job_id, ([{NAMES}])[o_custkey % {len(jobs.PARTITIONS)} + 1] AS partition, CAST(floor(o_totalprice / 20) AS BIGINT) AS minutes, o_orderkey % 5 + 1 AS nodes, o_orderkey % 7 + 1 AS cores FROM orders"


@query(f"""WITH j AS ({JOBS}), p(partition, m, n, c) AS (VALUES {LIMITS})
SELECT job_id, partition, array_to_string(list_filter([CASE WHEN minutes > m THEN 'time' END, CASE WHEN nodes > n THEN 'nodes' END, CASE WHEN cores > c THEN 'cores' END], lambda x: x IS NOT NULL), ',') AS violations FROM j JOIN p USING (partition)""")
def partition_violations(spark, d):
    """Which limits of its partition a job breaks."""
    return jobs.partition_violations(_jobs(spark, d)).select("job_id", "partition", F.array_join("violations", ",").alias("violations"))


TASKS = "SELECT l_orderkey AS job_id, l_linenumber AS task_id, CASE WHEN bool_and(l_linestatus = 'F') THEN 'COMPLETED' WHEN bool_or(l_returnflag = 'R') THEN 'FAILED' ELSE 'RUNNING' END AS state FROM lineitem GROUP BY 1, 2"


def _tasks(spark, d):
    state = F.when(F.bool_and(F.col("l_linestatus") == "F"), "COMPLETED").when(F.bool_or(F.col("l_returnflag") == "R"), "FAILED").otherwise("RUNNING")
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task_id")).agg(state.alias("state"))


@query(f"WITH t AS ({TASKS}), n AS (SELECT job_id + 1 AS job_id, task_id, state FROM t) SELECT t.job_id, t.task_id, coalesce(n.state = 'COMPLETED', false) AS ready FROM t LEFT JOIN n ON n.job_id = t.job_id AND n.task_id = t.task_id")
def aftercorr_ready(spark, d):
    """A task waits for the task of its number in the job before it."""
    tasks = _tasks(spark, d)
    return jobs.after_corresponding(tasks.select("job_id", "task_id", (F.col("job_id") - 1).alias("depends_on")), tasks).select("job_id", "task_id", "ready")


@query(f"""WITH t AS ({TASKS}), s AS (SELECT job_id, bool_and(state = 'COMPLETED') AS ok, bool_or(state = 'FAILED') AS bad, bool_and(state <> 'RUNNING') AS over FROM t GROUP BY 1)
SELECT o_orderkey AS job_id, k AS kind, CASE k WHEN 'afterok' THEN coalesce(over AND ok, false) WHEN 'afterany' THEN coalesce(over, false) WHEN 'afternotok' THEN coalesce(over AND bad, false) ELSE coalesce(over, true) END AS ready
FROM (SELECT o_orderkey, (['afterok', 'afterany', 'afternotok', 'singleton'])[o_orderkey % 4 + 1] AS k FROM orders) LEFT JOIN s ON s.job_id = o_orderkey + 1""")
def dependency_ready(spark, d):
    """Jobs by the kind of their dependency on one other job; a singleton waits for what runs under its name, if anything does."""
    kinds = F.array(*[F.lit(k) for k in ("afterok", "afterany", "afternotok", "singleton")])
    waiting = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("kind"), (F.col("o_orderkey") + 1).alias("depends_on"))
    return jobs.ready_by_kind(waiting, _tasks(spark, d)).select("job_id", "kind", "ready")


@query("SELECT l_orderkey, round(100.0 * sum(CAST(l_quantity AS DECIMAL(18,4))) / (count(*) * 64), 2) AS memory_efficiency FROM lineitem GROUP BY l_orderkey")
def memory_efficiency(spark, d):
    used = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("used"), (F.count(F.lit(1)) * 64).alias("asked"))
    return used.select("l_orderkey", F.round(jobs.efficiency(F.col("used"), F.lit(1), F.col("asked")), 2).alias("memory_efficiency"))


@query("SELECT label, count(*) AS files, CAST(ceil(count(*) / 8.0) AS BIGINT) AS chunks, count(*) * (count(*) - 1) // 2 AS pairs FROM embeddings GROUP BY label")
def useful_tasks(spark, d):
    """How many tasks a step can use: time chunks, files, pairs of stations."""
    return read(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", *jobs.useful_tasks(F.col("n"), F.col("n"), F.lit(8)))


@query("SELECT l_suppkey, round(regr_intercept(y, x) + regr_slope(y, x) * ln(1000), 3) AS estimate FROM (SELECT l_suppkey, ln(l_quantity) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem) GROUP BY l_suppkey")
def resource_estimate(spark, d):
    """What 1000 files will take, from test runs of a few."""
    runs = read(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("files"), F.col("l_extendedprice").alias("used"))
    return jobs.extrapolated(runs, ["l_suppkey"], "files", "used", 1000).select("l_suppkey", F.round("estimate", 3).alias("estimate"))


@query(f"WITH j AS ({JOBS}) SELECT job_id, minutes <= 2880 AND cores <= 4 AS fits FROM j")
def backfill_fit(spark, d):
    """Whether a job fits in a gap of two days and four cores."""
    return _jobs(spark, d).select("job_id", jobs.fits_gap(F.col("minutes"), F.col("cores"), F.lit(2880), F.lit(4)).alias("fits"))


CLASSES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in jobs.FAILURES)
STATES = "(['OUT_OF_MEMORY', 'TIMEOUT', 'FAILED', 'PENDING', 'NODE_FAIL', 'FileNotFoundError', 'COMPLETED'])"


@query(f"SELECT event_id, symptom, cause, fix FROM (SELECT event_id, {STATES}[CAST(event_id % 7 AS INTEGER) + 1] AS symptom FROM events) LEFT JOIN (VALUES {CLASSES}) AS c(symptom, cause, fix) USING (symptom)")
def failure_classes(spark, d):
    states = F.array(*[F.lit(s) for s in ("OUT_OF_MEMORY", "TIMEOUT", "FAILED", "PENDING", "NODE_FAIL", "FileNotFoundError", "COMPLETED")])
    seen = read(spark, d, "events").select("event_id", F.get(states, (F.col("event_id") % 7).cast("int")).alias("symptom"))
    return jobs.failure_classes(seen)


LIMITS = ", ".join(f"('{name}', {minutes}, {cores or 'NULL'})" for name, minutes, _, cores in jobs.PARTITIONS)
NAMES = [name for name, *_ in jobs.PARTITIONS]


@query(f"""WITH l AS (SELECT * FROM (VALUES {LIMITS}) AS v(name, most_minutes, most_cores)), j AS (SELECT p_partkey AS k, p_size AS s, {NAMES}[p_partkey % 11 + 1] AS name, p_partkey % 5 + 1 AS cores, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size // 10) * 86400 + (p_size % 24) * 3600 + (p_size % 60) * 60 END AS seconds,
CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size * 1024 END AS mb FROM part),
c AS (SELECT k, [CASE WHEN k % 2 = 0 AND s % 3 = 0 THEN 'array_runs' END, CASE WHEN s % 5 > s % 6 THEN 'array_upwards' END, CASE WHEN cores > most_cores THEN 'cores_of_partition' END, CASE WHEN k % 3 = 2 THEN 'dependency_known' END, CASE WHEN k % 4 = 0 AND NOT contains(name, 'gpu') THEN 'gpus_where_gpus_are' END,
CASE WHEN mb IS NULL THEN 'memory_given' END, CASE WHEN mb IS NULL OR mb > 16384 * cores THEN 'memory_of_cores' END, CASE WHEN coalesce(seconds, 0) = 0 THEN 'time_given' END, CASE WHEN seconds IS NULL OR seconds > 60 * most_minutes THEN 'time_of_partition' END] AS x FROM j JOIN l USING (name))
SELECT k AS p_partkey, array_to_string(list_filter(x, lambda v: v IS NOT NULL), ',') AS failing FROM c""")
def submission_checklist(spark, d):
    """Job specifications as people write them, some of them wrong, checked before they are submitted."""
    size, key, two = F.col("p_size"), F.col("p_partkey"), lambda x: F.lpad(x.cast("string"), 2, "0")
    time = F.concat(F.floor(size / 10).cast("string"), F.lit("-"), two(size % 24), F.lit(":"), two(size % 60), F.lit(":00"))
    span = F.concat((size % 5).cast("string"), F.lit("-"), (size % 6).cast("string"), F.when(key % 2 == 0, F.concat(F.lit("%"), (size % 3).cast("string"))).otherwise(""))
    specs = read(spark, d, "part").select(
        "p_partkey", F.get(F.array(*[F.lit(n) for n in NAMES]), (key % 11).cast("int")).alias("partition"), F.when(size % 7 == 0, "soon").otherwise(time).alias("time"), F.when(size % 9 == 0, "lots").otherwise(F.concat(size.cast("string"), F.lit("G"))).alias("mem"),
        (key % 5 + 1).alias("cores"), span.alias("array_spec"), F.when(key % 4 == 0, "titan:2").alias("gres"), F.when(key % 3 == 0, F.concat(F.lit("afterok:"), key.cast("string"))).when(key % 3 == 2, "later").alias("dependency"),
    )
    return jobs.checked_specs(specs).select("p_partkey", F.array_join("failing", ",").alias("failing"))


@query("SELECT doc_id, stage, (['raw', 'clean', 'correlated', 'results', 'archive'])[stage] AS place, stage < 4 AS scratch FROM (SELECT doc_id, CAST(CASE WHEN n_chars < 500 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 5000 THEN 3 WHEN n_chars < 9000 THEN 4 ELSE 5 END AS INTEGER) AS stage FROM documents)")
def lifecycle_stages(spark, d):
    """Where data lie in their life, and whether they may go once the next stage is there."""
    return read(spark, d, "documents").select("doc_id", *jobs.lifecycle(F.col("n_chars"), [500, 2000, 5000, 9000]))


@query("SELECT p_partkey, 'PERIODS ' || CAST(p_size AS VARCHAR) || chr(10) || 'TASK ' || p_partkey || chr(10) || 'OUT ' || lower(p_type) || '/' || p_partkey || chr(10) AS config FROM part")
def task_configs(spark, d):
    """The text of each task's own configuration file."""
    return read(spark, d, "part").select("p_partkey", jobs.config_text({"PERIODS": F.col("p_size"), "TASK": F.col("p_partkey"), "OUT": F.concat_ws("/", F.lower("p_type"), F.col("p_partkey").cast("string"))}).alias("config"))


@query("SELECT p_partkey, CASE WHEN t > 1 AND c > 1 THEN 'hybrid' WHEN t > 1 THEN 'mpi' WHEN c > 1 THEN 'threaded' ELSE 'single' END AS kind FROM (SELECT p_partkey, p_size % 3 AS t, p_partkey % 3 AS c FROM part)")
def parallel_class(spark, d):
    return read(spark, d, "part").select("p_partkey", jobs.parallelism(F.col("p_size") % 3, F.col("p_partkey") % 3).alias("kind"))


@query("SELECT p_partkey, (p_size // 10) * 86400 + (p_size % 24) * 3600 + (p_size % 60) * 60 + p_size % 60 AS seconds, p_size * 1024 AS memory_mb, CAST(p_size % 4 AS INTEGER) AS gpus, CASE WHEN p_size % 2 = 0 THEN 'titan' END AS gpu_kind, (['afterok', 'afterany'])[p_size % 2 + 1] AS kind, p_partkey AS depends_on FROM part")
def job_specs(spark, d):
    """Durations, sizes, GPU requests and dependencies as people write them, parsed."""
    size, two = F.col("p_size"), lambda x: F.lpad(x.cast("string"), 2, "0")
    text = read(spark, d, "part").select(
        "p_partkey", F.concat(F.floor(size / 10).cast("string"), F.lit("-"), two(size % 24), F.lit(":"), two(size % 60), F.lit(":"), two(size % 60)).alias("time"), F.concat(size.cast("string"), F.lit("G")).alias("mem"),
        F.concat(F.when(size % 2 == 0, "titan:").otherwise(""), (size % 4).cast("string")).alias("gres"), F.concat(F.when(size % 2 == 0, "afterok:").otherwise("afterany:"), F.col("p_partkey").cast("string")).alias("dep"),
    )
    gpu, dep = parse.gpu_spec(F.col("gres")), parse.dependency(F.col("dep"))
    out = text.select("p_partkey", parse.duration_seconds(F.col("time")).alias("seconds"), parse.memory_mb(F.col("mem")).alias("memory_mb"), gpu["count"].alias("gpus"), gpu["kind"].alias("gpu_kind"), dep["kind"].alias("kind"), dep["job_id"].alias("depends_on"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("seconds", "memory_mb")})


@query("SELECT l_orderkey, l_linenumber, 'out/' || l_returnflag || '-' || l_orderkey || '_' || l_linenumber || '.log' AS name FROM lineitem")
def output_names(spark, d):
    name = parse.output_name(F.lit("out/%x-%A_%a.log"), F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))


@query("SELECT s_suppkey, 'S' || s_suppkey AS station, (['HHZ', 'HHN', 'BHE'])[CAST(s_suppkey % 3 AS INTEGER) + 1] AS channel, substr((['HHZ', 'HHN', 'BHE'])[CAST(s_suppkey % 3 AS INTEGER) + 1], 3, 1) AS component FROM supplier WHERE s_suppkey % 3 <> 2")
def trace_select(spark, d):
    """Traces of some channels by the parts of their ids."""
    channel = F.get(F.array(F.lit("HHZ"), F.lit("HHN"), F.lit("BHE")), (F.col("s_suppkey") % 3).cast("int"))
    ids = read(spark, d, "supplier").withColumn("id", parse.trace_id(F.concat(F.lit("CH.S"), F.col("s_suppkey").cast("string"), F.lit(".."), channel)))
    return ids.where("id.band = 'H'").select("s_suppkey", "id.station", "id.channel", "id.component")


@query("SELECT o_orderkey AS job_id, 'job' || o_custkey AS name, 'shared-cpu' AS partition, CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'COMPLETED' END AS state, (o_orderkey % 4) * 86400 + (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 AS seconds, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 50) * 1024 END AS memory_mb, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS exit_code, 0 AS signal FROM orders")
def accounting_report(spark, d):
    """Accounting rows as they are written, parsed; a memory without a number is null."""
    key, two = F.col("o_orderkey"), lambda x: F.lpad(x.cast("string"), 2, "0")
    report = read(spark, d, "orders").select(
        key.alias("job_id"), F.concat(F.lit("job"), F.col("o_custkey").cast("string")).alias("name"), F.lit("shared-cpu").alias("partition"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("COMPLETED").alias("state"),
        F.concat((key % 4).cast("string"), F.lit("-"), two(key % 24), F.lit(":"), two(F.col("o_custkey") % 60), F.lit(":00")).alias("elapsed"),
        F.when(key % 3 == 0, "unknown").otherwise(F.concat((key % 50).cast("string"), F.lit("G"))).alias("max_rss"), F.when(F.col("o_orderstatus") == "F", "1:0").otherwise("0:0").alias("exit_code"),
    )
    return jobs.accounting(report)
