"""Batch-job models as tables: array fan-out, waves, dependencies, limits, priority and efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import array_spec, dependency, duration_seconds, gpu_spec, memory_mb
from ..sources.steps import stored

#: Weights of the priority factors.
WEIGHTS = {"partition": 15000, "fairshare": 30000, "job_size": 1000, "age": 300}


#: Partitions with their time limit in minutes, their nodes, and the most cores of a job where it is limited.
PARTITIONS = [
    ("debug-cpu", 15, 2, None), ("public-cpu", 5760, 32, None), ("public-gpu", 2880, 2, None), ("public-bigmem", 5760, 2, None), ("public-interactive-cpu", 480, 1, None), ("public-interactive-gpu", 240, 1, None),
    ("public-longrun-cpu", 20160, 1, 2), ("public-short-cpu", 60, 2, None), ("shared-cpu", 720, 45, None), ("shared-gpu", 720, 9, None), ("shared-bigmem", 720, 2, None),
]
#: States in which jobs of the accounting stop short, by name, and one error of their logs: what is behind each, and what helps. The names are
#: fixed values.
FAILURES = [
    ("BOOT_FAIL", "a node did not come up", "wait, the scheduler takes another one"),
    ("CANCELLED", "someone or something took it back", "ask who, then submit it anew"),
    ("DEADLINE", "it could not end before its deadline", "move the deadline or cut the job up"),
    ("FAILED", "a command returned an error", "look for the first error in the log"),
    ("FileNotFoundError", "files were not yet seen by that node", "copy what it needs to the node first"),
    ("NODE_FAIL", "its node was lost", "submit it anew from the last state"),
    ("OUT_OF_MEMORY", "it used more memory than it had asked for", "measure the peak and ask for that"),
    ("PENDING", "it waits for its turn or its resources", "ask for less, or where more is free"),
    ("PREEMPTED", "a job of higher rank took its place", "let it go on from its last state"),
    ("TIMEOUT", "it was still at work at its limit", "measure a part and ask for that times the parts"),
]


def fan_out(jobs: DataFrame, spec: str = "array_spec") -> DataFrame:
    """One row a task, with the wave it runs in at the earliest if `most` tasks run at once. Specs that do not parse drop out."""
    parsed = jobs.withColumn("_a", array_spec(F.col(spec))).where("_a IS NOT NULL AND _a.lo <= _a.hi")
    tasks = parsed.withColumn("task_id", F.explode(F.sequence("_a.lo", "_a.hi")))
    wave = F.floor((F.col("task_id") - F.col("_a.lo")) / F.coalesce("_a.most", F.lit(2**31 - 1)))
    return tasks.withColumn("wave", wave.cast("long")).drop("_a")


def task_parameters(tasks: DataFrame, values: list[float], index: str = "task_id") -> DataFrame:
    """The 0-based list element of each task; null beyond the list."""
    return tasks.withColumn("parameter", F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(index)))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, level): the longest chain of dependencies before each job of an acyclic graph. Each round moves a frontier one
    edge on, one row a job, and stores it. Edges are stored once and joined by merging, so no table of jobs passes through the driver.
    A cycle is an error: then some level reaches the number of jobs."""
    jobs_, done = nodes.count(), 0
    onward = stored(edges.select("depends_on", F.col("job_id").alias("next")), "job-edges")
    first = nodes.join(onward.hint("merge"), F.col("job_id") == F.col("next"), "left_anti")
    frontier = stored(first.select("job_id", F.lit(0).alias("level")), "job-levels")
    rounds = [frontier]
    while not frontier.isEmpty():
        done += 1
        if done > jobs_:
            raise ValueError("the dependencies have a cycle")
        moved = frontier.hint("merge").join(onward, F.col("depends_on") == F.col("job_id"))
        frontier = stored(moved.select(F.col("next").alias("job_id"), (F.col("level") + 1).alias("level")).distinct(), "job-levels")
        rounds.append(frontier)
        if len(rounds) > 50:  # a long chain makes many small tables: keep each job's last level so far
            so_far = reduce(DataFrame.unionByName, rounds[:-1]).groupBy("job_id").agg(F.max("level").alias("level"))
            rounds = [stored(so_far, "job-levels", rounds[:-1]), frontier]
    out = reduce(DataFrame.unionByName, rounds).groupBy("job_id").agg(F.max("level").cast("long").alias("level"))
    if out.count() < jobs_:
        raise ValueError("the dependencies have a cycle")
    return out


def ready(jobs: DataFrame, upstream: DataFrame, key: str, state: Column) -> DataFrame:
    """Jobs with the flag whether all their upstream tasks are done."""
    done = upstream.groupBy(key).agg(F.bool_and(state).alias("all_done"), F.count(F.lit(1)).alias("n_tasks"))
    return jobs.join(done, key).withColumn("ready", F.col("all_done"))


def partition_violations(jobs: DataFrame) -> DataFrame:
    """jobs(partition, minutes, nodes, cores) with the limits that they break; a job of an unknown partition drops out. The
    partitions are a fixed small table."""
    limits = jobs.sparkSession.createDataFrame(PARTITIONS, "partition string, most_minutes int, most_nodes int, most_cores int")
    met = jobs.join(F.broadcast(limits), "partition")
    broken = [F.when(F.col(c) > F.col(f"most_{c}"), name) for c, name in (("minutes", "time"), ("nodes", "nodes"), ("cores", "cores"))]
    return met.withColumn("violations", F.filter(F.array(*broken), lambda x: x.isNotNull()))


def after_corresponding(waiting: DataFrame, tasks: DataFrame) -> DataFrame:
    """waiting(job_id, task_id, depends_on) with the flag whether the task of the same number there is done."""
    before = tasks.select(F.col("job_id").alias("depends_on"), "task_id", "state")
    return waiting.join(before, ["depends_on", "task_id"], "left").withColumn("ready", F.coalesce(F.col("state") == "COMPLETED", F.lit(False)))


def ready_by_kind(waiting: DataFrame, tasks: DataFrame) -> DataFrame:
    """waiting(kind, depends_on) with ready: afterok needs all tasks done, afterany all ended, afternotok all ended and one
    failed; a singleton needs that nothing of its name runs. An unknown job makes only a singleton ready."""
    ended = tasks.groupBy(F.col("job_id").alias("depends_on")).agg(
        F.bool_and(F.col("state") == "COMPLETED").alias("ok"), F.bool_or(F.col("state") == "FAILED").alias("bad"), F.bool_and(F.col("state") != "RUNNING").alias("over")
    )
    kind, over = F.col("kind"), F.coalesce("over", F.lit(False))
    flag = F.when(kind == "afterok", over & F.col("ok")).when(kind == "afterany", over).when(kind == "afternotok", over & F.col("bad")).otherwise(F.coalesce("over", F.lit(True)))
    return waiting.join(ended, "depends_on", "left").withColumn("ready", F.coalesce(flag, F.lit(False)))


def useful_tasks(files: Column, hours: Column, hours_a_chunk: Column) -> list[Column]:
    """The most tasks that the steps can use: one a file, one a time chunk, one a pair."""
    return [files.alias("files"), F.ceil(hours / hours_a_chunk).cast("long").alias("chunks"), F.floor(files * (files - 1) / 2).cast("long").alias("pairs")]


def extrapolated(runs: DataFrame, by: list[str], files: str, used: str, to: float) -> DataFrame:
    """The expected use at `to` files, by a line over the logarithm of the number of files (2 for 10 and 3 for 1000 is such a line)."""
    x = F.ln(F.col(files).cast("double"))
    line = runs.withColumn("_x", x).groupBy(*by).agg(F.regr_slope(F.col(used), F.col("_x")).alias("slope"), F.regr_intercept(F.col(used), F.col("_x")).alias("start"))
    return line.select(*by, (F.col("start") + F.col("slope") * F.ln(F.lit(float(to)))).alias("estimate"))


def fits_gap(minutes: Column, cores: Column, gap: Column, free: Column) -> Column:
    """Whether a job is short and small enough to run before those ahead of it."""
    return (minutes <= gap) & (cores <= free)


def failure_classes(seen: DataFrame) -> DataFrame:
    """seen(symptom) with cause and fix; null where nothing is known."""
    known = seen.sparkSession.createDataFrame(FAILURES, "symptom string, cause string, fix string")
    return seen.join(F.broadcast(known), "symptom", "left").select(*seen.columns, "cause", "fix")


def lifecycle(value: Column, bounds: list[float]) -> list[Column]:
    """The stage that data of a value are in (1 to 5), its place, and whether it lies on scratch and goes once the next one is there."""
    stage = reduce(lambda s, b: s + F.when(value >= b, 1).otherwise(0), bounds, F.lit(1))
    places = F.array(*[F.lit(p) for p in ("raw", "clean", "correlated", "results", "archive")])
    return [stage.alias("stage"), F.get(places, stage - 1).alias("place"), (stage < 4).alias("scratch")]


def config_text(settings: dict[str, Column]) -> Column:
    """One line `NAME value` a setting."""
    return F.concat(*[F.concat(F.lit(f"{name} "), value.cast("string"), F.lit("\n")) for name, value in settings.items()])


def priority(factors: dict[str, Column], weights: dict[str, int] = WEIGHTS) -> Column:
    """Weighted sum of factors in 0..1."""
    return sum((weights[name] * value for name, value in factors.items()), F.lit(0.0))


def efficiency(cpu_s: Column, cores: Column, elapsed_s: Column) -> Column:
    """Used share of the reserved core time in percent; null without any."""
    return 100.0 * cpu_s / F.nullif(cores * elapsed_s, F.lit(0))


#: The columns of an accounting report, as it writes them.
ACCOUNTING = "job_id long, name string, partition string, state string, elapsed string, max_rss string, exit_code string"


def accounting(report: DataFrame) -> DataFrame:
    """An accounting report with elapsed seconds, the most memory in MB, and the exit code and signal as numbers; what does not
    parse is null."""
    code = F.split("exit_code", ":")
    part = lambda i: F.get(code, F.lit(i)).try_cast("int")
    return report.select("job_id", "name", "partition", "state", duration_seconds(F.col("elapsed")).alias("seconds"), memory_mb(F.col("max_rss")).alias("memory_mb"), part(0).alias("exit_code"), part(1).alias("signal"))


def parallelism(ntasks: Column, cpus: Column) -> Column:
    return F.when((ntasks > 1) & (cpus > 1), "hybrid").when(ntasks > 1, "mpi").when(cpus > 1, "threaded").otherwise("single")


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; null counts as failing."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def spec_checks(most_mb_a_core: int = 16 * 1024) -> dict[str, Column]:
    """What a specification as people write it has to hold before it is submitted: columns partition, time, mem, cores, array_spec, gres,
    dependency, and most_minutes and most_cores of its partition. What is null was not asked for, but time and mem are needed."""
    seconds, memory, array, gpu = duration_seconds(F.col("time")), memory_mb(F.col("mem")), array_spec(F.col("array_spec")), gpu_spec(F.col("gres"))
    left_out = lambda c, ok: F.col(c).isNull() | F.coalesce(ok, F.lit(False))
    return {
        "array_runs": left_out("array_spec", F.coalesce(array["most"], F.lit(1)) > 0),
        "array_upwards": left_out("array_spec", array["lo"] <= array["hi"]),
        "cores_of_partition": F.coalesce(F.col("cores") <= F.col("most_cores"), F.col("cores") > 0),
        "dependency_known": left_out("dependency", dependency(F.col("dependency")).isNotNull()),
        "gpus_where_gpus_are": left_out("gres", gpu.isNotNull() & F.contains("partition", F.lit("gpu"))),
        "memory_given": memory > 0,
        "memory_of_cores": memory <= most_mb_a_core * F.col("cores"),
        "time_given": seconds > 0,
        "time_of_partition": seconds <= 60 * F.col("most_minutes"),
    }


def checked_specs(specs: DataFrame, most_mb_a_core: int = 16 * 1024) -> DataFrame:
    """specs with the names of the checks that fail; those of an unknown partition fail by their time."""
    limits = specs.sparkSession.createDataFrame(PARTITIONS, "partition string, most_minutes int, most_nodes int, most_cores int")
    met = specs.join(F.broadcast(limits), "partition", "left")
    return met.select(*specs.columns, violations(spec_checks(most_mb_a_core)).alias("failing"))
