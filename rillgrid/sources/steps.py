"""Tables that a job keeps between its steps, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all run on one machine (tests); on a cluster an unset
    folder is an error, since each machine would write to its own disk."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, done_with: list[DataFrame] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors. done_with:
    stored tables that nothing reads after this one is written; they are deleted."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    delete(*(done_with or []))
    return out


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own readers see them."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def delete(*tables: DataFrame) -> None:
    """Deletes stored tables, by whatever file system they are in."""
    for one in tables:
        if path := getattr(one, "stored_at", None):
            place, system = file_system(one.sparkSession, path)
            system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, system = file_system(spark, path)
    return system.exists(place)


def iterate(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, folder: str, every: int = 10) -> DataFrame:
    """step() applied `rounds` times, with the state written to folder every so many rounds and at the end. A second call with
    the same folder goes on from the last state that was written whole; states before it are left for the reader to clear."""
    spark = start.sparkSession
    done = max([r for r in range(every, rounds + 1) if (r % every == 0 or r == rounds) and exists(spark, f"{folder}/round-{r}/_SUCCESS")], default=0)
    state = spark.read.schema(start.schema).parquet(f"{folder}/round-{done}") if done else start
    for r in range(done + 1, rounds + 1):
        state = step(state, r)
        if r % every == 0 or r == rounds:
            state.write.mode("overwrite").parquet(f"{folder}/round-{r}")
            state = spark.read.schema(start.schema).parquet(f"{folder}/round-{r}")
    return state
