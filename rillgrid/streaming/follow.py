"""Streams over growing folders: follow files, windowed sums with watermarks, resume from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def follow_table(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, length: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and exact sum by window and key; rows later than the watermark drop out."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    window = F.window("_t", length, step) if step else F.window("_t", length)
    return timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,4)")).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is there and stops; the next call goes on from the checkpoint."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
