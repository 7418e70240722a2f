"""Ordered records: numbering, counting, collapsing, sorting, batching and comparing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments


def row_index(df: DataFrame, *order: str, name: str = "row", start: int = 1) -> DataFrame:
    """Consecutive numbers in the given order without a global window: rows are cut into ranges of the first column at fixed
    bounds, numbered within their range and shifted by the counts before it (a bound and a count a range reach the driver).
    Ties need a unique last column; equal values of the first one share a range."""
    parts, first = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order[0]
    # once found, the bounds are literals: range sampling differs from run to run
    ranges = df.select(first).repartitionByRange(parts, first).groupBy(F.spark_partition_id().alias("p")).agg(F.min(first).alias("low"))
    bounds = [r.low for r in ranges.collect() if r.low is not None]
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(first))) if bounds else F.lit(0)
    ranged = df.withColumn("_part", F.when(F.col(first).isNull(), 0).otherwise(at))
    counts = dict(ranged.groupBy("_part").count().collect())
    shift, total = {}, start - 1
    for p in sorted(counts):
        shift[p], total = total, total + counts[p]
    before = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in shift.items() for x in kv]), F.col("_part").cast("long")) if shift else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (before + within).cast("long")).drop("_part")


def count_lines(df: DataFrame, value: str) -> DataFrame:
    """Lines, words and bytes (with one line end a line)."""
    words = F.when(F.trim(value) == "", 0).otherwise(F.size(F.split(F.trim(value), r"[ \t]+")))
    return df.agg(F.count(F.lit(1)).alias("lines"), F.sum(words).cast("long").alias("words"), (F.sum(F.octet_length(value)) + F.count(F.lit(1))).cast("long").alias("bytes"))


def line_frequency(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("value"))


def collapse_adjacent(df: DataFrame, value: str, order: str, *group: str) -> DataFrame:
    """Keeps a row if its value differs from the row before it in its group; not distinct(). Groups are numbered in ranges and cut into
    bins, and a bin's first row meets the last one of the bin before, so that no task holds a whole group."""
    grouped = df.withColumn("_group", F.to_json(F.struct(*group)) if group else F.lit(""))  # a null is told from an empty text
    before = {"_before": F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_group", "_bin").orderBy("_number"))}
    met = segments.framed(segments.numbered(grouped, "_group", order, "_number"), "_group", "_number", 1, before)
    return met.where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_before", "_number", "_group")


def fields(value: Column, *places: int) -> list[Column]:
    """White-space separated fields by 1-based place; a text of blanks has one empty field."""
    parts = F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+")
    return [F.get(parts, F.lit(p - 1)).alias(f"f{p}") for p in places]


def split_fields(value: Column, sep: str, n: int) -> list[Column]:
    """n fields f1, f2, ... by a delimiter; the last one takes what is left, with its delimiters. Missing ones are null."""
    parts = F.split(value, re.escape(sep), n)
    return [F.get(parts, F.lit(i)).alias(f"f{i + 1}") for i in range(n)]


def last(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in an order without ties."""
    return df.orderBy(F.desc(order)).limit(n)


def usage(files: DataFrame, by: str, size: str) -> DataFrame:
    """How many files a group has, and their bytes together."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


def search(df: DataFrame, keys: list[str], text: str, pattern: str, end: str = "\n") -> DataFrame:
    """(keys, line, value): the lines of all texts that match, by 1-based place."""
    places = df.select(*keys, F.posexplode(F.split(text, re.escape(end), -1)).alias("line", "value"))
    return places.where(F.col("value").rlike(pattern)).select(*keys, (F.col("line") + 1).alias("line"), "value")


def above(value: Column, limit: float) -> Column:
    """Strictly above the limit; false for what is no number."""
    return F.coalesce(value.try_cast("double") > limit, F.lit(False))


def rows_of_tasks(tasks: DataFrame, rows: DataFrame, task: str, row: str) -> DataFrame:
    """Each task with the row of its number; null beyond the rows."""
    return tasks.join(rows, tasks[task] == rows[row], "left").drop(rows[row])


def check_counts(expected: DataFrame, found: DataFrame, key: str, count: str) -> DataFrame:
    """Expected and found numbers a key; complete from the expected number on."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    met = expected.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return met.withColumn("status", F.when(F.col("found") >= F.col(count), "complete").otherwise("incomplete"))


def copy_plan(source: DataFrame, target: DataFrame, key: str, time: str) -> DataFrame:
    """What a copy would do that does not touch what is as new at the target: new, newer or keep."""
    s, t = source.select(key, F.col(time).alias("source_time")), target.select(key, F.col(time).alias("target_time"))
    action = F.when(F.col("target_time").isNull(), "new").when(F.col("source_time") > F.col("target_time"), "newer").otherwise("keep")
    return s.join(t, key, "left").withColumn("action", action)


def numeric_order(value: Column) -> Column:
    """Sort key that counts what is no number as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def in_batches(df: DataFrame, row: str, size: int, legacy: bool = False) -> DataFrame:
    """batch and place of each 1-based row. legacy numbers batches as row // size, which leaves the first one short."""
    n = F.col(row) if legacy else F.col(row) - 1
    return df.withColumn("batch", F.floor(n / size).cast("long")).withColumn("place", F.pmod(n, F.lit(size)).cast("long"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of one side only, with their side; repeated lines count."""
    return a.exceptAll(b).withColumn("side", F.lit("<")).unionByName(b.exceptAll(a).withColumn("side", F.lit(">")))


def manifest_difference(source: DataFrame, target: DataFrame, key: str, size: str) -> DataFrame:
    """Full comparison of two manifests: missing on a side, of another size, or equal."""
    s, t = source.select(key, F.col(size).alias("source_size")), target.select(key, F.col(size).alias("target_size"))
    status = F.when(F.col("target_size").isNull(), "missing").when(F.col("source_size").isNull(), "extra").when(F.col("source_size") != F.col("target_size"), "differs").otherwise("equal")
    return s.join(t, key, "full").withColumn("status", status)
