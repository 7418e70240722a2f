"""Graded answers: grading, running totals, summaries, result documents and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import percent, stripped
from .lines import row_index

#: The least percentage of each band.
BANDS = [(100, "perfect"), (85, "excellent"), (70, "good"), (50, "fair")]


def grade(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """(student, q, correct, category): letters are compared without case; a fill-in answer is right if it contains an
    accepted string. The bank is a dimension of fixed size."""
    answer = stripped(F.col("answer"))
    fill = F.exists("accepted", lambda a: F.contains(F.lower(answer), F.lower(a)))
    letter = F.upper(answer) == F.upper(F.get("accepted", F.lit(0)))
    joined = responses.join(bank, "q")
    return joined.select("student", "q", F.coalesce(F.when(F.col("kind") == "fill", fill).otherwise(letter), F.lit(False)).alias("correct"), "category")


def running_score(answers: DataFrame, who: str, order: str, correct: Column, bins: int = 64) -> DataFrame:
    """score and total up to each answer in its student's order. Answers are numbered over all students, cut into ranges of the
    numbers, summed within a range and student, and shifted by the sums of the ranges before, so that no window holds a student."""
    rows = row_index(answers.withColumn("_ok", correct.cast("int")), order, name="_at")
    size = F.lit(max(1, -(-answers.count() // bins)))
    rows = rows.withColumn("_bin", F.floor((F.col("_at") - 1) / size))
    sums = rows.groupBy(who, "_bin").agg(F.sum("_ok").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(who).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows a student
    before = sums.select(who, "_bin", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("_s"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(who, "_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [who, "_bin"]).withColumn("score", (F.coalesce(F.sum("_ok").over(inside), F.lit(0)) + F.col("_s")).cast("long"))
    return out.withColumn("total", F.count(F.lit(1)).over(inside) + F.col("_n")).drop("_ok", "_at", "_bin", "_s", "_n")


def band(pct: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(BANDS):
        out = F.when(pct >= least, name).otherwise(out)
    return out


def summary(answers: DataFrame, by: str, correct: Column) -> DataFrame:
    right, total = F.sum(correct.cast("int")), F.count(F.lit(1))
    out = answers.groupBy(by).agg(right.cast("long").alias("correct"), total.alias("total"))
    return out.withColumn("pct", percent(F.col("correct"), F.col("total"))).withColumn("band", band(F.col("pct")))


def result_document(answers: DataFrame, who: str) -> DataFrame:
    """One nested document a student from (who, q, correct, category). It holds all the student's answers, so the number of
    questions bounds it; for groups without such a bound keep the answers as rows and take summary()."""
    categories = answers.groupBy(who, "category").agg(F.sum(F.col("correct").cast("int")).cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    maps = categories.groupBy(who).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("correct", "total"))))).alias("categories"))
    lists = answers.groupBy(who).agg(F.sum(F.col("correct").cast("int")).cast("long").alias("score"), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("q", "correct", "category"))).alias("answers"))
    return lists.join(maps, who).withColumn("percentage", percent(F.col("score"), F.col("total")))


def leaderboard(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows with a name, best percentage first, then the shorter time; duplicates stay. Null, empty and the number 0 are no names."""
    name = F.col("name") != "" if dict(rows.dtypes)["name"] == "string" else F.col("name") != 0
    return rows.where(F.coalesce(name, F.lit(False))).orderBy(F.desc("pct"), F.asc("time"), *ties)


def report_line(name: Column, correct: Column, total: Column, width: int = 20) -> Column:
    """A text bar for a report."""
    filled = F.floor(correct * width / total).cast("int")
    return F.concat(F.rpad(name, 24, " "), F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled), F.format_string(" %d/%d", correct, total))
