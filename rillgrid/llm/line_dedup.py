"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, docs): a line key's 128-bit hash and in how many documents of its batch it is, hash
partitioned and sorted. Each batch is merge-anti-joined with the runs: keys that are known to be in `enough` documents are
settled, and the batch adds a run of the others at level 0; when a level holds `fan_in` runs they are merged into one run of the
next level, so a line hash is rewritten a logarithmic number of times and a very common one not at all. At last the keys
that reached `enough` documents are found in the lines, and their lines lose their place.

The texts are read twice: once to write all lines as hashes, by batch, and once to drop lines. All between works on hashes.

A line's key is the line without ASCII blanks at both ends, A-Z in lower case. The empty key is never common.

Cases: a null or empty text is one empty line; each row counts as a document, repeated rows too, and a line counts once a
row; a document that loses all lines has the empty text; null ids are allowed; an empty table gives an empty result; very long
texts are split whole, and their lines are rows of their own. n_lines and n_dropped are made new where documents have columns of
these names; other columns stay as they are, whatever their names (names that begin with `_line_` are taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, key128, new_folder, stored

#: A very common line is dealt out over this many parts of a join.
SALTS = 32
#: A document's name: two hashes of its id and text.
NAME = ["_line_doc", "_line_doc2"]


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def named(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.withColumns(dict(zip(NAME, key128(F.col(id_col), F.col(text_col)))))


def hashed_lines(docs: DataFrame, min_chars: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, document's name, place, h1, h2): the lines whose key has min_chars or more (1 at least). row tells equal rows apart,
    and is only the same each time once the result is written."""
    rows = named(docs, text_col, id_col).withColumn("row", F.monotonically_increasing_id())
    places = rows.select("row", *NAME, F.posexplode(F.transform(line_array(F.col(text_col)), line_key)).alias("place", "key"))
    h1, h2 = key128(F.col("key"))
    return places.where(F.char_length("key") >= max(1, min_chars)).select("row", *NAME, "place", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """The runs of all batches so far, in a folder that executors share. enough: the documents from which on a key is settled
    and no longer counted; None counts all."""

    SCHEMA = "h1 long, h2 long, docs long"

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = 4, min_chars: int = 1, enough: int | None = None):
        self.spark, self.folder, self.fan_in, self.min_chars, self.enough = spark, folder or new_folder(spark, "line-runs"), fan_in, min_chars, enough
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{self.made}"
        self.made += 1
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-joins a batch's lines(row, h1, h2) with the settled keys, adds a run of the rest, and compacts full levels."""
        counts = lines.groupBy("h1", "h2").agg(F.countDistinct("row").alias("docs"))
        if self.enough is not None and self.made:
            counts = counts.join(self.known(self.enough).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1

    def totals(self) -> DataFrame:
        """(h1, h2, docs) over all runs; of settled keys docs is only known to be enough."""
        return self._merged([path for level in self.levels for path in level])

    def known(self, min_docs: int) -> DataFrame:
        """(h1, h2) of the keys that the runs have in at least min_docs documents."""
        return self.totals().where(F.col("docs") >= min_docs).select("h1", "h2")

    def places(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """(document's name, _line_dropped): the sorted places of its lines whose key is known(min_docs); equal rows share a list."""
        common = self.known(min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = lines.select(*NAME, "place", "h1", "h2", F.pmod(NAME[0], F.lit(SALTS)).cast("int").alias("salt"))
        found = salted.join(common.hint("merge"), ["h1", "h2", "salt"], "left_semi")
        return found.groupBy(*NAME).agg(F.array_sort(F.collect_set("place")).alias("_line_dropped"))


def without_lines(docs: DataFrame, places: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """docs with _line_all, the lines of each text, _line_dropped, and the text without the lines at these places."""
    met = named(docs, text_col, id_col).join(places, NAME, "left").drop(*NAME).withColumn("_line_all", line_array(F.col(text_col)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_line_all") - 1), "_line_dropped")
    text = F.when(F.col("_line_dropped").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_line_all", i)), "\n"))
    return met.withColumn("_line_text", text)


def count_batches(docs: DataFrame, batches: int, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id", enough: int | None = None) -> tuple[LineRuns, DataFrame]:
    """The runs of a whole table that comes in as many batches, dealt by a hash of id and text, and the stored lines."""
    runs, path = LineRuns(docs.sparkSession, min_chars=min_chars, enough=enough), new_folder(docs.sparkSession, "lines")
    hashed_lines(docs, min_chars, text_col, id_col).withColumn("batch", F.pmod(NAME[1], F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema("row long, _line_doc long, _line_doc2 long, place int, h1 long, h2 long, batch int").parquet(path)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    return runs, lines


def drop_common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, text_col: str = "text", id_col: str = "doc_id", counts: bool = True) -> DataFrame:
    """docs with text_col lacking all lines whose key is in at least min_docs documents of the whole table, and (counts) with n_lines
    (before) and n_dropped."""
    runs, lines = count_batches(docs, batches, min_chars, text_col, id_col, enough=min_docs)
    met = without_lines(docs, runs.places(lines, min_docs), text_col, id_col)
    added = [F.size("_line_all").cast("long").alias("n_lines"), F.coalesce(F.size("_line_dropped"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    others = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return met.select(*[F.col("_line_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in others], *added)


def dedup_stream_batch(runs: LineRuns, batch: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One batch of an incremental run: its lines that an earlier batch had are dropped, then its own lines join the runs.
    The result is stored before the runs change."""
    lines = stored(hashed_lines(batch, runs.min_chars, text_col, id_col), "batch-lines")
    met = without_lines(batch, runs.places(lines, 1), text_col, id_col)
    out = stored(met.select(*[F.col("_line_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in batch.columns]), "line-batch")
    runs.add(lines)
    return out
