"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import delete, new_folder, shared_folder, stored  # noqa: F401

#: ASCII white space of the word and line contracts: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of rows that Spark sends to a Python worker at a time; a batch of 10,000 long texts would be far more.
ARROW_BYTES, ARROW_DEFAULT = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ARROW_BYTES, where the user has left Spark's default; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == ARROW_DEFAULT:
        spark.conf.set(name, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter (8 MB), whatever the number of keys in it.
FILTER_BITS = 1 << 26


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with one function: bit h mod FILTER_BITS is set for each 64-bit hash h. It says no only for hashes that are
    not there; what it admits still has to be joined. The driver gets at most 2048 rows of 4 KB."""
    place = hashes.select((F.pmod(column, F.lit(FILTER_BITS)) + 1).alias("place"))
    rows = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow()
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def admits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter admits each hash (int64)."""
    place = hashes & (FILTER_BITS - 1)
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def admitted(hashes: Column, bits: np.ndarray, spark: SparkSession) -> Column:
    """admits() for a column of hashes; null is not admitted."""
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def said(column: pa.Array) -> pa.Array:
        return pa.array(admits(sent.value, column.fill_null(0).to_numpy(zero_copy_only=False)) & column.is_valid().to_numpy(zero_copy_only=False))

    return said(hashes)


def key128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns; together they stand for the value."""
    return [F.xxhash64(F.lit("k1"), *columns), F.xxhash64(F.lit("k2"), *columns)]


def drop_rows(docs: DataFrame, gone: DataFrame, text_col: str, id_col: str, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key128() of id and text is in gone(k1, k2); of those in again(k1, k2) one row stays. Only
    rows that a filter of fixed size admits meet the keys, so that texts that stay are not shuffled."""
    spark, names = docs.sparkSession, docs.columns
    again = None if again is None or again.isEmpty() else again
    every = gone if again is None else gone.unionByName(again)
    every = stored(every.distinct(), "row-keys")
    k1, k2 = key128(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    keyed = keyed.withColumn("asked", admitted(F.col("k1"), bit_filter(every, "k1"), spark))
    asked = keyed.where("asked").drop("asked")
    out = keyed.where("NOT asked").select("row.*").unionByName(asked.join(every.hint("merge"), ["k1", "k2"], "left_anti").select("row.*"))
    if again is not None:
        out = out.unionByName(asked.join(again.hint("merge"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*"))
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def give_back() -> None:
    """Returns memory that a worker has freed to the machine; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Seen(dict):
    """What a worker has worked out for short words. Bounded by bytes: when the young half is full it becomes the old one, whose
    words move back when they are met again; words over LONGEST bytes are kept for one batch only. It only saves work."""

    HALF_BYTES, LONGEST, ENTRY = 10 << 20, 100, 200

    def __init__(self):
        self.old, self.size, self.long = {}, 0, []

    def unknown(self, words) -> list:
        """The words that are in neither half; those of the old half become young again."""
        for word in self.long:
            self.pop(word, None)
        self.long = []
        if self.size > self.HALF_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        fresh = []
        for word in words:
            if word not in self:
                if (value := self.old.get(word)) is None:
                    fresh.append(word)
                else:
                    self.keep(word, value)
        return fresh

    def keep(self, word: str, value) -> None:
        self[word] = value
        if len(word) > self.LONGEST:
            self.long.append(word)
        else:
            self.size += self.ENTRY + len(word)


def runs_of(sizes: list[int], most: int):
    """Consecutive index ranges whose sizes add up to about `most` at most (one long item makes its own range)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)
