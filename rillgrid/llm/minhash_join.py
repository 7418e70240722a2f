"""Near duplicates by circulant MinHash.

1. A document's set holds its distinct w-word shingles. A first permutation puts each shingle at one of UNIVERSE places, and
   coordinate k of the signature is the least value of a second permutation, shifted by k places, over them: two permutations
   and BANDS * ROWS shifts. The values that a place takes in all coordinates lie side by side in one table.
2. Signatures are cut into BANDS bands of ROWS coordinates. Documents that agree in a band and pass the filter by size are
   candidates. At 85 % two sets miss each other in all bands with a probability of (1 - 0.85^6)^40, about 6e-9.
3. Candidates are verified on their whole sets, and links give components. Classes of equal sets, groups of equal bands, and
   bands that very many documents share are treated as NgramJoin treats classes, prefixes and frequent shingles: each document
   of a crowded band first meets one centre, and only what lies in different components after that, and whose masks allow a
   link, is compared further. So copies and near copies do not make all their pairs, and no candidate is dropped.

Cases: null, empty and blank texts have empty sets, link with nothing and stay; repeated rows are equal texts, and of equal
ids all rows are kept; rows without an id take part, and stay only where their component has no id; an empty table gives an
empty result; other columns are ignored. Texts are read whole; of more than UNIVERSE shingles many share places, which makes
more candidates, not fewer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ngram_join import NgramJoin, join_sql
from .shingles import MULTIPLIER, mixed

ROWS, BANDS = 6, 40
UNIVERSE = 1 << 22
SEED = 20_240_607
#: Shingles whose rows of the table are looked up at a time.
STEP = 2048


@lru_cache(maxsize=1)
def shifted(coordinates: int) -> np.ndarray:
    """Row p: the second permutation's values at places p, p + 1, ... around the circle, one for each coordinate (a view of 16 MB)."""
    values = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """The least values of a set of hashes, which is not empty."""
    places = (mixed(shingles ^ np.uint64(SEED)) >> np.uint64(64 - 22)).astype(np.int64)  # the first permutation
    rows, least = shifted(coordinates), np.full(coordinates, UNIVERSE, np.uint32)
    for at in range(0, len(places), STEP):
        np.minimum(least, rows[places[at : at + STEP]].min(axis=0), out=least)
    return least


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band and its number."""
    least = signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * np.uint64(MULTIPLIER) + least[:, i])
    return out


class MinHashJoin(NgramJoin):
    """The join with bands in place of prefixes."""

    def _prefixes(self):
        return lambda s: (bands(s), s[:0])

    def _pass(self, a: str, b: str):
        """The filter by size; a band says nothing of places in the set."""
        n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
        return 100 * F.least(n1, n2) >= self.percent * F.greatest(n1, n2)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    found = MinHashJoin(docs, words, percent, text_col, id_col).components()
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP13_SQL = join_sql(3, 85, ", d.doc_id = min(r.b) AS kept")
