"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the frequent form of each.

1. Words are maximal runs of letters, A-Z in lower case, counted over all rows. Some runs lose a code point first, as a checksum
   of id and run says (EVERY; 0 for none), which plants variants.
2. The vocabulary's words go into blocked Bloom filters, one for each length, of BITS a word; a word's four bits lie in one block
   of 64. The filters of PART words (FILTER_BYTES) are sent at once; a larger vocabulary is sent part after part.
3. Of each word all deletions and all replacements by a later letter are probed in the filters, in arrays of hashes; an insertion
   is the other word's deletion. Only what a filter admits becomes a string and meets the vocabulary in a join, which drops the
   false positives. Each pair is found once and counts for both words.
4. A word's form is its near word of largest n (ties: the smallest), if that is RATIO times as frequent; its root is where the
   forms end. Counts grow along forms, so pointers are doubled until none moves.

Cases: null and empty texts have no words; repeated rows count each; a null id is written as an empty string; runs and words may
be very long (they are probed in slices); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_batches, stored, table
from .shingles import MULTIPLIER, mixed

RUN = "[A-Za-zÀ-ÿ]"
EVERY, LEAST_CHARS, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Bits of a filter for each word, and the bytes of filters that are sent at once.
BITS, FILTER_BYTES = 16, 8 << 20
#: Hashes that a task makes at a time.
PROBES = 1 << 20
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def words_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = EVERY, least: int = LEAST_CHARS) -> DataFrame:
    """(word), a row for each occurrence."""
    # a deletion only shortens a run, so shorter runs are left out at once
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least},}})"), 1)).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    low = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if not every:
        return low.select("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    place = F.pmod("h", F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
    return low.withColumn("h", h).select(F.when(F.pmod("h", F.lit(every)) == 0, less).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _values(codes: np.ndarray) -> np.ndarray:
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER))


def _powers(n: int) -> np.ndarray:
    row = np.full(n, MULTIPLIER, np.uint64)
    row[:1] = 1
    return np.cumprod(row)


def _by_length(words: list[str]):
    """(indices, matrix of code points) of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block and the four bits in it of each word's hash (its polynomial of code points)."""
    h = mixed(hashes)
    mask = np.zeros_like(h)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64), mask


class Filters:
    """The filters of some words, by length."""

    def __init__(self, starts: dict[int, tuple[int, int]], bits: np.ndarray):
        self.starts, self.bits = starts, bits

    def admits(self, length: int, hashes: np.ndarray) -> np.ndarray:
        if length not in self.starts:
            return np.zeros(hashes.shape, bool)
        start, blocks = self.starts[length]
        block, mask = _place(hashes, blocks)
        return self.bits[start + block] & mask == mask


def filters(words: DataFrame) -> Filters:
    """Made by Spark, block by block; the driver gets a row a block, of FILTER_BYTES / 8 blocks and a block a length at most."""
    counts = {r.size: r["count"] for r in words.groupBy(F.char_length("word").alias("size")).count().collect()}
    blocks = {size: max(1, -(-n * BITS // 64)) for size, n in counts.items()}
    starts, at = {}, 0
    for size in sorted(blocks):
        starts[size], at = (at, blocks[size]), at + blocks[size]

    def run(batches):
        for batch in batches:
            for _, codes in _by_length(batch.column("word").to_pylist()):
                start, many = starts[codes.shape[1]]
                block, mask = _place((_values(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64), many)
                yield pa.RecordBatch.from_arrays([pa.array(start + block), pa.array(mask.view(np.int64))], ["block", "bits"])

    rows = words.select("word").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(max(1, at), np.uint64)
    bits[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filters(starts, bits)


def _deleted(codes: np.ndarray, found: Filters):
    """(row, place) of the deletions that the filters admit; of equal neighbours the first stands for both."""
    rows, size = codes.shape
    if size - 1 not in found.starts:
        return
    step = max(1, PROBES // size)
    for lo in range(0, rows, step):
        part = codes[lo : lo + step]
        terms = _values(part) * _powers(size)
        sums = np.cumsum(terms, axis=1, dtype=np.uint64)
        hashes = (sums - terms) + (sums[:, -1:] - sums) * np.uint64(INVERSE)
        ok = found.admits(size - 1, hashes)
        ok[:, 1:] &= part[:, 1:] != part[:, :-1]
        for row, place in zip(*np.nonzero(ok)):
            yield lo + row, place


def _replaced(codes: np.ndarray, letters: np.ndarray, found: Filters):
    """(row, place, letter) of the replacements by a later letter that the filters admit."""
    rows, size = codes.shape
    power, values = _powers(size), _values(letters)
    wide = max(1, PROBES // len(letters))
    step = max(1, wide // size)
    for lo in range(0, rows, step):
        part = codes[lo : lo + step]
        own = _values(part)
        whole = (own * power).sum(axis=1, dtype=np.uint64)
        for at in range(0, size, wide):  # a very long word in slices
            places = slice(at, at + wide)
            change = (values - own[:, places, None]) * power[places, None]
            ok = found.admits(size, whole[:, None, None] + change) & (letters > part[:, places, None])
            for row, place, letter in zip(*np.nonzero(ok)):
                yield lo + row, at + place, letter


def _probed(words: DataFrame, letters: str, found: Filters) -> DataFrame:
    """(word, n, near) that the filters admit; each pair of words once."""
    sent, codes_of = words.sparkSession.sparkContext.broadcast(found), np.array([ord(c) for c in letters], np.uint32)

    def run(batches):
        for batch in batches:
            listed = batch.column("word").to_pylist()
            rows, near = [], []
            for at, codes in _by_length(listed):
                for row, place in _deleted(codes, sent.value):
                    w = listed[at[row]]
                    rows.append(at[row])
                    near.append(w[:place] + w[place + 1 :])
                for row, place, letter in _replaced(codes, codes_of, sent.value):
                    w = listed[at[row]]
                    rows.append(at[row])
                    near.append(w[:place] + letters[letter] + w[place + 1 :])
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("word"), taken.column("n"), pa.array(near, pa.string())], ["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of a stored vocabulary, each pair from both sides."""
    letters = "".join(sorted(r.c for r in vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()))  # letters of RUN only
    parts = max(1, -(-vocab.count() * BITS // (8 * FILTER_BYTES)))
    pairs = None
    for part in range(parts):
        held = vocab.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        met = _probed(vocab, letters, filters(held)).join(held.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = stored(pairs.select("word", "n", "near", "near_n"), "near-words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): where the forms end."""
    at = stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots", [at])
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = stored(moved.select("word", "root"), "word-roots", [moved])


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    small_batches(vocab.sparkSession)
    vocab = stored(vocab, "vocabulary")
    near = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("top"))
    near = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("top.less") >= ratio * F.col("n"), F.col("top")).alias("top"))
    near = stored(near.select("word", "n", "n_near", F.col("top.near").alias("form"), (-F.col("top.less")).alias("form_n")), "word-forms")
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents; null and empty texts have no words."""
    return variants(vocabulary(words_of(table(spark, sf_dir, "documents").select("doc_id", "text"))))


OP12_SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT CAST(i AS BIGINT) AS i FROM range(0, 256) AS r(i))),
hexed AS (SELECT doc_id, run, times, hex(encode(concat(doc_id, ':', run))) AS x FROM each),
crc AS (SELECT doc_id, run, times, xor(list_reduce(list_transform(range(-1, length(x) // 2), lambda i: CASE WHEN i < 0 THEN 4294967295 ELSE CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT) END), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM hexed, t),
changed AS (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT DISTINCT word, n, i * mark AS i, substr(word, 1, i) || substr(word, i + 2) AS k, mark FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v), range(0, 2) AS m(mark)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.mark = 1 AND b.mark = 1 AND a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.mark = 0 AND v.word = c.k UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.mark = 0 AND v.word = c.k),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS stop FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.stop WHERE f.form IS NOT NULL)
SELECT f.word, form, stop AS root, n, n_near, form_n FROM f JOIN walk USING (word) WHERE stop IN (SELECT word FROM f WHERE form IS NULL)
"""
