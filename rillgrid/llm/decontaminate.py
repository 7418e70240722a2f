"""Benchmark decontamination by SimHash of item-sized windows.

An item of L words is compared with the windows of L words of each document, as weighted sets of w-word shingles (w = 5; an
item of fewer words is one shingle): similarity = sum of lower / sum of higher weighted counts, a shingle's weight being
1 + ln(items / items that have it). Items at 0.8 or more are reported. A document of fewer words than the item is one window,
and n_words are its own.

Windows get 64-bit SimHashes of their weighted shingles, and a multi-index of four 16-bit blocks finds every item whose
fingerprint lies within RADIUS bits: by the pigeonhole principle such a fingerprint differs in at most RADIUS // 4 bits in some block,
and a window asks each block's index for every value that near its own. Candidates are then verified exactly. Only windows that hold a shingle of an
item that they are compared with are hashed; others have similarity 0. (A window at similarity 0.8 exactly lies beyond 15 bits in about 2
of 100 cases; neighbouring windows of a longer copy give it further chances, exact copies lie at 0 bits.)

Items are sent to the executors in blocks of about ITEM_BYTES of text, each in a pass of its own; documents are never shuffled.
A block's index takes 1 MB and 16 bytes an item; its shingles take about 100 bytes a word.
Weights are those of the whole benchmark in every pass: with several, each gets the number of items and the counts of all
shingles that two or more items have (the others weigh the same as unseen ones), also of those that only other blocks' items
have, since windows hold them too. That is 16 bytes for each such shingle, not bounded by ITEM_BYTES.

Cases: null, empty and blank items match nothing, as do such texts; rows without id are reported with a null id; repeated
rows and items are reported each; empty tables give an empty result; other columns are ignored. Texts are read whole, very long
ones too. drop_leaking() names rows by id and text, so that rows without id go like others, and rows that only share the id stay.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_rows, key128, small_batches, stored, table
from .shingles import batches_of, distinct, polynomial, sequences, word_hashes

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
ITEM_BYTES = 4 << 20
SCALE = 256
LINK_FIELDS = ["item_id", "first_word", "n_words", "similarity"]
BITS = np.arange(64, dtype=np.uint64)
#: Windows that ask the index at a time.
PROBES = 1024


def near_values(radius: int, bits: int = 16) -> np.ndarray:
    """All masks with at most radius of the bits set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of `size` shingles from each start; weights are whole numbers, so sums are exact."""
    signs = np.where((shingles[:, None] >> BITS) & np.uint64(1), weights[:, None], -weights[:, None])
    sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs, axis=0)])
    return (((sums[starts + size] - sums[starts]) > 0).astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


class Items:
    """A block of benchmark items, made ready on the executors."""

    def __init__(self, rows: list[tuple[int, str]], words: int, similarity: float, radius: int, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        """whole: of the benchmark that rows are a block of, frequencies(); without it rows are the benchmark."""
        self.words, self.similarity, self.radius = words, similarity, radius
        hashes, at = word_hashes(pa.array([t for _, t in rows], pa.string()))
        self.items, self.sizes = [], defaultdict(list)
        for (item, _), a, b in zip(rows, at[:-1].tolist(), at[1:].tolist()):
            if b > a:
                self.sizes[b - a].append(len(self.items))
                self.items.append((item, b - a, polynomial(hashes[a:b], min(words, b - a))))
        seen = Counter(s for *_, sh in self.items for s in set(sh.tolist()))
        self.known = np.array(sorted(seen), np.uint64)
        if whole is None:
            shared = np.array(sorted(s for s, n in seen.items() if n > 1), np.uint64)
            whole = len(self.items), shared, np.array([seen[s] for s in shared.tolist()], np.int64)
        total, self.shared, have = whole
        self.rare = round(SCALE * (1 + math.log(max(1, total))))
        self.weight = np.array([round(SCALE * (1 + math.log(total / n))) for n in have.tolist()], np.int64)
        self.counts = [Counter(sh.tolist()) for *_, sh in self.items]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known % np.uint64(1 << 20)).astype(np.int64)] = True
        self.holders = defaultdict(set)  # the sizes of the items that hold a shingle
        for _, size, sh in self.items:
            for s in sh.tolist():
                self.holders[s].add(size)
        self.prints = np.array([fingerprints(sh, self.weights(sh), np.array([0]), len(sh))[0] for *_, sh in self.items], np.uint64)
        self.masks, self.size_of = near_values(radius // BLOCKS), np.array([size for _, size, _ in self.items], np.int64)
        self.index = []  # by block: where each value's items begin (one more at the end), and the items in the order of their values
        for block in range(BLOCKS):
            own = self._block(self.prints, block)
            begin = np.zeros((1 << 16) + 1, np.int32)
            np.cumsum(np.bincount(own, minlength=1 << 16), out=begin[1:])
            self.index.append((begin, np.argsort(own, kind="stable").astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(shingles), self.rare, np.int64)
        place = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[place] == shingles, self.weight[place], self.rare)

    def similar(self, item: int, shingles: np.ndarray) -> float:
        a, b = self.counts[item], Counter(shingles.tolist())
        every = list(a | b)
        weight = dict(zip(every, self.weights(np.array(every, np.uint64)).tolist()))
        low = sum(min(n, b[s]) * weight[s] for s, n in a.items())
        high = sum(n * weight[s] for s, n in a.items()) + sum(n * weight[s] for s, n in b.items()) - low
        return low / high

    def candidates(self, size: int, prints: np.ndarray):
        """(index of a fingerprint, item) within the radius, each once."""
        pairs = set()
        for at in range(0, len(prints), PROBES):
            some = prints[at : at + PROBES]
            for block, (begin, items) in enumerate(self.index):
                asked = (self._block(some, block)[:, None] ^ self.masks).ravel()
                lo, n = begin[asked], begin[asked + 1] - begin[asked]
                hit = np.flatnonzero(n)
                lo, n = lo[hit], n[hit]
                which = np.repeat(hit // len(self.masks), n)
                found = items[np.arange(len(which)) + np.repeat(lo - (np.cumsum(n) - n), n)]
                near = (np.bitwise_count(some[which] ^ self.prints[found]) <= self.radius) & (self.size_of[found] == size)
                pairs.update(zip((at + which[near]).tolist(), found[near].tolist()))
        return sorted(pairs)

    def matches(self, words: np.ndarray, by_width: dict[int, tuple[np.ndarray, np.ndarray]]):
        """(item id, first word, words, similarity) of one text: each item's best window, the first of equals; of a text
        shorter than the item the whole text."""
        best: dict[int, tuple] = {}
        for width, (shingles, hits) in by_width.items():
            starts = defaultdict(set)
            for hit in hits.tolist():
                for size in self.holders[int(shingles[hit])]:
                    if min(self.words, size) == width:
                        length = min(size, len(words))
                        starts[size].update(range(max(0, hit - length + width), min(hit, len(words) - length) + 1))
            for size, some in starts.items():
                first = np.array(sorted(some), np.int64)
                n = min(size, len(words)) - width + 1
                for run in np.split(first, np.flatnonzero(np.diff(first) > n) + 1):
                    part = shingles[run[0] : run[-1] + n]
                    prints = fingerprints(part, self.weights(part), run - run[0], n)
                    for w, item in self.candidates(size, prints):
                        at = int(run[w])
                        if (how := self.similar(item, shingles[at : at + n])) >= self.similarity and (how, -at) > best.get(item, (-1.0, 0)):
                            best[item] = (how, -at)
        return [(self.items[i][0], -at, min(self.items[i][1], len(words)), how) for i, (how, at) in best.items()]

    def search(self, texts: pa.Array):
        """matches() of each text of a batch that has any, with its place in the batch."""
        if not self.items:
            return
        words, at = word_hashes(texts)
        widths = sorted({min(self.words, s) for s in self.sizes})
        lists = {}
        for width in widths:
            if len(words) >= width:
                shingles = polynomial(words, width)
                maybe = np.flatnonzero(self.filter[(shingles % np.uint64(1 << 20)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
                lists[width] = shingles, maybe[self.known[place] == shingles[maybe]]
        some = np.unique(np.concatenate([np.searchsorted(at, hits, "right") - 1 for _, hits in lists.values()])) if lists else []
        for doc in some:
            a, b = at[doc], at[doc + 1]
            own = {}
            for width, (shingles, hits) in lists.items():
                inside = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b - width + 1)] - a
                if b - a >= width and len(inside):
                    own[width] = shingles[a : b - width + 1], inside
            for row in self.matches(words[a:b], own):
                yield int(doc), row


def frequencies(items: DataFrame, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a benchmark (item, text): the items with words, the shingles that two or more of them have, ascending, and how many have each."""

    def run(batches):
        for batch in batches:
            for _, texts in batches_of(batch.column(0)):
                lists = [distinct(s).view(np.int64) for s in sequences(texts, words) if len(s)]
                if lists:
                    ends = np.cumsum([0, *map(len, lists)])
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int64()))], ["tokens"])

    made = stored(items.select("text").mapInArrow(run, "tokens array<long>"), "item-shingles")
    counts = made.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1").toArrow()
    token, have = counts.column("token").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(token)
    return made.count(), token[order], have[order]


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): each document's best window of each item that it holds."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(named, benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")), words, similarity, radius)


def _found(docs: DataFrame, benchmark: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """The links of docs(keys ..., text), with their keys, to benchmark(item, text)."""
    spark, keys = docs.sparkSession, docs.columns[:-1]
    small_batches(spark)
    names = [*keys, *LINK_FIELDS]
    types = [pa.int64()] * (len(names) - 1) + [pa.float64()]
    items = benchmark.select("item", F.coalesce("text", F.lit("")).alias("text"))
    passes = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    whole = spark.sparkContext.broadcast(frequencies(items, words) if passes > 1 else None)
    found = None
    for one in range(passes):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == one).orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        made: dict[int, Items] = {}

        def search(batches, sent=sent, made=made):
            if 0 not in made:
                made[0] = Items(sent.value, words, similarity, radius, whole.value)
            for batch in batches:
                ids = list(zip(*[batch.column(c).to_pylist() for c in keys]))
                for at, texts in batches_of(batch.column("text")):
                    rows = [(*ids[at + doc], *row) for doc, row in made[0].search(texts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        part = docs.mapInArrow(search, ", ".join(f"{c} long" for c in names[:-1]) + f", {names[-1]} double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    k1, k2 = key128(F.col(id_col), F.col(text_col))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    return drop_rows(docs, _found(keyed, items, words, similarity, radius).select("k1", "k2"), text_col, id_col)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
