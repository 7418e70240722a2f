"""Exact BM25 top-k by an inverted index with block maxima, run per shard.

Terms are words (ASCII letters in lower case, parted by blanks and ASCII punctuation) as 64-bit hashes. The documents are split once,
into a stored table of each one's terms and counts. Global statistics come from it: the number of documents, their mean
length and each term's document frequency. Each task then indexes its documents in shards of SHARD_TERMS postings: postings hold a
term's impact in a document. A shard's documents are put into groups that share common terms (languages, mostly), by length within
them. The CROWDED longest lists of each group are a matrix, a row a document, with the highest impact of each block of BLOCK_DOCS
documents; only the other postings stay in lists.

Pruning is that of block-max WAND, with the pivot taken once a query and group: the crowded terms. A query comes with a score that k
documents reach for sure: the k-th best of a sample, then of all shards that the task has done. The lists of the other terms are added
up; a block is left out where its highest sum and its maxima of the crowded terms together stay below that score. Where they reach it,
the block's rows are multiplied with all queries that need it at once. Sums are in single precision and steps of STEP, rounded up, with
a margin of MARGIN; documents that reach the score within it are scored again from their own terms, always in the same order, so
results are those of scoring everything, and equal documents have equal scores. A task keeps the k best of its shards for each query,
and tasks' lists are merged. The sample grows with the root of the documents, so that it costs little and a task finds few documents
beyond the k best.

score = sum over the query's words (repeats count) of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)).
Equal scores go by the smaller id, ids before none.

Queries are sent in blocks of QUERY_BYTES, a pass over the stored terms each, so memory does not grow with their number; equal
queries of a block are searched once. The work is queries times documents by its nature. Documents are never shuffled but for the sample.

Cases: null and empty texts have no words: they are found by no query, and as queries they find nothing; only documents that
share a word are results, so there may be fewer than k; rows without id can be found but are no queries; repeated rows are
found each; an empty table gives an empty result; other columns are ignored. Texts are read whole, very long ones too.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, stored, table
from .shingles import batches_of, word_hashes
from .toxicity import PARTS

K1, B, K = 1.2, 0.75, 10
SHARD_TERMS, QUERY_BYTES = 1 << 20, 32 << 20
#: A shard's documents, places of documents filled up to whole blocks, are numbers of 16 bits; impacts are steps of 16 bits.
MOST_DOCS, STEP = 1 << 15, (K1 + 1) / 65535
BLOCK_DOCS, CROWDED, MARGIN = 64, 600, 1e-4
#: Groups of documents of a shard, and the terms that tell them apart.
GROUPS, COMMON = 4, 64
#: Queries whose lists are added up together, queries of a slice, which are searched together, and the scores of a slice at most.
TOGETHER, SLICE, SCORES = 8, 256, 1 << 21
#: The sample's documents: so many at least, and the root of so many times all documents.
SAMPLE_DOCS, SAMPLE_ROOT, SAMPLE_PARTS = 8192, 3000, 6
MERGE_PARTS = 64


def _counts(texts: pa.Array):
    """(text, term, times) for all texts of a batch, in order, and the texts' lengths in words."""
    words, at = word_hashes(texts, PARTS)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((words, doc))
    d, w = doc[order], words[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))) if len(w) else np.empty(0, np.int64)
    return d[new], w[new], np.diff(np.append(new, len(w))), np.diff(at)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All indices of the ranges that begin at lo and have n members."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _groups(doc: np.ndarray, place: np.ndarray, n: int, common: int) -> np.ndarray:
    """A group for each of n documents, from which of the shard's most common terms they have (pairs of doc and place of the term), so
    that those of one language, say, are together. It only saves work."""
    x = np.zeros((n, common))
    x[doc, place] = 1
    x /= np.maximum(1, np.sqrt(x.sum(axis=1)))[:, None]
    middle = x[np.linspace(0, n - 1, GROUPS).astype(int)]
    for _ in range(4):
        group = np.argmax(x @ middle.T, axis=1)
        middle = np.array([x[group == g].sum(axis=0) for g in range(GROUPS)])
        middle /= np.maximum(1e-9, np.sqrt((middle**2).sum(axis=1)))[:, None]
    return np.unique(group, return_inverse=True)[1].astype(np.int8)


class Shard:
    """The index of some documents, at most MOST_DOCS."""

    def __init__(self, ids: list, begin: np.ndarray, arrays: list[np.ndarray], mean: float):
        """begin: where each document's terms start, and the end; its terms ascend. arrays: the documents' lengths, and all terms'
        counts and terms; they are taken out, so that nobody holds them any longer."""
        term, tf, length = arrays.pop(), arrays.pop(), arrays.pop()
        n, self.ids, self.begin = len(ids), ids, begin
        self.key = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(begin))
        self.exact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / mean))[doc])  # in the order of the documents
        del tf
        order = np.argsort(term).astype(np.int32)
        term, doc, impact = term[order], doc[order], self.exact.astype(np.float32)[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.terms, size = term[first], np.diff(np.append(first, len(term)))
        slot = np.repeat(np.arange(len(first), dtype=np.int32), size)
        self.slot = np.empty_like(slot)
        self.slot[order] = slot
        del term, order
        self.high, self.weight = np.maximum.reduceat(impact, first).astype(np.float64), np.zeros(len(first))
        # documents get their places: by groups, by length, each group filled up to whole blocks
        common = np.argsort(-size, kind="stable")[:COMMON]
        at = _ranges(first[common], size[common])
        group = _groups(doc[at], np.repeat(np.arange(len(common)), size[common]), n, len(common))
        order = np.lexsort((length, group))
        blocks = -(-np.bincount(group) // BLOCK_DOCS)
        lows = np.cumsum(blocks) - blocks
        place = np.empty(n, np.int32)
        place[order] = np.arange(n) + (lows * BLOCK_DOCS - np.cumsum(np.bincount(group)) + np.bincount(group))[group[order]]
        self.at = np.zeros(blocks.sum() * BLOCK_DOCS, np.int32)
        self.at[place] = np.arange(n)
        # the crowded terms of each group as a matrix, the other postings in lists
        rest, group = np.ones(len(doc), bool), group[doc]
        self.parts = []
        for g, (lo, many) in enumerate(zip(lows.tolist(), blocks.tolist())):
            own = np.flatnonzero(group == g)
            count = np.bincount(slot[own], minlength=len(first))
            crowded = np.argpartition(-count, min(CROWDED, len(count) - 1))[:CROWDED]
            row = np.full(len(first), -1, np.int32)
            row[crowded] = np.arange(len(crowded))
            own = own[row[slot[own]] >= 0]
            rest[own] = False
            rows = np.zeros((many * BLOCK_DOCS, len(crowded)), np.float32)
            rows[place[doc[own]] - lo * BLOCK_DOCS, row[slot[own]]] = impact[own]
            rows = rows.reshape(many, BLOCK_DOCS, len(crowded))
            self.parts.append((row, lo, rows, rows.max(axis=1)))
        self.size = np.bincount(slot[rest], minlength=len(first))
        self.first = np.cumsum(self.size) - self.size
        self.postings = np.ceil(impact[rest] / STEP).astype(np.uint32) << 16 | place[doc[rest]].astype(np.uint32)

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term (ascending) in the index, or -1."""
        out = np.full(len(terms), -1, np.int32)
        if not len(terms):
            return out
        place = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        here = np.flatnonzero(terms[place] == self.terms)
        out[place[here]] = here
        return out

    def _sums(self, begin: list[int], slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sums of weight * impact over the lists, in each place, a row a query; impacts are rounded up."""
        out = np.empty((len(begin) - 1, len(self.at)), np.float32)
        for i in range(0, len(out), TOGETHER):
            ends = begin[i : i + TOGETHER + 1]
            some, w = slots[ends[0] : ends[-1]], weights[ends[0] : ends[-1]] * STEP
            n = self.size[some]
            found = self.postings[_ranges(self.first[some], n)]
            part = np.repeat(w, n)
            part *= found >> 16
            found &= 0xFFFF
            cut = np.append(0, np.cumsum(n))[np.array(ends) - ends[0]].tolist()
            for q, (a, b) in enumerate(zip(cut, cut[1:]), i):
                out[q] = np.bincount(found[a:b], part[a:b], len(self.at))
        return out

    def _exact(self, docs: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores from the documents' own terms, in double precision and in the order of the terms."""
        self.weight[slots] = weights
        ab = zip(self.begin[docs].tolist(), self.begin[docs + 1].tolist())
        scores = np.array([np.add.reduce(self.weight[self.slot[a:b]] * self.exact[a:b]) for a, b in ab])
        self.weight[slots] = 0
        return scores

    def search(self, begin: np.ndarray, slots: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, list[tuple]]]:
        """(query, its k best (score, id), best first) of queries whose lists of slots and weights begin there; least: the scores that count."""
        query = np.repeat(np.arange(len(least)), np.diff(begin))
        top = np.bincount(query, weights * self.high[slots], len(least))
        asked = np.flatnonzero((top > 0) & (top >= least * (1 - MARGIN)))
        if not len(asked):
            return []
        if len(asked) < len(least):
            kept = np.isin(query, asked)
            slots, weights, least = slots[kept], weights[kept], least[asked]
            begin = np.append(0, np.cumsum(np.diff(begin)[asked]))
            query = np.repeat(np.arange(len(asked)), np.diff(begin))
        low, found = least * (1 - MARGIN), []
        sums = self._sums(begin.tolist(), slots, weights)
        over = np.bincount(query, weights, len(asked)) * STEP
        if len(free := np.flatnonzero(low == 0)) and k <= len(self.key):  # k documents reach what their lists alone add up to
            low[free] = np.maximum(0, np.partition(sums[free], -k, axis=1)[:, -k] * (1 - MARGIN) - over[free])
        sums = sums.reshape(len(asked), -1, BLOCK_DOCS)
        peak = sums.max(axis=2)
        for row, lo, rows, high in self.parts:
            row = row[slots]
            crowded = np.flatnonzero(row >= 0)
            wide = np.zeros((len(asked), rows.shape[2]), np.float32)
            wide[query[crowded], row[crowded]] = weights[crowded]
            reach = wide @ high.T
            reach += peak[:, lo : lo + len(rows)]
            reach = (reach > 0) & (reach >= low[:, None])
            for block in np.flatnonzero(reach.any(axis=0)).tolist():
                some = np.flatnonzero(reach[:, block])
                scores = sums[some, lo + block] + wide[some] @ rows[block].T
                q, d = np.nonzero((scores > 0) & (scores >= low[some, None]))
                found.append((some[q], (lo + block) * BLOCK_DOCS + d, scores[q, d]))
        if not found:
            return []
        who, place, score = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(who, kind="stable")
        out = []
        for q, mine in zip(who[order][np.flatnonzero(np.diff(who[order], prepend=-1))].tolist(), np.split(order, np.flatnonzero(np.diff(who[order])) + 1)):
            own = slice(begin[q], begin[q + 1])
            if len(mine) > k:
                mine = mine[score[mine] >= np.partition(score[mine], -k)[-k] * (1 - 2 * MARGIN) - over[q]]
            docs = self.at[place[mine]]
            scores = self._exact(docs, slots[own], weights[own])
            best = np.lexsort((self.key[docs], -scores))[:k]
            out.append((int(asked[q]), [(float(scores[j]), self.ids[docs[j]]) for j in best.tolist()]))
        return out


TERM_SCHEMA = "doc_id long, terms array<long>, times array<int>, length int"


def term_table(docs: DataFrame) -> DataFrame:
    """Of docs(doc_id, text): each one's distinct terms, ascending as unsigned numbers, their counts, and its words."""

    def split(batches):
        for batch in batches:
            for at, texts in batches_of(batch.column(1)):
                doc, term, tf, length = _counts(texts)
                ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *lists, pa.array(length.astype(np.int32))], ["doc_id", "terms", "times", "length"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, TERM_SCHEMA)


def statistics(terms: DataFrame) -> DataFrame:
    """(term, df) of a term table."""

    def count(batches):
        for batch in batches:
            names, df = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(df, pa.int64())], ["term", "df"])

    return terms.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, stats: DataFrame, documents: int) -> DataFrame:
    """(query_id, terms array<struct<term, weight>>), terms in order."""
    rows = term_table(queries.select(F.col("query_id").alias("doc_id"), "text")).where("doc_id IS NOT NULL")
    rows = rows.select(F.col("doc_id").alias("query_id"), F.explode(F.arrays_zip("terms", "times")).alias("t")).select("query_id", "t.terms", "t.times")
    idf = F.log1p((documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = rows.join(stats, F.col("terms") == F.col("term")).select("query_id", F.struct("term", (F.col("times") * idf).alias("weight")).alias("t"))
    return weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("terms"))


class Queries:
    """A block of queries: the distinct lists of terms, as places in the sorted terms of all, one after another, and the ids that ask each."""

    def __init__(self, block: pa.Table):
        lists = block.column("terms").combine_chunks()
        begin = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
        flat = lists.flatten()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        term, weight = np.asarray(flat.field("term")).view(np.uint64), np.asarray(flat.field("weight"))
        self.terms, place = np.unique(term, return_inverse=True)
        own: dict[bytes, int] = {}
        self.ids, places, weights = [], [], []
        for i, a, b in zip(block.column("query_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
            name = hashlib.sha256(term[a:b].tobytes() + weight[a:b].tobytes()).digest()
            if name not in own:
                own[name] = len(places)
                order = np.argsort(place[a:b])
                places.append(place[a:b][order].astype(np.int32))
                weights.append(weight[a:b][order])
                self.ids.append([])
            self.ids[own[name]].append(i)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int64)
        self.places, self.weights = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((places, np.int32), (weights, float)))
        self.least = np.zeros(len(places))


def _search(terms: DataFrame, queries: Queries, mean: float, k: int) -> DataFrame:
    """(query: its place in the block, found): the k best of each task's documents."""
    sent = terms.sparkSession.sparkContext.broadcast((queries.terms, queries.begin, queries.places, queries.weights, queries.least))

    def run(batches):
        names, begin, places, weights, given = sent.value
        least, best = given.copy(), {}
        parts, waiting, held, docs = [], [], 0, 0

        def flush(parts):
            if not parts:
                return
            ids, lengths = [i for p in parts for i in p[0]], np.concatenate([p[1] for p in parts])
            arrays = [np.concatenate([p[at] for p in parts]) for at in (4, 3, 2)]
            parts.clear()
            shard = Shard(ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), [arrays.pop(0).astype(np.float64), *(arrays.pop(0) for _ in range(2))], mean)
            slots = shard.slots(names)
            step = max(1, min(SLICE, SCORES // len(shard.at)))
            for at in range(0, len(least), step):
                ends = begin[at : at + step + 1]
                own = slots[places[ends[0] : ends[-1]]]
                here = own >= 0
                ends_here = np.concatenate([[0], np.cumsum(here)])[ends - ends[0]]
                for q, found in shard.search(ends_here, own[here], weights[ends[0] : ends[-1]][here], least[at : at + step], k):
                    q += at
                    best[q] = sorted(best.get(q, []) + found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], best[q][-1][0])

            del shard, slots
            give_back()

        for batch in batches:
            batch = batch.filter(pa.compute.greater(batch.column("length"), 0))
            for at in range(0, batch.num_rows, MOST_DOCS // 8):
                some = batch.slice(at, MOST_DOCS // 8)
                term = np.array(some.column("terms").flatten()).view(np.uint64)
                parts.append((some.column("doc_id").to_pylist(), np.asarray(some.column("terms").value_lengths()), term, np.array(some.column("times").flatten()), np.asarray(some.column("length"))))
                held += len(term)
                docs += some.num_rows
                if held >= 1.2 * SHARD_TERMS or docs >= MOST_DOCS * 3 // 4:
                    flush(waiting)
                    parts, waiting, held, docs = [], parts, 0, 0
        if held < SHARD_TERMS / 2:  # a small rest makes no shard of its own
            waiting, parts = waiting + parts, []
        flush(waiting)
        flush(parts)
        some = [(q, [{"score": -s, "none": x is None, "doc_id": x} for s, x in b]) for q, b in best.items()]
        for a in range(0, len(some), 1000):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some[a : a + 1000]], pa.int64()), pa.array([x[1] for x in some[a : a + 1000]], pa.list_(pa.struct([("score", pa.float64()), ("none", pa.bool_()), ("doc_id", pa.int64())])))], ["query", "found"])

    return terms.mapInArrow(run, "query long, found array<struct<score:double,none:boolean,doc_id:long>>")


def _best(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    return lists.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score) of queries(query_id, text), ids distinct, against docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    terms = stored(term_table(docs), "bm25-documents")
    documents, words, postings = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    mean = max(words, 1) / max(documents, 1)
    stats = stored(statistics(terms), "bm25-terms")
    asked = stored(query_terms(queries, stats, documents), "bm25-queries", [stats])
    size = asked.agg(F.coalesce(F.sum(F.size("terms") * 16), F.lit(0))).first()[0]
    passes, lists = max(1, -(-size // QUERY_BYTES)), []
    # small files together make a shard
    shards = terms.coalesce(max(spark.sparkContext.defaultParallelism, -(-postings // SHARD_TERMS)))
    drawn = max(SAMPLE_DOCS, math.isqrt(SAMPLE_ROOT * documents))
    share = int(2**32 * min(1.0, drawn / max(documents, 1)))
    sample = terms.where(F.pmod(F.xxhash64("terms", "doc_id"), F.lit(2**32)) < share).repartition(max(SAMPLE_PARTS, drawn // 4096))
    for one in range(passes):
        block = Queries(asked.where(F.pmod(F.xxhash64("terms.term"), F.lit(passes)) == one).toArrow())
        reach = _best(_search(sample, block, mean, k), k, "query").where(F.size("found") == k).select("query", (-F.col("found")[k - 1]["score"]).alias("least")).toArrow()
        block.least[reach.column("query").to_numpy()] = reach.column("least").to_numpy()
        ids = spark.createDataFrame([(q, i) for q, own in enumerate(block.ids) for i in own], "query long, query_id long")
        # two levels, so that no group holds all tasks' lists
        parts = _best(_search(shards, block, mean, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))), k, "query", "part")
        lists.append(_best(parts, k, "query").join(ids, "query").select("query_id", F.posexplode("found").alias("rank", "hit")))
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return every.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.doc_id").alias("doc_id"), (-F.col("hit.score")).alias("score"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the whole texts of every row whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))
