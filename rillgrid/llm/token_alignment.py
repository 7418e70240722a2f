"""Alignment of two tokenizers' tokens over the same texts.

1. Texts are shuffled whole, so that each distinct text is encoded and aligned once, with the number of its copies.
2. Both tokenizers encode " " + text. Byte offsets where tokens of both end cut the text into groups; an A and a B token are
   linked where their byte ranges overlap. A text's links are kept as (pair, times).
3. A pair's count is its times over all texts, each weighted by its copies. The pairs of largest counts, PAIRS at most, are
   sent to the executors and summed in place; all others meet their counts by a join. Both always happen.
4. The measures meet the rows again by a 128-bit hash of the text.

Neither tokenizer's tokens cross a single space between two ASCII letters, digits or signs (both files are checked for that), so
texts are cut there: a worker aligns each distinct piece once, in a store bounded by bytes. Groups and links are those of the
whole text.

Cases: null and empty texts, and texts whose tokens do not join to their bytes again (U+2581 for one), have no tokens: zeros
and an empty digest. Equal texts have equal measures and each counts. Rows without id are rows like others. Other columns are
ignored; an empty table gives an empty result. Texts are taken whole; a long piece without a safe space is one piece.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Seen, key128, runs_of, small_batches, stored, table

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are sent to the executors (17 bytes each).
PAIRS = 1 << 19
#: Characters of texts that are worked on at a time.
CHUNK = 2 << 20
#: Characters of pieces that are encoded as one text.
JOINED = 1 << 16
#: A space that no token of either file crosses.
SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Pieces(Seen):
    """Aligned pieces; each takes some arrays and strings."""

    HALF_BYTES, ENTRY = 32 << 20, 600


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as file:
            said = json.load(file)
        splitter = said["pre_tokenizer"] or {}
        if said["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("only byte-level files with the usual splitter and no normaliser are supported")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names) or [names[i] for i in self.b.encode(" a")][:1] == ["▁a"]:
            raise ValueError("only models whose pieces start with their spaces, and that keep white space, are supported")
        of = byte_table()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: an id's text with what follows it: another of its side, the end of its side's part of a group, or (B) the end of a piece
        self.said = [f"{i}{end}" for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;\n")) for end in ends for i in range(len(t))]
        self.seen = Pieces()

    @property
    def base(self) -> int:
        """A pair of ids is a * base + b."""
        return len(self.b_bytes)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The A and B ids of texts, each after a space, one after the other; None if their bytes differ from the texts'."""
        a = np.array([i for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False) for i in x.ids], np.int64)
        b = np.array([i for x in self.b.encode(texts, num_threads=1) for i in x], np.int64)
        raw = "".join(" " + t for t in texts).encode()
        same = all(raw == b"".join(map(t.__getitem__, ids.tolist())) for t, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return (a, b) if same else None

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces of texts, each after a space: (n_a, n_b, n_groups, pairs, groups), or None if bytes differ. Pieces that may stand
        next to each other are encoded as one text, and the others one by one."""
        inner = [p for p in pieces if "!" <= p[0] <= "~" and "!" <= p[-1] <= "~"]
        for lo, hi in runs_of([len(p) for p in inner], JOINED):
            if (ids := self._tokens([" ".join(inner[lo:hi])])) is not None:
                self._align(inner[lo:hi], *ids)
        for p in pieces:
            if p not in self.seen:
                if (ids := self._tokens([p])) is None:
                    self.seen.keep(p, None)
                else:
                    self._align([p], *ids)

    def _align(self, pieces: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Keeps what is to know of pieces, given the tokens of all of them in a row."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        stop = np.cumsum([1 + len(p.encode()) for p in pieces])  # where pieces end, and tokens of both sides with them
        a_in_b, b_in_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
        a_cuts, b_cuts = b_end[a_in_b] == a_end, a_end[b_in_a] == b_end
        # each stretch between ends lies in one token of each side: a link
        only_b = np.flatnonzero(~b_cuts)
        place = np.searchsorted(a_end, b_end[only_b])
        pairs = np.insert(a * self.base + b[a_in_b], place, a[place] * self.base + b[only_b])
        group = np.cumsum(a_cuts) - a_cuts, np.cumsum(b_cuts) - b_cuts
        n_a = len(self.a_bytes)
        code = np.concatenate([a + n_a * a_cuts, b + 2 * n_a + self.base * (b_cuts.astype(int) + (stop[np.searchsorted(stop, b_end)] == b_end))])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        said = "".join(map(self.said.__getitem__, code[order].tolist())).split("\n")
        a_last, b_last = np.searchsorted(a_end, stop) + 1, np.searchsorted(b_end, stop) + 1
        cuts = np.cumsum(a_cuts)[a_last - 1]
        # a piece has a link more than its tokens less its groups, for each group
        links = a_last + b_last - cuts
        sizes = [np.diff(x, prepend=0).tolist() for x in (a_last, b_last, cuts)]
        before = 0
        for p, *numbers, upto, groups in zip(pieces, *sizes, links.tolist(), said):
            self.seen.keep(p, (*numbers, pairs[before:upto].copy(), groups))
            before = upto

    def measures(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
        cut = [SAFE.split(t) if t else [] for t in texts]
        if fresh := self.seen.unknown({p for ps in cut for p in ps}):
            self.learn(fresh)
        out, none = [], (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        for ps in cut:
            found = [self.seen[p] for p in ps]
            if not found or None in found:
                out.append(none)
                continue
            n_a, n_b, groups, pairs, said = zip(*found)
            pairs = np.concatenate(pairs)
            kinds, times = np.unique(pairs, return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(groups), len(pairs), hashlib.sha256(";".join(said).encode()).hexdigest(), kinds, times))
        return out


def piece_count(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _links(kinds: list[np.ndarray], times: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, kinds)])
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (kinds, times)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], ["pair", "times"]))


LINKS = "links array<struct<pair: long, times: long>>"


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(k1, k2, copies, n_a, n_b, n_groups, n_links, groups_sha256, links) of docs' distinct texts that have tokens."""
    each = docs.where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    k1, k2 = key128(F.col("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in runs_of([len(t) for t in texts], CHUNK):
                made = aligner(a_path, b_path).measures(texts[lo:hi])
                n_a, n_b, groups, links, sha, kinds, times = (list(x) for x in zip(*made))
                keys = [batch.column(c).slice(lo, hi - lo) for c in ("k1", "k2", "copies")]
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)]
                yield pa.RecordBatch.from_arrays([*keys, *counts, pa.array(sha, pa.string()), _links(kinds, times)], ["k1", "k2", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    schema = f"k1 long, k2 long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {LINKS}"
    return each.select(k1.alias("k1"), k2.alias("k2"), "copies", "text").mapInArrow(run, schema)


def pair_counts(texts: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): how many links of all rows hold each pair of ids, and whether that is the most of its B id. A B id has at
    most as many pairs as there are A ids, so a window over it is bounded."""
    links = texts.select("copies", F.inline("links"))
    counts = links.groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("n"))
    most = counts.withColumn("b", F.pmod("pair", F.lit(base))).groupBy("b").agg(F.max("n").alias("most"))
    met = counts.withColumn("b", F.pmod("pair", F.lit(base))).join(most, "b")
    return met.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _most_frequent(counts: DataFrame) -> pa.Table:
    """The pairs of the largest counts, by levels of counts, as many whole levels as PAIRS allow."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # some hundred levels
    total, least = 0, None
    for at, size in sizes:
        if total + size > PAIRS:
            break
        total, least = total + size, at
    return counts.where(level >= (F.lit(1 << 30) if least is None else F.lit(least))).orderBy("pair").toArrow()


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = stored(encoded(rows, a_path, b_path), "aligned-texts")
    counts = stored(pair_counts(texts, piece_count(b_path)), "aligned-pairs")
    known = spark.sparkContext.broadcast([_most_frequent(counts).column(c).to_numpy() for c in ("pair", "n", "best")])

    def summed(batches):
        pair, n, best = known.value
        for batch in batches:
            links = batch.column("links")
            ends = np.concatenate([[0], np.cumsum(np.asarray(links.value_lengths()))])
            flat = links.flatten()
            kinds, times = (np.asarray(flat.field(c)) for c in ("pair", "times"))
            at = np.minimum(np.searchsorted(pair, kinds), max(0, len(pair) - 1))
            met = pair[at] == kinds if len(pair) else np.zeros(len(kinds), bool)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            sums = total(np.where(met, times * n[at], 0)) if len(pair) else total(0 * times)
            most = total(np.where(met & best[at], times, 0)) if len(pair) else total(0 * times)
            left = total(~met)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), flat.filter(pa.array(~met)))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(sums, pa.int64()), pa.array(most, pa.int64()), rest], ["k1", "k2", "known_sum", "known_best", "links"])

    part = stored(texts.select("k1", "k2", "links").mapInArrow(summed, f"k1 long, k2 long, known_sum long, known_best long, {LINKS}"), "aligned-sums")
    rare = part.select("k1", "k2", F.inline("links")).join(counts, "pair")
    rare = rare.select("k1", "k2", (F.col("times") * F.col("n")).alias("known_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("known_best"))
    sums = part.drop("links").unionByName(rare).groupBy("k1", "k2").agg(F.sum("known_sum").alias("count_sum"), F.sum("known_best").alias("n_best"))
    measured = stored(texts.drop("copies", "links").join(sums, ["k1", "k2"]), "aligned-measures", [texts, counts, part])
    k1, k2 = key128(F.col("text"))
    met = rows.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(measured.hint("merge"), ["k1", "k2"], "left")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return met.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts have zeros."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))
