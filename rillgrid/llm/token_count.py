"""Token counts by merging arrays in step with the ranks.

The library's own normaliser and splitter prepare a batch; the words new to a worker are then merged together: all their
symbols lie in one numpy array with a row of starts (a ragged array), and in each round every word's pair of lowest rank is
joined, in all words at once. The symbols that are left are the tokens.

In one round all places of a word's lowest pair are joined, left before right where they overlap. That equals joining one
at a time if a merge never ranks below one that makes its parts; the file is checked for that when it is read.

Cases: null counts as an empty text, with no tokens; special strings in a text count one each, as the library takes them;
long texts are counted whole. Rows are independent, so order, repeats and other columns do not matter.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Seen, runs_of

CHUNK_BYTES = 4 << 20


class Merger:
    """What a word-level BPE file says, ready for arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, made = said["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files with word ends are supported")
        self.end = model.get("end_of_word_suffix") or ""
        vocab = self.vocab = model["vocab"]
        self.normal, self.split = made.normalizer, made.pre_tokenizer
        if self.split is None:
            raise ValueError("only files with a splitter are supported")
        one = self.normal.normalize_str("a\t\n b\u00a0c") if self.normal else ""
        if one.split() != one.split(" ") or [w for w, _ in self.split.pre_tokenize_str("a b")] != [w for c in "ab" for w, _ in self.split.pre_tokenize_str(c)]:
            raise ValueError("only files whose normaliser makes white space single spaces, and whose splitter never crosses them, are supported")
        special = [t["content"] for t in said["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) or r"(?!)")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = 1 + max(vocab.values())
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made_id = np.array([vocab[a + b] for a, b in pairs], np.int64)
        first = np.full(self.base, -1, np.int64)
        first[made_id[::-1]] = np.arange(len(pairs))[::-1]
        if np.any(np.maximum(first[keys // self.base], first[keys % self.base]) >= np.arange(len(pairs))):
            raise ValueError("a merge ranks below one that makes its parts")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made_id[order]
        self.seen = Seen()

    def survivors(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word (given in the splitter's characters, none empty)."""
        flat = [self.vocab[c] for w in words for c in w]
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.cumsum(sizes) - 1
        if self.end:
            for i, w in zip(at.tolist(), words):
                flat[i] = self.vocab[w[-1] + self.end]
        symbols, word = np.array(flat, np.int64), np.repeat(np.arange(len(words)), sizes)
        left = np.zeros(len(words), np.int64)
        none = len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), none - 1)
            ok = (self.keys[place] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(ok, self.rank[place], none), none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == none
            left[word[starts[done]]] = counts[done]
            hit = (rank == np.repeat(lowest, counts)) & (rank < none)
            where = np.flatnonzero(hit)
            if len(where):  # of overlapping places (a pair of equal symbols) every other one
                new = np.append(True, np.diff(where) > 1)
                run = where[new][np.cumsum(new) - 1]
                where = where[(where - run) % 2 == 0]
            keep = np.repeat(~done, counts)
            symbols[where] = self.made[np.minimum(np.searchsorted(self.keys, symbols[where] * self.base + symbols[where + 1]), none - 1)]
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        return left

    def learn(self, chunks: list[str]) -> None:
        """Counts of chunks that are not known yet; a chunk has no white space and so stands alone."""
        split = {c: [w for w, _ in self.split.pre_tokenize_str(c)] for c in chunks}
        words = sorted({w for ws in split.values() for w in ws if w}, key=len)
        count = {}
        for a, b in runs_of([len(w) for w in words], 1 << 20):
            count |= zip(words[a:b], self.survivors(words[a:b]).tolist())
        for c, ws in split.items():
            self.seen.keep(c, sum(count[w] for w in ws if w))

    def count(self, texts: list[str]) -> list[int]:
        special = [len(self.special.findall(t)) for t in texts]
        parts = [(self.special.split(t) if n else [t]) for t, n in zip(texts, special)]
        chunks = [[c for p in ps for c in (self.normal.normalize_str(p) if self.normal else p).split(" ") if c] for ps in parts]
        if fresh := self.seen.unknown({c for cs in chunks for c in cs}):
            self.learn(fresh)
        return [n + sum(map(self.seen.__getitem__, cs)) for n, cs in zip(special, chunks)]


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def token_count(text: Column, path: str) -> Column:
    """bigint: tokens of each whole text, as the tokenizers library counts them without added special tokens."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        values, out = [t or "" for t in texts.to_pylist()], []
        for a, b in runs_of([len(t) for t in values], CHUNK_BYTES):
            out += merger(path).count(values[a:b])
        return pa.array(out, pa.int64())

    return counted(text)
