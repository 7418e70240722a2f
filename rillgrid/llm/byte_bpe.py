"""Byte-level BPE: texts to ids and back, with the tokenizers library over Arrow batches.

A rank file lists byte strings with their ranks. The library works on characters, so each byte gets a printable stand-in
character; a token's string is its bytes' stand-ins. Ranks join any two neighbours whose bytes together are a token, so
every split of a token into two tokens becomes a merge, in the order of the ranks; a piece that is itself a token is taken
whole. Decoding maps the stand-ins back to bytes; a character may be split between tokens, so text is made from joined bytes.

Cases: a null text gives null ids, and an empty one no ids; null ids decode to null, and null or unknown ids within a list
to the bytes of U+FFFD; bytes that are no UTF-8 become U+FFFD in decoded text. Texts are encoded whole, whatever their
length. Rows are independent, so order, repeats and other columns do not matter.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Seen, give_back, runs_of

#: Bytes of text that are encoded at a time; bounds a worker's memory.
CHUNK_BYTES = 1 << 17
LOST = "�".encode()
MARK = "\U0010ffff"


def byte_characters() -> list[str]:
    """The stand-in of each byte: itself where it prints in Latin-1, else the next character from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file; made once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, stand_in = read_ranks(path), byte_characters()
    name = {token: "".join(stand_in[b] for b in token) for token in ranks}
    merges = [
        (name[token[:cut]], name[token[cut:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(len(token) - 1, 0, -1)
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


@lru_cache(maxsize=4)
def byte_table(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array and where each id's begin (one more at the end); the id after the last is the lost one."""
    made, back = tokenizer(path, pattern), {c: b for b, c in enumerate(byte_characters())}
    size = 1 + max(made.get_vocab().values(), default=-1)
    tokens = [LOST if (t := made.id_to_token(i)) is None else bytes(back[c] for c in t) for i in range(size)] + [LOST]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)


def _joined(ids: np.ndarray, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and each id's number of bytes."""
    data, begin = byte_table(path, pattern)
    last = len(begin) - 2
    ids = np.where((ids < 0) | (ids > last), last, ids)
    sizes = begin[ids + 1] - begin[ids]
    places = np.arange(sizes.sum()) + np.repeat(begin[ids] - (np.cumsum(sizes) - sizes), sizes)
    return data[places], sizes


def chunks(text: str) -> list[str] | None:
    """The text in parts that matches never cross: words with the space before them, and line ends. None if white space of
    another kind, or more than one in a row, is in it."""
    if MARK in text or len(text.split()) != text.count(" ") + text.count("\n") + 1:
        return None
    return text.replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK)


def check_pattern(pattern: str) -> None:
    """chunks() relies on where a pattern parts texts: one that parts them otherwise is refused."""
    import regex

    for text in ("a b", "ab. cd", "a1 b2", "a\nb", "it's é.\n-x", "a ,b\n1"):
        whole = [m.group() for m in regex.finditer(pattern, text)]
        if whole != [m.group() for c in chunks(text) for m in regex.finditer(pattern, c)]:
            raise ValueError("only patterns whose matches begin with one space at most and end at line ends are supported")


class Encoder:
    """Encodes texts by the library; words that are new to the worker go to it in one text, parted by line ends."""

    def __init__(self, path: str, pattern: str):
        check_pattern(pattern)
        self.library, self.seen = tokenizer(path, pattern), Seen()
        self.line_end = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self._ids(["\n".join(["", *words, ""])])[0], np.int32)
        ends = np.flatnonzero(ids == self.line_end[0])
        data = ids.tobytes()  # four bytes an id: joining bytes is faster than joining lists
        for w, i, j in zip(words, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            self.seen.keep(w, data[4 * i + 4 : 4 * j])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, seen = [chunks(t) if len(self.line_end) == 1 else None for t in texts], self.seen
        fresh = [c for c in seen.unknown({c for cs in parts if cs for c in cs}) if c not in ("", "\n")]
        seen |= {"": b"", "\n": np.array(self.line_end, np.int32).tobytes()}
        for a, b in runs_of([len(c) for c in fresh], CHUNK_BYTES):
            self._learn(fresh[a:b])
        whole = iter(self._ids([t for t, cs in zip(texts, parts) if cs is None]))
        return [np.array(next(whole), np.int32) if cs is None else np.frombuffer(b"".join(map(seen.__getitem__, cs)), np.int32) for cs in parts]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encoded(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    lists, values = [], texts.to_pylist()
    for a, b in runs_of([len(t or "") for t in values], CHUNK_BYTES):
        some = encoder(path, pattern).encode([t or "" for t in values[a:b]])
        ends = pa.array(np.cumsum([0, *map(len, some)]), pa.int32(), mask=np.array([*(t is None for t in values[a:b]), False]))
        lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(some), pa.int32())))
    return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))


def _decoded(lists: pa.Array, path: str, pattern: str) -> pa.Array:
    made, ends = [], np.asarray(lists.offsets)
    flat = np.asarray(lists.values.fill_null(-1)).astype(np.int64)
    for a, b in runs_of(np.diff(ends).tolist(), CHUNK_BYTES):
        data, sizes = _joined(flat[ends[a] : ends[b]], path, pattern)
        at = np.concatenate([[0], np.cumsum(sizes)])[ends[a : b + 1] - ends[a]]
        made.append(pa.array([data[i:j].tobytes() if ok else None for i, j, ok in zip(at[:-1], at[1:], lists[a:b].is_valid().to_pylist())], pa.binary()))
    return pa.concat_arrays(made) if made else pa.array([], pa.binary())


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int>: the ids of each whole text. The pattern's matches may begin with one space and hold no other space that
    stands between characters that are no white space, and a single line end is a match of its own, as in GPT-2's pattern."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path, pattern)

    return encoded(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes of each list of ids."""

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        return _decoded(lists, path, pattern)

    return decoded(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, decoded>: encode() and decode() of its ids in one worker, so that a task needs no second one."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, path, pattern)
        decoded = _decoded(ids, path, pattern)
        give_back()
        return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    return both(text)


def decode_text(ids: Column, path: str, pattern: str) -> Column:
    """string: decoded bytes as text, with U+FFFD for what is no UTF-8."""

    @F.arrow_udf("string")
    def read(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string())

    return read(decode(ids, path, pattern))


def offsets(ids: Column, path: str, pattern: str) -> Column:
    """array<struct<begin, end>>: the characters of the text that each token covers at least in part."""

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def placed(lists: pa.Array) -> pa.Array:
        out = []
        for one in lists:
            if not one.is_valid:
                out.append(None)
                continue
            data, sizes = _joined(np.asarray(one.values.fill_null(-1)).astype(np.int64), path, pattern)
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            end = np.cumsum(sizes)
            out.append([{"begin": int(char[j - s]), "end": int(char[j - 1]) + 1} for j, s in zip(end, sizes)])
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))

    return placed(ids)


def pieces(ids: list[int], path: str, pattern: str) -> list[str]:
    """Text as it can be shown after each id: a character split between tokens comes with its last one, and what is left
    unfinished comes at the end."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    data, sizes = _joined(np.asarray(ids, np.int64), path, pattern)
    ends = np.cumsum(sizes)
    shown = [reader.decode(data[j - s : j].tobytes()) for j, s in zip(ends, sizes)]
    return [*shown[:-1], shown[-1] + reader.decode(b"", True)] if shown else []
