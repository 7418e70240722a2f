"""Word shingles of whole texts as 64-bit hashes, for many texts at once.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes with A-Z in lower case. A word's hash is a polynomial of its bytes' random
values modulo 2^64, taken from running sums over the batch; a shingle's hash is a polynomial of its words' hashes. Both are
spread by a bijection. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

MULTIPLIER = 0x9E3779B97F4A7C15
BATCH_BYTES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
#: The random value of each byte, A-Z as a-z.
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BATCH_BYTES)
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array, separators: np.ndarray = BLANK, head: int | None = None) -> tuple[np.ndarray, ...]:
    """Hashes of all words of a batch of texts, and the index of each text's first word (one more at the end). With head also
    the hashes of the words' first bytes, as many as that. separators says for each byte whether it parts words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or edges[0] == edges[-1]:
        none = np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        return none if head is None else (*none, none[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    blank = separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True  # a text's first byte starts a word, whatever is before it
    start = ~blank & (cut[:-1] | np.concatenate([[True], blank[:-1]]))
    end = ~blank & (cut[1:] | np.concatenate([blank[1:], [True]]))
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    value = lambda end: mixed((sums[end] - sums[first]) * down[first])
    found = value(last), np.searchsorted(first, edges)
    return found if head is None else (*found, value(np.minimum(last, first + head)))


def polynomial(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row."""
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(MULTIPLIER) + words[i : len(words) - k + 1 + i]
    return mixed(out)


def sequences(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's shingles in order; fewer words than width make one shingle, none make none."""
    words, at = word_hashes(texts)
    whole = polynomial(words, width) if len(words) >= width else words[:0]
    return [whole[a : b - width + 1] if b - a >= width else polynomial(words[a:b], b - a) if b > a else words[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def batches_of(column: pa.Array):
    """(start, texts) of slices of about BATCH_BYTES."""
    from .common import runs_of

    sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
    for a, b in runs_of(sizes, BATCH_BYTES):
        yield a, column.slice(a, b - a)
