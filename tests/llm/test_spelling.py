import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("rillgrid.llm")

from rillgrid.llm import spelling

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, every=199, ratio=5):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in vocab:
        found = sorted((-vocab[x], x) for x in vocab if near(w, x))
        form[w] = found[0][1] if found and -found[0][0] >= ratio * vocab[w] else None
        out.append((w, len(found)))
    result = []
    for w, n_near in out:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, vocab[w], n_near, vocab.get(form[w])))
    return sorted(result)


def corpus(seed, n):
    r = random.Random(seed)
    letters = "abcdeß÷éàÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(30)] + ["aabbcc", "aabbc", "aabbccc", "abbbbb", "bbbbbb", "ababab" * 60]
    for w in list(words):
        for _ in range(3):
            i = r.randrange(len(w))
            words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]))
    rows = []
    for d in range(n):
        picked = [words[min(int(r.expovariate(0.06)), len(words) - 1)] for _ in range(r.randint(0, 60))]
        rows.append((d, r.choice([" ", "-", "7", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in picked)))
    return [*rows, (1, None), (2, ""), rows[0], rows[0], (None, "abcdef " * 9), (None, "AbcdeF abcdeg " * 9)]


@pytest.mark.parametrize("seed, size", [(1, 8 << 20), (2, 100)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, size):
    """size: bytes of filters a pass; a hundred make several passes."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    rows = corpus(seed, 150)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = spelling.variants(spelling.vocabulary(spelling.words_of(df)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and any(r[1] for r in want)


def test_long_words_are_probed_in_slices(monkeypatch):
    monkeypatch.setattr(spelling, "PROBES", 64)
    a = "ab" * 200
    b = a[:299] + "c" + a[300:]
    codes = [c for _, c in spelling._by_length([a])][0]
    value = lambda w: [(spelling._values(c) * spelling._powers(len(w))).sum(axis=1, dtype=np.uint64) for _, c in spelling._by_length([w])][0]
    block, mask = spelling._place(value(b), 50)
    bits = np.zeros(50, np.uint64)
    bits[block] |= mask
    found = spelling.Filters({400: (0, 50)}, bits)
    assert (0, 299, 2) in [tuple(map(int, x)) for x in spelling._replaced(codes, np.array([97, 98, 99], np.uint32), found)]


def test_chains_of_forms(spark):
    vocab = [("abcdef" + "x" * i, 5 ** (9 - i)) for i in range(8)]
    got = spelling.variants(spark.createDataFrame(vocab, "word string, n long")).collect()
    assert {r.root for r in got} == {"abcdef"} and sum(r.form is None for r in got) == 1


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b"), (3, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling.variants(spelling.vocabulary(spelling.words_of(df))).collect() == []


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = spelling.op12_spelling_variants(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(spelling.OP12_SQL).fetchall())
