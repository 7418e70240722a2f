import random
import re

import pytest

pytest.importorskip("rillgrid.llm")
import numpy as np
from pyspark.sql import functions as F

from rillgrid.llm import common, ngram_join


def brute(rows, width, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            words = r.choice(texts[-12:]).split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(r.choice(vocab) for _ in range(r.randint(1, 40))))
    hot = "h1 h2 h3 h4 h5 h6 h7 h8 h9 h10 h11 h12 h13 h14 h15 h16 h17 h18 h19 h20 h21 h22 h23 h24 h25 h26 h27 h28 h29 h30".split()
    for i in range(n // 3):  # a group of near copies
        words = list(hot)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    texts += ["Same  Text\there", "same text here", "", None, "  \n", "É é É é", "é É é É", "one", "ONE", "long " * 3000, "a b c d " * 2000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, rows[0], rows[1], (None, texts[0]), (None, "only here without an id"), (None, None)]


@pytest.mark.parametrize("seed, n, width, percent, frequent, order", [(1, 90, 2, 60, 2, 1 << 20), (2, 90, 3, 85, 1, 1 << 20), (3, 120, 4, 85, 48, 1 << 20), (4, 100, 3, 80, 2, 1), (5, 100, 4, 85, 3, 7)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, width, percent, frequent, order):
    """order: how many frequent shingles the order knows; the others' long lists still go by their centres."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "ORDER_LIMIT", order)
    rows = corpus(seed, n)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, cid string")
    got = ngram_join.near_duplicates(df, width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)


def test_one_document_of_each_component_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words stand in this text here"), (4, ""), (5, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one(df)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, None] and kept.columns == ["doc_id", "text"]


def test_rows_are_dropped_by_id_and_text(spark):
    """A text of its own stays though its id is that of a near duplicate; rows without an id go like others."""
    rows = [(1, "x1"), (7, "x1"), (7, "y"), (None, "x1"), (None, "z"), (None, "z"), (8, "y"), (9, "y"), (9, "y"), (2, "w"), (2, "w"), (3, ""), (3, "")]
    text = {k: " ".join(f"{k}{i}" for i in range(9)) for k in ("x1", "y", "z", "w")} | {"": ""}
    kept = ngram_join.keep_one(spark.createDataFrame([(i, text[t], t) for i, t in rows], "doc_id long, text string, k1 string"))
    assert sorted(((r.doc_id, r.k1) for r in kept.collect()), key=str) == sorted([(1, "x1"), (7, "y"), (None, "z"), (2, "w"), (3, ""), (3, "")], key=str)


def test_repeated_rows_are_verified_once(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(39))
    join = ngram_join.NgramJoin(spark.createDataFrame([(1, a)] * 20 + [(2, b)] * 20, "doc_id long, text string"))
    assert join.links().count() == 1


def test_the_filter_admits_what_it_holds(spark):
    df = spark.createDataFrame([(x,) for x in (-(2**63), -1, 0, 1, 5, 2**63 - 1, 1 << 26, (1 << 15) - 1)], "h long")
    bits = common.bit_filter(df, "h")
    asked = df.unionByName(spark.createDataFrame([(2,), (None,), (77,)], "h long")).withColumn("ok", common.admitted(F.col("h"), bits, spark)).collect()
    assert all(r.ok for r in asked[:8]) and not any(r.ok for r in asked[8:])
    assert int(np.unpackbits(bits).sum()) == len({x % common.FILTER_BITS for x in (r.h for r in asked[:8])})


def test_no_documents(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert ngram_join.near_duplicates(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 2


def test_links_of_group_members_around_frequent_shingles(spark):
    """Of each passage, two cuts share size and prefix but do not link; the whole passage links both."""
    rows = []
    for k in range(6):
        words = [f"p{k}w{i}" for i in range(23)]
        for cut in (words, words[:-2], words[2:]):
            rows += [(len(rows) + i, " ".join(cut)) for i in range(ngram_join.FREQUENT + 1)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4, 85)


def templated(n):
    """Texts of twelve phrases out of twelve, four words each: they share shingles, but hardly any link."""
    r = random.Random(n)
    phrases = [" ".join(f"p{k}w{i}" for i in range(4)) for k in range(12)]
    return [(i, " ".join(r.choice(phrases) for _ in range(12))) for i in range(n)]


def test_templated_texts_do_not_make_all_pairs(spark, monkeypatch):
    """The pairs that are verified grow like the texts, not like their pairs."""
    sizes = []
    for n in (200, 400, 800):
        rows, made = templated(n), []
        verified = ngram_join.NgramJoin.verified
        monkeypatch.setattr(ngram_join.NgramJoin, "verified", lambda self, pairs, made=made, verified=verified: made.append(pairs.count()) or verified(self, pairs))
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
        monkeypatch.setattr(ngram_join.NgramJoin, "verified", verified)
        sizes.append(sum(made))
        if n < 800:
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4, 85)
    assert sizes[2] < 2.5 * sizes[1] and sizes[1] < 2.5 * sizes[0], sizes


def test_masks_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        x = r.integers(0, 1 << 63, n + 40).astype(np.uint64)
        a, b = x[: n + 10], x[20:]
        bits = sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in zip(ngram_join._mask(a), ngram_join._mask(b)))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
