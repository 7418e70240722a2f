import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rillgrid.llm")
from rillgrid.llm import decontaminate, toxicity

LABELS = "doc_id long, quality int, toxic int, p_toxic int"


def toxic_rows(n=600, seed=5):
    r = random.Random(seed)
    clean, bad = [f"w{i}" for i in range(300)], ["vile", "Scum!", "rotten"]
    rows, labels = [], []
    for i in range(n):
        y, q = int(r.random() < 0.2), int(r.random() < 0.7)
        words = [r.choice(clean) for _ in range(r.randint(5, 200))] + (["fine"] if q else ["poor"])
        for _ in range(y * r.randint(1, 4)):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, q, y, 7))
    return rows, labels


def test_held_out_accuracy_and_later_models_see_earlier_ones(spark):
    rows, labels = toxic_rows()
    odd = [(None, "vile scum"), (9001, None), (9002, ""), (9003, "w1 " * 50_000 + "scum vile"), rows[0]]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, toxic int").drop("toxic")
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [labels[1], (9001, None, 1, 0), (None, 1, 1, 0)], LABELS)
    chain = toxicity.fit_chain(docs, known)
    assert [len(m.extra) for m in chain.models] == [0, 1]
    out = toxicity.flag_toxic(docs, chain)
    assert out.columns == ["doc_id", "text", "p_quality", "p_toxic", "toxic"]
    got = {r.doc_id: r for r in out.collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert np.mean([got[i].toxic == bool(y) for i, _, y, _ in held]) > 0.97 and np.mean([(got[i].p_quality > 0.5) == bool(q) for i, q, *_ in held]) > 0.95
    assert got[None].toxic and got[9003].toxic and not got[9001].toxic and got[9001].p_toxic == got[9002].p_toxic


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, 0), (2, 1, 0, 0)]])
def test_without_labels_of_both_kinds_nothing_is_flagged(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    out = toxicity.flag_toxic(docs, toxicity.fit_chain(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len(out) == 2 and not any(r.toxic for r in out)
    assert toxicity.flag_toxic(docs.limit(0), toxicity.fit_chain(docs.limit(0), spark.createDataFrame(labels, LABELS))).collect() == []


def shingles(words, width):
    k = min(width, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def brute_leaks(docs, items, width=5, at_least=0.8):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    items = [(i, split(t)) for i, t in items if split(t)]
    seen = Counter(s for _, w in items for s in shingles(w, width))
    weight = lambda s: 1 + math.log(len(items) / seen[s]) if s in seen else 1 + math.log(len(items))
    out = []
    for d, t in docs:
        words = split(t)
        for i, w in items:
            best, a = None, shingles(w, width)
            own = shingles(words, min(width, len(w)))
            hits = [j for j in range(len(words)) if tuple(words[j : j + min(width, len(w))]) in a] if own & a else []
            for at in sorted({s for j in hits for s in range(max(0, j - len(w)), min(j, len(words) - len(w)) + 1)}):
                b = shingles(words[at : at + len(w)], width)
                low = sum(min(n, b[s]) * weight(s) for s, n in a.items())
                how = low / sum(max(a[s], b[s]) * weight(s) for s in a | b)
                if how >= at_least + 1e-3 and (best is None or how > best[0] + 1e-9):
                    best = (how, at)
            if best:
                out.append((d, i, best[1], len(w)))
    return sorted(out, key=str)


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(20, 60)))) for i in range(25)] + [(90, ""), (91, None), (92, "One Two"), (93, "rep " * 30)]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if d % 2:
            part = (r.choice(items)[1] or "").split()
            if d % 4 == 3 and part:
                part[0 if d % 8 == 3 else -1] = "edited"
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() for w in part]
        docs.append((d, "  \n".join(words)))
    docs += [docs[1], (None, items[0][1]), (70, None), (71, ""), (72, "one\ttwo"), (73, "x " * 3_000 + items[3][1] + " y" * 3_000)]
    got = decontaminate.leaks(spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((g.doc_id, g.item_id, g.first_word, g.n_words) for g in got), key=str) == brute_leaks(docs, items)


def test_items_in_several_passes_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (None, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 5)
    assert sorted((g.doc_id, g.item_id) for g in decontaminate.leaks(docs, items).collect() if g.doc_id) == [(1, 1), (2, 2)]
    assert decontaminate.drop_leaking(docs, items).collect() == []
    assert decontaminate.leaks(docs.limit(0), items).collect() == [] and decontaminate.leaks(docs, items.limit(0)).collect() == []


def test_multi_index_finds_all_fingerprints_within_the_radius():
    r = random.Random(2)
    made = decontaminate.Items([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(40)], 5, 0.8, 15)
    for _ in range(300):
        i, flips = r.randrange(40), r.sample(range(64), r.randint(0, 15))
        value = int(made.prints[i]) ^ sum(1 << b for b in flips)
        found = {item for _, item in made.candidates(30, np.array([value], np.uint64))}
        assert found == {k for k in range(40) if (int(made.prints[k]) ^ value).bit_count() <= 15}


def test_texts_shorter_than_the_item(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([50, 40, 30, 6, 3, 58])]
    cut = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [(0, cut(0, 0, 47)), (1, cut(1, 1, 40)), (2, cut(2, 1, 29)), (3, cut(0, 0, 25)), (4, cut(3, 0, 5)), (5, cut(4, 0, 2)), (6, cut(5, 0, 50).upper()), (7, cut(0, 0, 49) + "\n"), (None, cut(0, 2, 50))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((g.doc_id, g.item_id, g.first_word, g.n_words) for g in decontaminate.leaks(*frames).collect()), key=str)
    assert got == sorted([(0, 0, 0, 47), (1, 1, 0, 39), (2, 2, 0, 28), (6, 5, 0, 50), (7, 0, 0, 49), (None, 0, 0, 48)], key=str)
    assert sorted(d.doc_id for d in decontaminate.drop_leaking(*frames).collect()) == [3, 4, 5]


def test_leaking_rows_go_and_rows_that_share_their_id_stay(spark):
    item = "one two three four five six seven eight"
    rows = [(1, item, "a"), (1, "another text that leaks nothing at all", "b"), (None, f"x {item} y", "c"), (None, "clean words without an id here", "d"), (2, None, "e"), (1, item, "f"), (3, "twice the same clean row", "g"), (3, "twice the same clean row", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    out = decontaminate.drop_leaking(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r.k1 for r in out.collect()) == ["b", "d", "e", "g", "g"]


def brute_chain(rows, labels):
    """The chain by loops over rows: models[k] = (bias, {place: weight}, extra), and the threshold."""
    n, k_all, odds = len(rows), len(labels[0]), [[] for _ in rows]
    fit_of = {f: [i for i in range(n) if rows[i][1] != f] for f in range(toxicity.FOLDS + 1)}

    def fit(part, y):
        m, ones = len(part), sum(y[i] for i in part)
        bias, extra = math.log((ones + 0.5) / (m - ones + 0.5)), [0.0] * len(odds[0])
        if ones in (0, m):
            return bias, {}, extra
        both, pos = Counter(p for i in part for p in rows[i][0]), Counter(p for i in part if y[i] for p in rows[i][0])
        ratio = {p: math.log((pos[p] / ones + 4 / m) / ((c - pos[p]) / (m - ones) + 4 / m)) for p, c in both.items() if c > 2}
        ratio = {p: x for p, x in ratio.items() if abs(x) > 0.7}
        w, g2 = dict.fromkeys(ratio, 0.3), dict.fromkeys(ratio, 1e-8)
        v, h2 = [*extra, bias], [1e-8] * (len(extra) + 1)
        for _ in range(120):
            gw, gv = {p: 1e-3 * w[p] / len(w) for p in w}, [0.0] * len(v)
            for i in part:
                x = [*odds[i], 1.0]
                z = sum(w[p] * ratio[p] for p in rows[i][0] if p in w) + sum(a * b for a, b in zip(v, x))
                e = (1 / (1 + math.exp(-max(-35, min(35, z)))) - y[i]) / m
                for p in rows[i][0]:
                    if p in w:
                        gw[p] += e * ratio[p]
                gv = [g + e * a for g, a in zip(gv, x)]
            for p in w:
                g2[p] += gw[p] ** 2
                w[p] = max(0.0, w[p] - 0.3 * gw[p] / math.sqrt(g2[p]))
            h2 = [h + g * g for h, g in zip(h2, gv)]
            v = [a - 0.3 * g / math.sqrt(h) for a, g, h in zip(v, gv, h2)]
        return v[-1], {p: w[p] * ratio[p] for p in w}, v[:-1]

    models = []
    for k in range(k_all):
        y, made = [x[k] for x in labels], {f: fit(part, [x[k] for x in labels]) for f, part in fit_of.items()}
        out = [made[rows[i][1]] for i in range(n)]
        odds = [[*odds[i], max(-35, min(35, b + sum(w.get(p, 0) for p in rows[i][0]) + sum(a * o for a, o in zip(e, odds[i]))))] for i, (b, w, e) in enumerate(out)]
        models.append(made[toxicity.FOLDS])
    p, y = [1 / (1 + math.exp(-o[-1])) for o in odds], [x[-1] for x in labels]
    best = max(((2 * sum(y[i] for i in range(n) if p[i] >= t) / (sum(q >= t for q in p) + sum(y)), t) for t in set(p)), default=None)
    below = [q for q in p if q < best[1]]
    return models, (best[1] + max(below, default=0.0)) / 2


def test_the_chain_equals_loops_over_rows(spark):
    rows, labels = toxic_rows(90, seed=9)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    chain = toxicity.fit_chain(docs, known)
    from pyspark.sql import functions as F

    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    import pyarrow as pa

    lists = toxicity.places(pa.array([t for _, t in rows]))
    models, threshold = brute_chain([(x.tolist(), fold[i]) for x, (i, _) in zip(lists, rows)], [x[1:3] for x in labels])
    for got, (bias, weights, extra) in zip(chain.models, models, strict=True):
        assert np.allclose([got.bias, *got.extra], [bias, *extra]) and dict.fromkeys(got.names.tolist()) == dict.fromkeys(sorted(weights))
        assert np.allclose(got.weights, [weights[p] for p in sorted(weights)])
    assert abs(chain.threshold - threshold) < 1e-9


def test_columns_of_the_result_are_made_new(spark):
    rows, labels = toxic_rows(60)
    docs = spark.createDataFrame([(*r, "mine", "x") for r in rows], "doc_id long, text string, toxic string, row string")
    out = toxicity.flag_toxic(docs, toxicity.fit_chain(docs, spark.createDataFrame(labels, LABELS)))
    assert dict(out.dtypes)["toxic"] == "boolean" and sorted(out.columns) == sorted([*docs.columns, "p_quality", "p_toxic"])
    assert toxicity.flag_toxic(docs.limit(0), toxicity.fit_chain(docs.limit(0), spark.createDataFrame(labels, LABELS))).collect() == []


def test_several_passes_give_the_results_of_one(spark, monkeypatch):
    """Items share passages across passes, and windows hold passages of other items, so that weights decide near 0.8."""
    r = random.Random(8)
    fresh = lambda n: [f"t{r.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(20) for _ in range(3)]
    items = [(i, " ".join(fresh(20) + shared[i % 3])) for i in range(30)] + [(40, "")]
    docs = []
    for d in range(120):
        words = items[d % 30][1].split()
        cut = 1 + d // 30
        words[-cut:] = shared[(d + 1) % 3][:cut] if d % 2 else fresh(cut)
        words[:cut] = shared[(d + 2) % 3][-cut:]
        docs.append((d, " ".join(fresh(5) + words + shared[d % 3] + fresh(5))))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(g) for g in decontaminate.leaks(*frames).collect())
    one = found()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", sum(len(t) for _, t in items) // 6)
    assert one and found() == one
