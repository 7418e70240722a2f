import numpy as np
import pytest

pytest.importorskip("rillgrid.llm")

from rillgrid.llm import minhash_join, ngram_join
from tests.llm.test_ngram_join import brute, corpus


@pytest.mark.parametrize("seed, n, width, percent, frequent", [(1, 90, 3, 85, 8), (2, 120, 3, 85, 1), (3, 120, 2, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, width, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = corpus(seed, n)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, cid string")
    got = minhash_join.near_duplicates(df, width, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(d, size, c, d == c) for d, size, c in brute(rows, width, percent)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(5)
    agreed = []
    for _ in range(30):
        x = r.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = x[:350], x[50:]  # 300 of 400 in both
        agreed.append((minhash_join.signature(a) == minhash_join.signature(b)).mean())
    assert abs(np.mean(agreed) - 0.75) < 0.02


def test_coordinates_are_one_permutation_shifted():
    rows = minhash_join.shifted(5)
    assert (rows[7] == [rows[7 + k][0] for k in range(5)]).all() and rows[minhash_join.UNIVERSE - 1][1] == rows[0][0]
    one = minhash_join.signature(np.array([3], np.uint64), 5)
    assert (one == rows[np.flatnonzero(rows[:, 0] == one[0])[0]]).all()


def test_bands_meet_at_the_threshold():
    """Pairs of 85 % exactly share a band."""
    r = np.random.default_rng(6)
    for _ in range(300):
        x = r.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = x[:185], np.concatenate([x[15:]])  # 170 of 200
        assert (minhash_join.bands(a) == minhash_join.bands(b)).any()


def test_no_documents(spark):
    assert minhash_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = minhash_join.near_duplicates(spark.createDataFrame([(1, None), (2, " "), (None, None)], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
