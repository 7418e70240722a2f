import hashlib
from collections import Counter

import pytest

pytest.importorskip("rillgrid.llm")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from rillgrid.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Token by token, with byte ranges compared one with another."""
    made, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    made.encode_special_tokens = True
    of = token_alignment.byte_table()
    found = []
    for _, text in rows:
        a = made.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        x = [bytes(of[c] for c in made.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            found.append(([], [], "", []))
            continue
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        xs, ys = spans(x), spans(y)
        links = [(a[i], b[j]) for i, (p, q) in enumerate(xs) for j, (r, s) in enumerate(ys) if max(p, r) < min(q, s)]
        cuts = sorted({q for _, q in xs} & {s for _, s in ys})
        groups = [(",".join(str(a[i]) for i, (p, q) in enumerate(xs) if lo < q <= hi), ",".join(str(b[i]) for i, (p, q) in enumerate(ys) if lo < q <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        found.append((a, b, ";".join("|".join(g) for g in groups), links))
    count = Counter(pair for *_, links in found for pair in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (d, len(a), len(b), g.count("|"), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for (d, _), (a, b, g, links) in zip(rows, found)
    ]


TEXTS = [
    "The quick brown fox", "the quick  brown\nfox été", "the quick  brown\nfox été", "", None, " ", "   lead and trail  ", "<|endoftext|> is <s> plain </s> <unk>", "a▁b stands for space",
    "你好 world \U0001f600 ok", "tabs\tand\r\nlines\n\n\nend", "can't won't I'll x's 's", "12345 67 !?;: -- ''", " nbsp　wide", "é combining a ́x", "supercalifragilistic " * 40, "The quick brown fox",
]


@pytest.mark.parametrize("pairs", [1 << 19, 40, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, pairs):
    """pairs: how many counts are sent; the others come by the join."""
    monkeypatch.setattr(token_alignment, "PAIRS", pairs)
    rows = [*enumerate(TEXTS), (None, "The quick brown fox"), (None, None), (3, "another text under id 3")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k1 int, pair string")
    got = token_alignment.align(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_pieces_equal_whole_texts():
    """Groups of texts cut at safe spaces are those of the whole text, also when the store is emptied in between."""
    ours = token_alignment.Aligner(A, B)
    ours.seen.HALF_BYTES = 5000
    for _ in range(2):
        got = [m[:5] for m in ours.measures([t or "" for t in TEXTS])]
        want = [(a, b, g, n, sha) for _, a, b, g, n, _, _, sha in brute(list(enumerate(TEXTS)))]
        assert got == want


def test_no_documents(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [tuple(r) for r in token_alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_large_text_is_aligned_whole(spark):
    text = " ".join(f"word{i} élève{i % 7}" for i in range(60_000))
    r = token_alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    made = Tokenizer.from_file(A)
    assert r.n_a == len(made.encode(" " + text).ids) and r.n_links == r.n_a + r.n_b - r.n_groups
