import json
import random

import pytest

pytest.importorskip("rillgrid.llm")
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillgrid.llm import byte_bpe, token_count
from rillgrid.llm.common import Seen

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n", "aaa" * 50, "a" * 3000, "Straße ÉTÉ", "é x", " a b​c\x1cd\x85e", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "it's we'LL", "日本語 😀 12345", "�\x00z", "à̖", "İi̇"]


def texts(n=400):
    r, parts = random.Random(7), ["a", "b", "the", "ing", "é", "ß", "日", "😀", " ", "  ", "\n", "'s", "12", "...", "-", "́", "<|endoftext|>", "Ab"]
    return ODD + ["".join(r.choice(parts) * r.randint(1, 4) for _ in range(r.randint(1, 40))) for _ in range(n)]


def frame(spark, values):
    rows = [(i, t, "clash") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_token_counts_equal_the_library(spark):
    values = [*texts(), None, "long text " * 40_000]
    got = frame(spark, values).select("doc_id", token_count.token_count(F.col("text"), WORDS).alias("n")).collect()
    library = Tokenizer.from_file(WORDS)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in values]
    assert [r.n for r in sorted(got)] == want


def test_the_store_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(Seen, "HALF_BYTES", 500)
    library, merger, encoder = Tokenizer.from_file(WORDS), token_count.Merger(WORDS), byte_bpe.Encoder(RANKS, P.PATTERN)
    for batch in (["one two three four five"], ["one six", "two " + "x" * 5000], ["seven one", ""], ["eight nine ten", "two\none"], ["y" * 5000 + " one"]):
        assert merger.count(batch) == [len(library.encode(t).ids) for t in batch]
        assert [x.tolist() for x in encoder.encode(batch)] == [tik().encode_ordinary(t) for t in batch]
        assert len(merger.seen) < 9 and len(merger.seen.old) < 9
    merger.seen.unknown([])
    assert max(map(len, merger.seen)) < 100


def test_other_patterns_and_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        byte_bpe.Encoder(RANKS, r"[^\n]+|\n")
    said = json.loads(open(WORDS, encoding="utf-8").read())
    said["pre_tokenizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError):
        token_count.Merger(str(tmp_path / "other.json"))


def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_ids_equal_tiktoken_and_come_back(spark):
    values = [*texts(), None, "long text " * 40_000, "x" * 20_000]
    coded = frame(spark, values).withColumn("own", byte_bpe.encode(F.col("text"), RANKS, P.PATTERN))
    out = coded.select("doc_id", "own", byte_bpe.decode(F.col("own"), RANKS, P.PATTERN).alias("raw"), byte_bpe.decode_text(F.col("own"), RANKS, P.PATTERN).alias("back"), byte_bpe.offsets(F.col("own"), RANKS, P.PATTERN).alias("spans")).collect()
    library = tik()
    for r in out:
        t = values[r.doc_id]
        if t is None:
            assert r.own is None and r.raw is None and r.back is None and r.spans is None
            continue
        assert r.own == library.encode_ordinary(t) and bytes(r.raw) == t.encode() and r.back == t
        if r.own:
            _, begins = library.decode_with_offsets(r.own)
            assert [s.begin for s in r.spans] == begins and r.spans[-1].end == len(t)


def test_round_trip_is_encode_then_decode(spark):
    values = [*texts(50), None]
    two = byte_bpe.encode(F.col("text"), RANKS, P.PATTERN)
    coded = frame(spark, values).select(two.alias("ids"), byte_bpe.decode(two, RANKS, P.PATTERN).alias("raw"), byte_bpe.round_trip(F.col("text"), RANKS, P.PATTERN).alias("c"))
    assert coded.where("NOT (c.ids <=> ids AND c.decoded <=> raw)").count() == 0


def test_split_characters_and_unknown_ids(spark):
    ids = tik().encode_ordinary("a日本😀")
    assert "".join(byte_bpe.pieces(ids, RANKS, P.PATTERN)) == "a日本😀"
    assert byte_bpe.pieces(ids[:-1], RANKS, P.PATTERN)[-1].endswith("�") and byte_bpe.pieces([], RANKS, P.PATTERN) == []
    df = spark.createDataFrame([([*tik().encode_ordinary("a"), 10**6, None, -5],)], "ids array<int>")
    got = df.select(byte_bpe.decode_text(F.col("ids"), RANKS, P.PATTERN).alias("t")).first().t
    assert got.count("�") == 3


def test_empty_tables(spark):
    none = frame(spark, [])
    assert none.select(token_count.token_count(F.col("text"), WORDS)).collect() == []
    assert none.select(byte_bpe.decode(byte_bpe.encode(F.col("text"), RANKS, P.PATTERN), RANKS, P.PATTERN)).collect() == []
