import hashlib

import pytest

pytest.importorskip("rillgrid.llm")
import corpus_pipeline
import tiktoken
import public_tokenizers as P

from rillgrid.llm import byte_bpe, toxicity
from rillgrid.llm.common import table

from pyspark.sql import functions as F

from .test_lines_shards import brute as brute_lines
from .test_ngram_join import brute as brute_components
from .test_toxicity_leaks import brute_leaks

SMALL = "/root/testdata/sf0.001"


def test_the_pipeline_equals_brute_force(spark):
    docs, chain = table(spark, SMALL, "documents"), toxicity.fit_chain(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    rows = [(r.doc_id, r.text) for r in toxicity.flag_toxic(docs, chain).where("NOT toxic").collect()]
    rows = [(i, t) for i, t, *_ in brute_lines(rows, corpus_pipeline.MIN_LINE_DOCS, 1)]
    first = {d for d, n, c in brute_components(rows, 5, 80) if d == c or n == 0}
    rows = [x for x in rows if x[0] in first]
    gone = {d for d, *_ in brute_leaks(rows, [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()])}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows if i not in gone)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids, r.text_sha256) for r in got) == want and 0 < len(want) < 200


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SMALL, "documents").limit(5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, SMALL).dtypes) == sorted(docs.dtypes)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_stages_take_odd_rows(spark):
    """Null ids and texts, repeated rows and ids, very long texts and clashing columns, each stage against brute force."""
    known = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").limit(40).collect()]
    item = table(spark, SMALL, "benchmark").where("text IS NOT NULL").first().text
    rows = known + [known[3], known[3], (known[4][0], known[5][1]), (None, known[6][1]), (None, item), (known[7][0], f"x {item} y"), (None, None), (8001, None), (8002, ""), (8003, "own words " * 30_000), (None, "a text without an id and without a copy"), (known[7][0], "a text that only shares its id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "theirs", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines string, toxic string, k1 int")
    stage = dict(corpus_pipeline.STAGES)
    order = lambda x: sorted(x, key=str)
    pairs = lambda df: order((r.doc_id, r.text) for r in df.collect())
    for name in list(stage)[:-1]:
        assert sorted(stage[name](spark, docs, SMALL).dtypes) == sorted(docs.dtypes)
    chain = toxicity.fit_chain(docs, table(spark, SMALL, "labels"))
    flags = toxicity.flag_toxic(docs.drop("toxic"), chain)
    assert pairs(stage["toxicity"](spark, docs, SMALL)) == pairs(flags.where("NOT toxic"))
    kept = stage["line_dedup"](spark, docs, SMALL)
    assert pairs(kept) == order((i, t) for i, t, *_ in brute_lines(rows, corpus_pipeline.MIN_LINE_DOCS, 1)) and {r.n_lines for r in kept.collect()} == {"mine"}
    assert kept.where(F.col("n_chars") != F.char_length("text")).count() == 0
    left, component = pairs(stage["ngram_join"](spark, docs, SMALL)), [(c, n) for _, n, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)]
    own = {d: (c, n) for d, n, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)}
    groups = {c for c, n in own.values() if n}
    assert len(component) == len(rows) and len(left) == len(groups) + sum(n == 0 for _, n in own.values())
    for c in groups:
        members = [rows[k] for k in own if own[k][0] == c and own[k][1]]
        least = min((i is None, i or 0) for i, _ in members)
        assert any((i is None, i or 0) == least for i, t in members if (i, t) in left)
    leaks = {(rows[k][0], rows[k][1]) for k, *_ in brute_leaks([(k, t) for k, (_, t) in enumerate(rows)], [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()])}
    assert (None, item) in leaks and pairs(stage["decontamination"](spark, docs, SMALL)) == order(x for x in rows if x not in leaks)
    coded = stage["byte_bpe"](spark, docs, SMALL)
    assert coded.count() == len(rows) and coded.where("doc_id = 8003").first().text_sha256 == hashlib.sha256(("own words " * 30_000).encode()).hexdigest()
