import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("rillgrid.llm")
from rillgrid.llm import line_dedup, sharding
from rillgrid.llm.common import BLANKS

SCHEMA = "doc_id long, text string, docs string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)


def key(line):
    return line.strip(BLANKS).encode().lower().decode()


def brute(rows, min_docs, min_chars):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in seen.items() if n >= min_docs and len(k) >= max(1, min_chars)}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    r = random.Random(3)
    pool = ["Same Line", " same line\t", "é É", "", "   ", "a", "LONG " * 300, "tail\r", "tail", "x y", "\x0bq", " wide"]
    rows = [(i, "\n".join(r.choice([*pool, f"own {i} {r.random()}"]) for _ in range(r.randint(1, 9)))) for i in range(80)]
    return [*rows, rows[0], rows[0], (None, None), (None, "Same line"), (900, ""), (901, "\n\n"), (902, None), (903, "z\n" * 5000)]


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 5), (1, 1)])
def test_common_lines_go_everywhere(spark, min_docs, min_chars):
    rows = line_rows()
    got = line_dedup.drop_common_lines(frame(spark, rows), min_docs, min_chars, batches=5)
    assert got.columns == ["doc_id", "text", "docs", "shard", "n_lines", "n_dropped"]
    order = lambda x: sorted(x, key=str)
    assert order((g.doc_id, g.text, g.n_lines, g.n_dropped) for g in got.collect()) == order(brute(rows, min_docs, min_chars))


def test_runs_are_levelled_sorted_and_sum_up(spark):
    rows = line_rows()
    runs, _ = line_dedup.count_batches(frame(spark, rows), 9)
    assert [len(x) for x in runs.levels] == [1, 2]
    want = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    assert sorted(r.docs for r in runs.totals().collect()) == sorted(want.values())
    part = spark.read.parquet(runs.levels[0][0]).toPandas()
    assert len(part) == len(part.drop_duplicates(["h1", "h2"]))


def test_settled_keys_are_not_written_again(spark):
    rows = [(i, f"same\nown {i}") for i in range(400)]
    runs, _ = line_dedup.count_batches(frame(spark, rows), 8, enough=10)
    assert runs.totals().count() == 401 and runs.known(10).count() == 1
    assert sum(spark.read.parquet(p).count() for level in runs.levels for p in level) < 401 + 4


def test_columns_of_the_counts_are_made_new_or_left(spark):
    docs = spark.createDataFrame([(i, "a\na", "mine", "x.y") for i in range(12)], "doc_id long, text string, n_lines string, `p.q` string")
    out = line_dedup.drop_common_lines(docs, 10)
    assert sorted(out.columns) == ["doc_id", "n_dropped", "n_lines", "p.q", "text"] and {(r.text, r.n_lines, r.n_dropped) for r in out.collect()} == {("", 2, 2)}
    assert {r.n_lines for r in line_dedup.drop_common_lines(docs, 10, counts=False).collect()} == {"mine"}


def test_stream_batches_drop_what_came_before(spark):
    runs = line_dedup.LineRuns(spark)
    out = [line_dedup.dedup_stream_batch(runs, frame(spark, rows)).collect() for rows in ([(1, "a\nb"), (2, "a")], [(3, "B\nc"), (4, None)], [(5, "c\nd")])]
    assert [sorted(r.text for r in o) for o in out] == [["a", "a\nb"], ["", "c"], ["d"]]


def test_no_documents(spark):
    assert line_dedup.drop_common_lines(frame(spark, []), 10).collect() == []
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for g in got:
        by[g.shard].append(g.slot)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == want


def test_shards_are_even_and_keep_groups_together(spark):
    rows = [(i, f"single {i}") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(2000 + i, f"some {i // 9}") for i in range(180)]
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    where = defaultdict(set)
    for g in got:
        where[g.text_crc32].add(g.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 3
    placed = sharding.shard_documents(frame(spark, rows), 8)
    crc = defaultdict(Counter)
    for g in placed.collect():
        crc[g.text_crc32][g.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    links, kept = sum(pairs(sum(c.values())) for c in crc.values()), sum(pairs(n) for c in crc.values() for n in c.values())
    assert tuple(sharding.cut_links(placed).first()) == (links, links - kept) and links - kept < 0.05 * links


def test_a_group_of_a_third_of_the_rows_is_split_over_few_shards(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t {i}") for i in range(790)] + [(None, None)] * 7 + [(3, "hot")] * 3
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    assert len({g.shard for g in got if g.text_crc32 == zlib.crc32(b"hot")}) <= 5


@pytest.mark.parametrize("rows", [[(1, "a")], [(1, None), (1, None)], [(i, "same") for i in range(20)]])
def test_few_rows(spark, rows):
    check_shards(rows, sharding.shard_documents(frame(spark, rows), 8).collect(), 8)
