import datetime as dt

import numpy as np
import pytest

from rillgrid.streaming import follow, ledger, stacks

SCHEMA = "name string, score int"
READ = f"{SCHEMA}, date timestamp"


def put(spark, folder, *rows, schema=SCHEMA):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))


def names(book):
    return sorted(r.name for r in book.read(READ).collect())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "t"))
    assert book.read(READ).collect() == []
    rows = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    assert book.append(rows, 0) and not book.append(rows, 0) and book.append(rows, 1)
    assert names(book) == ["a", "a", "b", "b"] and all(r.date is not None for r in book.read(READ).collect())
    assert ledger.Ledger(spark, str(tmp_path / "t"), "other").append(rows.limit(1), 0)
    assert len(names(book)) == 5 and [e["stream"] for e in book.entries()] == ["main", "main", "other"]


def test_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    """Before the ledger: the batch is written over. After the ledger, before the stream's own commit: it is left alone."""
    put(spark, tmp_path / "in", ("a", 1), ("b", 2))
    source = lambda: follow.follow_table(spark, str(tmp_path / "in"), SCHEMA, files_a_batch=1)
    run = lambda: ledger.append_once(source(), str(tmp_path / "t"), str(tmp_path / "check")).awaitTermination(120)
    book = ledger.Ledger(spark, str(tmp_path / "t"))
    enter = ledger.Ledger.enter

    def fails_before(self, batch):
        raise RuntimeError("lost before the ledger")

    def fails_after(self, batch):
        enter(self, batch)
        raise RuntimeError("lost after the ledger")

    for broken, seen in ((fails_before, []), (fails_after, ["a", "b"])):
        monkeypatch.setattr(ledger.Ledger, "enter", broken)
        with pytest.raises(Exception, match="lost"):
            run()
        assert names(book) == seen
    monkeypatch.setattr(ledger.Ledger, "enter", enter)
    put(spark, tmp_path / "in", ("c", 3))
    run()
    assert names(book) == ["a", "b", "c"]
    run()
    assert names(book) == ["a", "b", "c"]


T0 = dt.datetime(2024, 1, 1)
CCS = "pair string, ts timestamp, data array<double>"


def day(pair, at, *data):
    return (pair, T0 + dt.timedelta(days=at), [float(x) for x in data])


def run(spark, tmp_path, out, idle_days=30.0):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stacks.STORE)
    stream = stacks.running_stacks(follow.follow_table(spark, str(tmp_path / "in"), CCS, files_a_batch=1), "2 days", idle_days * 86400)
    query = stream.writeStream.foreachBatch(lambda df, batch: out.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)


def test_running_stacks_resume_and_leave_late_rows_out(spark, tmp_path):
    out: list = []
    put(spark, tmp_path / "in", day("ab", 0, 1, 2, 3), day("ab", 1, 3, 2, 1), day("cd", 1, 5, 5, 5), schema=CCS)
    run(spark, tmp_path, out)
    first = {r.pair: r for r in out if not r.closed}
    assert first["ab"].n == 2 and first["ab"].stack == [2, 2, 2] and first["ab"].likeness is None and first["ab"].latest == T0 + dt.timedelta(days=1)
    put(spark, tmp_path / "in", day("ab", 9, 8, 2, 2), ("ab", None, [9.0, 9.0, 9.0]), ("ab", T0, None), schema=CCS)
    run(spark, tmp_path, out)  # a new query on the same checkpoint goes on from the state
    assert [r.n for r in out if r.pair == "ab"][-1] == 3 and [r.stack for r in out if r.pair == "ab"][-1] == [4, 2, 2]
    assert abs([r.likeness for r in out if r.pair == "ab"][-1] - np.dot([2, 2, 2], [8, 2, 2]) / np.sqrt(12 * 72)) < 1e-12
    put(spark, tmp_path / "in", day("ab", 2, 100, 100, 100), day("ab", 10, 0, 2, 2), schema=CCS)  # day 2 lies before the watermark (day 7)
    run(spark, tmp_path, out)
    last = [r for r in out if r.pair == "ab"][-1]
    assert last.n == 4 and last.stack == [3, 2, 2]


def test_stacks_of_many_batches_equal_one_batch_and_idle_pairs_are_closed(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [day("xy" if i % 3 else "zz", i / 10, *r.normal(size=4)) for i in range(12)]
    many, one = [], []
    for at in range(0, 12, 4):
        put(spark, tmp_path / "a" / "in", *rows[at : at + 4], schema=CCS)
    put(spark, tmp_path / "b" / "in", *rows, schema=CCS)
    run(spark, tmp_path / "a", many)
    run(spark, tmp_path / "b", one)
    for pair in ("xy", "zz"):
        want = np.mean([x[2] for x in rows if x[0] == pair], axis=0)
        for out in (many, one):
            last = [x for x in out if x.pair == pair][-1]
            assert np.allclose(last.stack, want) and last.n == sum(x[0] == pair for x in rows)
    put(spark, tmp_path / "a" / "in", day("xy", 60, 0, 0, 0, 0), schema=CCS)
    put(spark, tmp_path / "a" / "in", day("xy", 61, 0, 0, 0, 0), schema=CCS)
    many.clear()
    run(spark, tmp_path / "a", many)
    assert [(x.pair, x.n) for x in many if x.closed and x.pair == "zz"] == [("zz", 4)]
