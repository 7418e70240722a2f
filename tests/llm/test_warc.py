import base64
import gzip
import hashlib

import pytest

pytest.importorskip("rillgrid.llm")
from pyspark.sql import functions as F

from rillgrid.llm import warc
from rillgrid.llm.common import new_folder

ROWS = [
    (1, "http://A.example.com/x?y=1", "same"), (2, "http://b.example.com/", "same"), (3, "https://b.example.com:8080/q#f", "same"), (4, None, None), (5, "no scheme", ""),
    (6, "http://a.example.com/x?y=1", "é\r\n\r\nWARC/1.1\r\n" * 3), (7, "http://line\nbreak.org/\r", "z" * 300_000), (8, "http://b.example.com/", "once"), (None, "http://n.org", "null id"), (None, "http://n.org", "same"),
]


def brute(rows, min_bytes):
    by = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= min_bytes and i is not None:
            by[p] = max(i, by.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in by and len(p) >= min_bytes and by[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", by[p] if again else None))
    return sorted(out, key=str)


def made(spark, rows, min_bytes=0):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string")
    folder = new_folder(spark, "warc-test")
    warc.write_archives(pages, f"{folder}/a", F.col("html"), min_bytes)
    warc.build_index(spark, f"{folder}/a", f"{folder}/i")
    return f"{folder}/a", f"{folder}/i"


@pytest.mark.parametrize("min_bytes, file_bytes", [(0, 8 << 20), (5, 300)])
def test_round_trip(spark, monkeypatch, min_bytes, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    a, i = made(spark, ROWS, min_bytes)
    got = warc.read_archives(spark, a, i, spark.createDataFrame([(u,) for _, u, _ in ROWS], "url string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, min_bytes)


def test_archives_are_gzip_members_of_warc_records(spark):
    a, _ = made(spark, ROWS)
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in warc.files(spark, a).collect())
    assert whole.count(b"WARC-Record-ID") == len(ROWS) and whole.startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("fences", [1 << 16, 5, 1])
def test_lookup_reads_only_the_captures_of_a_url(spark, monkeypatch, fences):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "FENCES", fences)
    rows = [*ROWS, *((100 + k, f"http://h{k % 7}.org/{k % 13}", f"p{k}") for k in range(200))]
    a, i = made(spark, rows)
    assert spark.read.parquet(f"{i}/directory").count() > 50
    for url in ("http://h3.org/3", "http://b.example.com/", "http://a.example.com/x?y=1", "http://absent.org/"):
        want = sorted(str(r[0]) for r in rows if warc.url_key(r[1]) == warc.url_key(url))
        assert sorted(str(r.page_id) for r in warc.lookup(spark, a, i, url).collect()) == want
    some = spark.createDataFrame([("http://h3.org/3",), ("http://h3.org/3",), (None,), ("http://absent.org/",)], "url string")
    want = sorted(str(r[0]) for r in rows if r[1] in ("http://h3.org/3", None))
    assert sorted(str(r.page_id) for r in warc.read_archives(spark, a, i, some).collect()) == want


def test_blocks_that_no_key_asks_for_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    _, i = made(spark, [(k, f"http://h{k}.org/", "x") for k in range(60)])
    asked = warc.find_blocks(spark, i, spark.createDataFrame([("http://h7.org/",)], "url string")).collect()
    assert len(asked) == 1 and asked[0].key == "org,h7)/"


def test_empty_and_keys(spark):
    a, i = made(spark, [])
    assert warc.read_archives(spark, a, i, spark.createDataFrame([("http://a.b/",)], "url string")).collect() == []
    assert warc.url_key("http://WWW.a.com:80/B?c") == "com,a,www:80)/B?c" and warc.url_key(None) == ")"
