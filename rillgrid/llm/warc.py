"""WARC archives of pages, with a two-level capture index.

Each page becomes one WARC record in a gzip member of its own. Spark's text writer puts the members into files of about
FILE_BYTES, with an empty gzip member as line separator, so archives can be written to any file system that Spark knows and are
valid .warc.gz content. Of pages with equal payloads (by SHA-1 and length) the one with the largest id is a `response`, the
others are `revisit` records that name it; a revisit keeps the HTTP head, and with it the payload's length.

The capture index sorts one line a record by its URL key (reversed host, then path), range partitioned; blocks of lines are
compressed, and a sparse directory keeps each block's first and last key. A lookup takes a table of URLs of any size: each key finds
its place among at most FENCES keys of the directory by binary search, joins the directory's rows from there on, opens the blocks
that these name, and reads the records' byte ranges. Files meet the lists of their ranges in a shuffle of compressed content.

Cases: a null payload is empty, a null URL gives a record without target; line breaks in URLs are percent-encoded; null ids
are allowed (they never are a group's response unless all its ids are null, when all are responses); equal rows of the largest
id are all responses; records without id, and equal ones, share a WARC-Record-ID; very long pages have a file of their own; an
empty table gives an empty archive and index; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import admitted, bit_filter, delete, stored

SALTS = 32
#: About this many bytes of compressed records make a file, and this many lines an index block.
FILE_BYTES, BLOCK_LINES = 8 << 20, 3000
#: Keys of the directory that are sent to all executors, whatever its size.
FENCES = 1 << 16
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:rillgrid:page:"
ARCHIVE_SCHEMA = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX_FIELDS = ["key", "path", "offset", "length", "page_id", "record_type", "payload_digest"]
INDEX_SCHEMA = "key string, path string, offset long, length long, page_id long, record_type string, payload_digest string"
INDEX_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """The sort key: host labels in reverse order, then the rest of the URL as records have it."""
    if not url:
        return ")"
    rest = one_line(url).split("://", 1)[-1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, port = (rest[:end].lower().rsplit("@", 1)[-1], "")
    if ":" in host:
        host, port = host.rsplit(":", 1)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest[end:]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, kind: str, refers_to, sha1: str, date: str = DATE) -> bytes:
    """One uncompressed WARC record."""
    name = lambda i: f"<{NAME}{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + one_line(url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; its payload is None for a revisit."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(NAME)) else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None, "payload_bytes": size,
    }


def members(content: bytes, window: int = 1 << 16):
    """(offset, length, data) of each gzip member that is not empty."""
    view, at = memoryview(content), 0
    while at < len(view):
        reader, parts, end = zlib.decompressobj(31), [], at
        while not reader.eof:
            if end >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(reader.decompress(view[end : end + window]))
            end += window
        end = min(end, len(view)) - len(reader.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, payload) with sha1, record_type and refers_to. Only ids and hashes are grouped. Pages that a filter of
    fixed size admits as repeated meet the groups of more than one page under a salt; the others' payloads are not shuffled."""
    named = pages.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    groups = named.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.drop("n"), "warc-groups")
    name = F.xxhash64("sha1", "bytes")
    named = named.withColumn("asked", admitted(name, bit_filter(groups.select(name.alias("h")), "h"), pages.sparkSession))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = named.where("asked").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = asked.join(salted.hint("merge"), ["sha1", "bytes", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    fields = ["page_id", "url", "payload", "sha1"]
    alone = named.where("NOT asked").select(*fields, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(joined.select(*fields, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, payload: Column, min_bytes: int = 0) -> None:
    """Writes the archives below folder from pages(page_id, url) and their payloads (string or binary)."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))

    def members_of(batches):
        written = 0
        for batch in batches:
            for at in range(batch.num_rows):  # a record at a time, as large pages come in the same batch
                i, u, p, s, k, r = (c[at].as_py() for c in batch.columns)
                name = base64.b32encode(bytes.fromhex(s)).decode()
                data = gzip.compress(record(i, u, p, k, r, name), 6, mtime=0)
                yield pa.RecordBatch.from_arrays([pa.array([written // FILE_BYTES], pa.int32()), pa.array([data], pa.binary())], ["file", "value"])
                written += len(data)

    made = with_revisits(pages, min_bytes).mapInArrow(members_of, "file int, value binary").select("file", F.col("value").cast("string"))
    # text is written byte for byte; ISO-8859-1 only spells the separator's bytes
    made.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).partitionBy("file").text(folder)


def files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def build_index(spark: SparkSession, folder: str, index: str) -> None:
    """Reads all archives and writes index/blocks and index/directory."""

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = [(url_key(r["url"]), path.as_py(), at, size, r["page_id"], r["record_type"], r["payload_digest"]) for at, size, data in members(content.as_py()) for r in [parse(data)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES)], INDEX_FIELDS)

    def pack(batches):
        from pyspark import TaskContext

        part, made, lines = TaskContext.get().partitionId(), 0, []

        def block(lines):
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + made], "first_key": [lines[0][0]], "last_key": [lines[-1][0]], "lines": [len(lines)], "data": [data]}, pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            lines += zip(*[batch.column(c).to_pylist() for c in INDEX_FIELDS])
            while len(lines) >= BLOCK_LINES:
                yield block(lines[:BLOCK_LINES])
                made, lines = made + 1, lines[BLOCK_LINES:]
        if lines:
            yield block(lines)

    # stored, since finding the ranges reads the rows once more
    rows = stored(files(spark, folder).select("path", "content").mapInArrow(scan, INDEX_SCHEMA), "warc-captures")
    ordered = rows.repartitionByRange("key", "path", "offset").sortWithinPartitions("key", "path", "offset")
    ordered.mapInArrow(pack, "block long, first_key string, last_key string, lines long, data binary").write.parquet(f"{index}/blocks")
    blocks = spark.read.parquet(f"{index}/blocks").select("first_key", "last_key", "block")
    blocks.sortWithinPartitions("first_key").write.parquet(f"{index}/directory")
    delete(rows)


def captures(blocks: DataFrame) -> DataFrame:
    """The lines of index blocks(block, data), with their block."""

    def opened(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                rows = [json.loads(x) for x in zlib.decompress(data.as_py()).decode().split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), INDEX_TYPES))], ["block", *INDEX_FIELDS])

    return blocks.select("block", "data").mapInArrow(opened, f"block long, {INDEX_SCHEMA}")


def find_blocks(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """(key, block) for the keys of urls(url) and all blocks whose range of keys holds them. Blocks are numbered in the order of
    their keys, within each part of the range partitioning; each step-th of a part is a fence."""
    directory = spark.read.schema("first_key string, last_key string, block long").parquet(f"{index}/directory")
    step = max(1, -(-directory.count() // FENCES))
    fence = F.col("block") - F.pmod(F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(step))
    directory = directory.withColumn("fence", fence)
    top = directory.where("fence = block").select("first_key", "block").orderBy("first_key", "block").toArrow()  # FENCES and one a part
    sent = spark.sparkContext.broadcast((top.column("first_key").to_pylist(), top.column("block").to_pylist()))

    @F.arrow_udf("struct<key:string,fences:array<bigint>>")
    def placed(column: pa.Array) -> pa.Array:
        firsts, names = sent.value
        keys = [url_key(u) for u in column.to_pylist()]
        near = [names[max(0, bisect.bisect_left(firsts, k) - 1) : bisect.bisect_right(firsts, k)] for k in keys]
        return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(near, pa.list_(pa.int64()))], ["key", "fences"])

    wanted = urls.select("url").distinct().select(placed("url").alias("at")).select("at.key", F.explode("at.fences").alias("fence")).distinct()
    met = wanted.join(directory.hint("merge"), "fence").where((F.col("first_key") <= F.col("key")) & (F.col("key") <= F.col("last_key")))
    return met.select("key", "block")


def find_captures(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """The index lines of all captures of urls(url), opened from the blocks that hold their keys only."""
    asked = stored(find_blocks(spark, index, urls), "warc-asked")
    blocks = spark.read.parquet(f"{index}/blocks").join(asked.select("block").distinct().hint("merge"), "block", "left_semi")
    return captures(blocks).join(asked.hint("merge"), ["block", "key"], "left_semi")


def read_captures(spark: SparkSession, folder: str | list[str], found: DataFrame) -> DataFrame:
    """Reads the byte ranges of captures. A file meets the list of its own ranges, and only these are opened; the payload's
    length and digest come from its bytes, or from the record of a revisit."""

    def ranges(batches):
        for batch in batches:
            out = []
            for content, wanted in zip(batch.column("content"), batch.column("wanted")):
                view = memoryview(content.as_py())
                for one in wanted.as_py():
                    r = parse(gzip.decompress(view[one["offset"] : one["offset"] + one["length"]]))
                    full = r["payload"]
                    out.append((url_key(r["url"]), r["page_id"], r["url"], r["payload_bytes"] if full is None else len(full), r["payload_digest"] if full is None else digest(full), r["record_type"], r["refers_to"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])], ["key", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    lists = found.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))  # a file's records, bounded by its size
    return files(spark, folder).select("path", "content").join(lists.hint("merge"), "path").mapInArrow(ranges, ARCHIVE_SCHEMA)


def read_archives(spark: SparkSession, folder: str, index: str, urls: DataFrame) -> DataFrame:
    """The records of all captures of urls(url): directory, blocks, byte ranges."""
    return read_captures(spark, folder, find_captures(spark, index, urls))


def lookup(spark: SparkSession, folder: str, index: str, url: str, most_files: int = 1000) -> DataFrame:
    """The records of one URL. Only its files are loaded, unless they are more than most_files, when all are."""
    found = stored(find_captures(spark, index, spark.createDataFrame([(url,)], "url string")), "warc-found")
    paths = [r.path for r in found.select("path").distinct().limit(most_files + 1).collect()]
    if not paths:
        return spark.createDataFrame([], ARCHIVE_SCHEMA)
    return read_captures(spark, paths if len(paths) <= most_files else folder, found)
