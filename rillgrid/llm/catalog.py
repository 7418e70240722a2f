"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, byte_bpe, decontaminate, line_dedup, minhash_join, ngram_join, sharding, spelling, token_alignment, token_count, toxicity, url_filter, warc
from .common import new_folder, small_batches, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
TOKEN_LIMIT = 2048


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_count.token_count(F.col("text"), public_tokenizers.path(WORD_BPE)))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns digests of both."""
    small_batches(spark)
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", byte_bpe.round_trip(F.coalesce("text", F.lit("")), path, pattern).alias("coded"))
    back = coded.select("doc_id", "coded.ids", "coded.decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1, batches=4)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and indexes the archives in the shared folder, then reads all pages' URLs back through the directory and the index."""
    pages, folder = table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc")
    warc.write_archives(pages, f"{folder}/archives", F.col("html"), min_bytes=0)
    warc.build_index(spark, f"{folder}/archives", f"{folder}/index")
    return warc.read_archives(spark, f"{folder}/archives", f"{folder}/index", pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


OP10_SQL = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_counts": op2_token_counts,
        "op3_top_k": bm25.op3_top_k,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_sharding": op8_sharding,
        "op9_line_dedup": op9_line_dedup,
        "op10_warc": op10_warc,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_minhash": minhash_join.op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": ngram_join.OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op12_spelling_variants": spelling.OP12_SQL, "op13_minhash": minhash_join.OP13_SQL}
