"""The corpus pipeline: STAGES over documents, each stage's result written and read as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from rillgrid.llm.common import small_batches, stored, table

MIN_LINE_DOCS, BYTE_BPE = 10, "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain flags go; those without a text or an id are judged like others, and equal rows alike."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    score = toxicity.probabilities(F.col("text"), chain, spark)[len(chain.categories) - 1]
    return docs.where(~(score > chain.threshold))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that MIN_LINE_DOCS or more documents share go; n_chars follows the text. Each row counts as a document; a null text
    becomes the empty one."""
    kept = line_dedup.drop_common_lines(docs, MIN_LINE_DOCS, counts=False)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest id, those without an id last. Documents without
    words stay, and so do other texts under an id that goes."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also those without an id; other texts under their id stay."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text (null: empty); decoding them gives the text's bytes again, and its digest says so."""
    small_batches(spark)
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    coded = docs.select("doc_id", "lang", "source", byte_bpe.round_trip(F.coalesce("text", F.lit("")), path, pattern).alias("coded"))
    back = coded.select("doc_id", "lang", "source", "coded.ids", "coded.decoded")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL cannot express the classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", before)
        before = [docs]
    return docs
