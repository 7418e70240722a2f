"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard given by a hash. In each round the linked documents
of a text count their neighbours by shard; those outside the shard where most neighbours are ask to move there. A shard
takes moves, small groups first, while its linked documents stay within its row quota; moves beyond it wait for the next
round, when only shards with room are asked. At last the row counts are made equal (at most one apart): what a shard holds
beyond its quota, documents without links first, fills the shards that lack rows. Groups larger than a shard spread over as
few shards as the rounds find. Rounds end when no move is granted, or after `rounds` of them; the law holds in any case, and
cut_links() says how many links then run between shards.

Requests and quotas are worked out on counts by (text, shard), not on documents. Ranks come from running counts over small
bins, so that no window holds a shard or a large group; a group's documents meet its counts under a salt.

Cases: a null text counts as empty; empty texts are equal texts; null and repeated ids are allowed (equal rows take any of
their places); an empty table gives an empty result; very long texts are hashed whole; other columns are left out, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key128, stored

SALTS = 64
#: Rows of a shard that a ranking bin holds at most, about; and the bins for groups.
BIN_ROWS, GROUP_BINS = 50_000, 64


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def prepare(docs: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One small row a document: id, size, crc, the text's 128-bit hash, the number of equal texts, the first shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    g1, g2 = key128(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), g1.alias("g1"), g2.alias("g2"),
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    groups = _salted(rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n_equal")).where("n_equal > 1"))
    return rows.join(groups.hint("merge"), ["g1", "g2", "salt"], "left").withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "doc_id", "g1"), F.lit(shards)).cast("int"))


def propagate(state: DataFrame, quota: list[int]) -> tuple[DataFrame, int]:
    """One round: the new state and how many moves were granted."""
    shards = len(quota)
    counts = state.where("n_equal > 1").groupBy("g1", "g2", "n_equal", "shard").agg(F.count(F.lit(1)).alias("n"))
    load = dict(counts.groupBy("shard").agg(F.sum("n")).collect())  # at most one row a shard
    room = [max(0, quota[s] - load.get(s, 0)) for s in range(shards)]
    strength = F.struct("n", F.xxhash64("g1", "shard").alias("tie"), "shard")
    best = counts.groupBy("g1", "g2").agg(F.max(F.when(_pick(room, F.col("shard")) > 0, strength)).alias("best"))
    asked = counts.withColumn("own", strength).join(best, ["g1", "g2"]).where(F.col("best") > F.col("own"))
    asked = asked.select("g1", "g2", "shard", "n", F.col("best.shard").alias("to"), F.floor(F.log2("n_equal")).cast("int").alias("class"), F.pmod("g2", F.lit(1024)).cast("int").alias("bin"))
    bins = asked.groupBy("to", "class", "bin").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.partitionBy("to").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("n").over(Window.partitionBy("to", "class", "bin").orderBy("g1", "g2", "shard").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.coalesce("before", F.lit(0)) + F.coalesce(inside, F.lit(0))
    granted = asked.join(bins.withColumn("before", before).drop("all"), ["to", "class", "bin"]).withColumn("ok", F.least("n", F.greatest(F.lit(0), _pick(room, F.col("to")) - ahead))).where("ok > 0")
    granted = stored(granted.select("g1", "g2", "shard", "to", (F.col("ok") / F.col("n")).alias("share"), "ok"), "shard-moves")
    moves = granted.agg(F.coalesce(F.sum("ok"), F.lit(0))).first()[0]
    if not moves:
        return state, 0
    chance = F.pmod(F.xxhash64(F.lit("share"), "doc_id", "size"), F.lit(1 << 20)) / (1 << 20)
    moved = state.join(_salted(granted.drop("ok")).hint("merge"), ["g1", "g2", "shard", "salt"], "left")
    moved = moved.withColumn("shard", F.when(chance < F.col("share"), F.col("to")).otherwise(F.col("shard"))).select(state.columns)
    return stored(moved, "shard-state"), moves


def even_rows(state: DataFrame, quota: list[int]) -> DataFrame:
    """state with shard and slot so that shard s has quota[s] rows, numbered from 0."""
    shards, rows = len(quota), sum(quota)
    parts = min(1 << 16, max(64, -(-rows // (shards * BIN_ROWS))))
    part = F.pmod(F.xxhash64(F.lit("bin"), "doc_id", "size"), F.lit(parts))
    group = F.when(F.col("n_equal") > 1, F.pmod("g1", F.lit(GROUP_BINS))).otherwise(F.lit(GROUP_BINS))
    binned = state.withColumn("bin", group * parts + part)
    sums = binned.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    start = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    held = dict(sums.groupBy("shard").agg(F.sum("n")).collect())  # at most one row a shard
    held = [held.get(s, 0) for s in range(shards)]
    over, lack = [max(0, h - q) for h, q in zip(held, quota)], [max(0, q - h) for h, q in zip(held, quota)]
    over_before, lack_before = [sum(over[:s]) for s in range(shards)], [sum(lack[:s]) for s in range(shards)]
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("g1", "g2", "doc_id", "text_crc32")) - 1
    ranked = binned.join(start, ["shard", "bin"]).withColumn("rank", F.col("before") + within)
    extra = F.col("rank") - _pick(quota, F.col("shard")) + _pick(over_before, F.col("shard"))
    target = F.coalesce(*[F.when((extra >= lack_before[s]) & (extra < lack_before[s] + lack[s]), F.lit(s)) for s in range(shards)])
    stays = F.col("rank") < _pick(quota, F.col("shard"))
    placed = ranked.withColumn("to", F.when(stays, F.col("shard")).otherwise(target)).withColumn("slot", F.when(stays, F.col("rank")).otherwise(_pick(held, F.col("to")) + extra - _pick(lack_before, F.col("to"))))
    return placed.withColumn("shard", F.col("to")).select(*state.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, n_equal (null: no equal text), shard, slot, under the law `rows`: counts at most one apart."""
    state = stored(prepare(docs, shards, text_col, id_col), "shard-state")
    rows = state.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    for _ in range(rounds):
        state, moves = propagate(state, quota)
        if not moves:
            break
    return even_rows(state, quota).select("doc_id", "size", "text_crc32", "g1", "g2", "n_equal", "shard", "slot")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row of (links, cut): pairs of equal texts, and those of them whose documents are in different shards."""
    pairs = lambda n: n * (n - 1) / 2
    inside = placed.where("n_equal > 1").groupBy("g1", "g2", "n_equal", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = inside.groupBy("g1", "g2", "n_equal").agg(F.sum(pairs(F.col("n"))).alias("kept"))
    total = F.coalesce(F.sum(pairs(F.col("n_equal"))), F.lit(0))
    return groups.agg(total.cast("long").alias("links"), (total - F.coalesce(F.sum("kept"), F.lit(0))).cast("long").alias("cut"))
