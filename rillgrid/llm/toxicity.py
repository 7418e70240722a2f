"""Toxicity by a classifier chain.

One linear model a category, in a fixed order. A model sees the words of a text and the log odds that the models before it
give; in training these are out-of-fold predictions, so that later models learn from probabilities like those they meet
when scoring. Words (ASCII letters in lower case, parted by blanks and ASCII punctuation) and their first bytes are hashed
into BUCKETS places; a place present counts with its log ratio between the classes, shrunk towards 0 for rare ones, and
logistic regression weighs these. The threshold of the last category is the one of best F1 on out-of-fold predictions.

Fitting takes at most fit_rows labelled rows (20,000: those whose ids hash lowest). Their places are a stored table; Spark counts
each place by fold and class, and only places that some model uses go on. A category's models, one a fold and one on all rows, are fitted
in a task each. The driver gets the chosen places as bits, each model's weights and one score a row, never the rows' places.
Scoring reads whole texts, in Arrow batches; a model has BUCKETS numbers a category at most, whatever the data.

Cases: null and empty texts have no words and get the models' base rates; very long texts are read whole; rows without an id
are scored but not fitted on; labels with a null in any category are left out; repeated rows and labels count as often as they
come, and rows of one id share a fold; without labels of both kinds a category's probability is the smoothed share of ones, and
nothing is flagged; empty tables give an empty result. The columns p_<category> and the last category's are made new where
documents have columns of these names; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, runs_of, small_batches, stored, table
from .shingles import BLANK, batches_of, distinct, word_hashes

BUCKETS, HEAD_BYTES, FOLDS, FIT_ROWS = 1 << 20, 5, 3, 20_000
#: Places count from this absolute log ratio and this number of rows on; SHRINK rows are added to both classes.
LEAST_RATIO, LEAST_ROWS, SHRINK = 0.7, 3, 4.0
#: Files of the stored sample, so that it is counted in several tasks.
SAMPLE_PARTS = 12
#: Places that fitting looks at together.
SLICE = 1 << 18
#: Labels in the order of the chain; the last one decides.
CATEGORIES = ("quality", "toxic")
PARTS = BLANK | np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def places(texts: pa.Array) -> list[np.ndarray]:
    """The distinct places of each text's words and word heads."""
    words, at, heads = word_hashes(texts, PARTS, HEAD_BYTES)
    half = np.uint64(BUCKETS // 2)
    both = (words % half).astype(np.int32), (heads % half + half).astype(np.int32)
    return [distinct(np.concatenate([b[i:j] for b in both])) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """One category's model: the log odds are bias + sum of weights at a text's places + extra * earlier log odds. names: the
    places that have a weight, ascending."""

    bias: float
    names: np.ndarray
    weights: np.ndarray
    extra: np.ndarray

    @cached_property
    def dense(self) -> np.ndarray:
        every = np.zeros(BUCKETS)
        every[self.names] = self.weights
        return every

    def odds(self, flat: np.ndarray, begin: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.dense[flat])])
        return self.bias + sums[begin[1:]] - sums[begin[:-1]] + (earlier @ self.extra if len(self.extra) else 0.0)


def log_ratio(ones_with, with_, ones, rows, shrink=SHRINK):
    """How much more often a place occurs with ones than with zeros; works on numbers, arrays and columns."""
    return (ones_with / ones + shrink / rows) / ((with_ - ones_with) / (rows - ones) + shrink / rows)


def fit_linear(flat: np.ndarray, begin: np.ndarray, earlier: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-3) -> Linear:
    """flat: the rows' places one after the other; begin: where each row's start, and the end. Works on slices of SLICE places or
    one row, so that it takes little more memory than the places themselves."""
    n, ones = len(y), int(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else -4.0
    if ones in (0, n):
        return Linear(base, np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]))
    sizes = np.diff(begin)
    slices = list(runs_of(sizes.tolist(), SLICE))
    pos, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, j in slices:
        some = flat[begin[i] : begin[j]]
        both += np.bincount(some, minlength=BUCKETS)
        pos += np.bincount(some[np.repeat(y[i:j] == 1, sizes[i:j])], minlength=BUCKETS)
    ratio = np.log(log_ratio(pos, both, ones, n))
    use = (np.abs(ratio) > LEAST_RATIO) & (both >= LEAST_ROWS)
    names, number = np.flatnonzero(use), (np.cumsum(use) - 1).astype(np.int32)
    parts = []  # of each slice: its rows, the used places by number, where each row's start
    for i, j in slices:
        some = flat[begin[i] : begin[j]]
        keep = use[some]
        parts.append((i, j, number[some[keep]], np.concatenate([[0], np.cumsum(keep)])[begin[i : j + 1] - begin[i]]))
    scale = ratio[names]
    x = np.column_stack([earlier, np.ones(n)])
    w, v = np.full(len(names), 0.3), np.zeros(x.shape[1])
    v[-1] = base
    g2w, g2v = np.full(len(w), 1e-8), np.full(len(v), 1e-8)
    for _ in range(steps):  # Adagrad over all rows
        gw, gv = penalty * w / max(1, len(w)), np.zeros(len(v))
        ws = w * scale
        for i, j, at, starts in parts:
            sums = np.concatenate([[0.0], np.cumsum(ws[at])])
            e = (sigmoid(sums[starts[1:]] - sums[starts[:-1]] + x[i:j] @ v) - y[i:j]) / n
            gw += np.bincount(at, weights=np.repeat(e, np.diff(starts)), minlength=len(w)) * scale
            gv += x[i:j].T @ e
        g2w += gw * gw
        g2v += gv * gv
        w, v = np.maximum(w - 0.3 * gw / np.sqrt(g2w), 0), v - 0.3 * gv / np.sqrt(g2v)
    return Linear(float(v[-1]), names, w * scale, v[:-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway below the lowest score taken at the best F1; 1 (nothing is flagged) without labels of both kinds."""
    if not len(y) or y.min() == y.max():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = np.where(np.append(p[order][1:] < p[order][:-1], True), 2 * hits / (taken + y.sum()), -1)
    best = int(np.argmax(f1))
    return float((p[order][best] + (p[order][best + 1] if best + 1 < len(p) else 0.0)) / 2)


class Chain:
    """Fitted models, in the order of their categories, and the last one's threshold."""

    def __init__(self, categories: tuple[str, ...], models: list[Linear], threshold: float):
        self.categories, self.models, self.threshold = categories, models, threshold

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a row a text and a column a category."""
        lists = places(texts)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat, earlier = np.concatenate(lists) if lists else np.empty(0, np.int32), np.zeros((len(lists), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, np.clip(model.odds(flat, begin, earlier), -35, 35)])
        return sigmoid(earlier)


def fit_sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], fit_rows: int, text_col: str, id_col: str) -> DataFrame:
    """The stored rows to fit on: row, _order and digest (they set the order), fold, y (a number a category), places."""
    known = labels.select(F.col(id_col), *categories).dropna().withColumn("_order", F.xxhash64(id_col))
    known = known.orderBy("_order", id_col, *categories).limit(fit_rows)  # at most fit_rows small rows

    @F.arrow_udf("array<int>")
    def placed(texts: pa.Array) -> pa.Array:
        return pa.array([x for _, part in batches_of(texts) for x in places(part)], pa.list_(pa.int32()))

    texts = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(known), id_col)
    rows = texts.select("_order", F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in categories]).alias("y"), placed(F.col(text_col)).alias("places"))
    # ids may repeat in the documents, so the bound holds after the join as well
    rows = rows.withColumn("digest", F.xxhash64("places")).orderBy("_order", "y", "digest").limit(fit_rows)
    return stored(rows.repartition(SAMPLE_PARTS, "_order").withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")


def useful_places(sample: DataFrame, categories: int) -> np.ndarray:
    """For each category and place whether some fold's model, or the one on all rows, uses it."""
    is_one = lambda k: F.col("y")[k]
    parts = [F.lit(True) if f == FOLDS else F.col("fold") != f for f in range(FOLDS + 1)]  # the rows of each model
    count = lambda x: F.coalesce(F.sum(F.when(x, 1.0)), F.lit(0.0))
    sizes = sample.agg(*[count(p).alias(f"n{f}") for f, p in enumerate(parts)], *[count(p & (is_one(k) == 1)).alias(f"n{f}_{k}") for f, p in enumerate(parts) for k in range(categories)]).first()
    held = [F.col("fold") == f for f in range(FOLDS)]
    sums = [F.sum(F.when(h, 1).otherwise(0)).alias(f"f{f}") for f, h in enumerate(held)]
    sums += [F.sum(F.when(h & (is_one(k) == 1), 1).otherwise(0)).alias(f"f{f}_{k}") for f, h in enumerate(held) for k in range(categories)]
    counts = sample.select("fold", "y", F.explode("places").alias("place")).groupBy("place").agg(*sums)
    used = [F.lit(False)] * categories
    for f in range(FOLDS + 1):
        of = lambda tail: sum((F.col(f"f{g}{tail}") for g in range(FOLDS) if g != f), F.lit(0))
        for k in range(categories):
            rows, ones = sizes[f"n{f}"], sizes[f"n{f}_{k}"]
            if 0 < ones < rows:
                ratio = F.abs(F.ln(log_ratio(of(f"_{k}"), of(""), F.lit(ones), F.lit(rows))))
                used[k] = used[k] | ((of("") >= LEAST_ROWS) & (ratio > LEAST_RATIO * (1 - 1e-9)))
    chosen = np.zeros((categories, BUCKETS), bool)
    # at most BUCKETS small numbers, and only those of places that help
    mask = sum((F.when(u, 1 << k).otherwise(0) for k, u in enumerate(used)), F.lit(0))
    found = counts.select("place", mask.alias("mask")).where("mask > 0").toArrow()
    for k in range(categories):
        chosen[k, found.column("place").to_numpy()] = (found.column("mask").to_numpy() >> k) & 1
    return chosen


MODEL_SCHEMA = "row long, odds double, bias double, names array<int>, weights array<double>, extra array<double>"


def fit_category(rows: DataFrame, k: int, categories: tuple[str, ...]) -> tuple[Linear, DataFrame]:
    """The model of all rows, and each row's log odds under the model that was fitted without its fold. rows: the sample with
    its useful places and `earlier`, the log odds of the categories before."""

    def fit(key: tuple, table_: pa.Table) -> pa.Table:
        part = key[0].as_py()
        column = lambda name: table_.column(name).combine_chunks()
        order = np.lexsort([column(c).to_numpy() for c in ("digest", "fold", "_order")])
        y = np.asarray(column("y").flatten())[k :: len(categories)][order]
        lists, n = column("places"), len(order)
        flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        earlier = np.asarray(column("earlier").flatten()).reshape(n, -1)[order]
        held = column("fold").to_numpy()[order] == part

        def some(which):
            rows = order[which]
            begin = np.concatenate([[0], np.cumsum(ends[rows + 1] - ends[rows])])
            return np.concatenate([flat[:0], *(flat[ends[i] : ends[i + 1]] for i in rows.tolist())]), begin, earlier[which]

        model = fit_linear(*some(~held), y[~held])
        if part == FOLDS:
            out = [{"row": None, "odds": None, "bias": model.bias, "names": model.names.tolist(), "weights": model.weights.tolist(), "extra": model.extra.tolist()}]
        else:
            names = column("row").to_numpy()[order][held].tolist()
            out = [{"row": i, "odds": o} for i, o in zip(names, np.clip(model.odds(*some(held)), -35, 35).tolist())]
        give_back()
        return pa.Table.from_pylist(out, pa.schema([("row", pa.int64()), ("odds", pa.float64()), ("bias", pa.float64()), ("names", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64()))]))

    parts = rows.withColumn("part", F.explode(F.array(*[F.lit(f) for f in range(FOLDS + 1)])))
    fitted = stored(parts.groupBy("part").applyInArrow(fit, MODEL_SCHEMA), "toxicity-model")
    said = fitted.where("row IS NULL").toArrow()
    array = lambda name, kind: said.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    if not said.num_rows:  # no rows to fit on
        return Linear(-4.0, np.empty(0, np.int64), np.empty(0), np.zeros(k)), fitted.select("row", "odds")
    return Linear(said.column("bias")[0].as_py(), array("names", np.int64), array("weights", float), array("extra", float)), fitted.where("row IS NOT NULL").select("row", "odds")


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, fit_rows: int = FIT_ROWS, text_col: str = "text", id_col: str = "doc_id") -> Chain:
    spark = docs.sparkSession
    small_batches(spark)
    sample = fit_sample(docs, labels, categories, fit_rows, text_col, id_col)
    sent = spark.sparkContext.broadcast(np.packbits(useful_places(sample, len(categories)), axis=1))

    def useful(k: int) -> Column:
        @F.arrow_udf("array<int>")
        def kept(lists: pa.Array) -> pa.Array:
            flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            keep = (sent.value[k][flat >> 3] >> (7 - (flat & 7))) & 1 == 1
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[ends], pa.int32()), pa.array(flat[keep], pa.int32()))

        return kept("places")

    rows, models = sample.withColumn("earlier", F.array().cast("array<double>")), []
    for k in range(len(categories)):
        model, odds = fit_category(rows.withColumn("places", useful(k)), k, categories)
        models.append(model)
        rows = rows.join(odds, "row").withColumn("earlier", F.concat("earlier", F.array("odds"))).drop("odds")
    last = rows.select("_order", "fold", "digest", F.col("y")[len(categories) - 1].alias("y"), F.col("earlier")[len(categories) - 1].alias("z")).toArrow()  # at most fit_rows
    order = np.lexsort([last.column(c).to_numpy() for c in ("digest", "fold", "_order")])
    return Chain(categories, models, best_threshold(sigmoid(last.column("z").to_numpy()[order]), last.column("y").to_numpy()[order]))


def probabilities(text: Column, chain: Chain, spark: SparkSession) -> Column:
    """array<double>: one probability a category."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(chain)

    @F.arrow_udf("array<double>")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [sent.value.score(part) for _, part in batches_of(texts)]
        return pa.array(list(np.concatenate(parts)) if parts else [], pa.list_(pa.float64()))

    return scored(text)


def flag_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with a column p_<category> each and the decision of the last category, named by it."""
    scored = docs.withColumn("_scores", probabilities(F.col(text_col), chain, docs.sparkSession))
    added = {f"p_{c}": F.col("_scores")[i] for i, c in enumerate(chain.categories)}
    return scored.withColumns(added | {chain.categories[-1]: F.col("_scores")[len(added) - 1] > chain.threshold}).drop("_scores")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return flag_toxic(docs, fit_chain(docs, table(spark, sf_dir, "labels"))).drop("text")
