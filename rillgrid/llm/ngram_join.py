"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct w-word shingles (all words as one shingle if there are fewer). Two documents link when
100 * intersection >= percent * union. A global order of shingles puts the frequent ones last; documents that link share
one of the first n - ceil(n * percent / 100) + 1 shingles (the prefix) of each.

1. Documents with equal sets become one class. Classes of equal size and equal prefix become one group.
2. Groups that share a prefix shingle and pass the length and position filters are candidates. Around a rare shingle all pairs
   are taken; around a shingle of more than FREQUENT prefixes each group is first compared with one centre only.
3. Candidates' representatives are verified on their whole sets, and links give components.
4. Around frequent shingles whose groups lie in different components, TURNS rounds compare each group with another centre. What is
   then still undecided follows exactly: pairs of members, also of groups around frequent shingles, that lie in
   different components and were not verified. Their links join the components. Pairs within a component need no check, so a large
   group of near copies does not cost the square of its size, and no link between components is lost.
   A set's mask has a bit for each of 256 bins, whether an odd number of its shingles fall there. Two masks differ in at most as
   many bits as the sets differ in shingles, so pairs whose masks differ too much leave the join at once; templated texts
   that share phrases but do not link make no pairs.

The order comes from counts over all documents; at most ORDER_LIMIT shingles, the most frequent, are sent to the executors
(8 MB). Any order gives the same links; whether a shingle is rare is decided by the size of its own list of prefixes.
The documents whose whole sets are verified are found by a filter of fixed size (common.bit_filter) and a join behind it.
Shingles and sets are compared by 64- and 128-bit hashes.

A row is named by its id and a 128-bit hash of id and text. Very many rows of one text meet the components by a join on the
text's class, which adaptive execution splits; empty texts take no part in it.

Cases: null, empty and blank texts have empty sets and link with nothing; repeated rows are equal texts; rows without id
take part and have the smallest id of their component, which is null if no row of it has one; an empty table gives an empty
result; other columns are ignored. Texts are read whole, very long ones too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import admits, bit_filter, drop_rows, key128, small_batches, stored, table
from .shingles import batches_of, distinct, sequences

FREQUENT, ORDER_LIMIT = 8, 1 << 20
#: A frequent shingle's prefixes meet their centre in this many parts.
SALTS = 16
#: Rounds with other centres around frequent shingles whose documents lie in different components.
TURNS = 2


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _arrays(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _class_key(values: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64).tolist())


MASK = [f"m{i}" for i in range(4)]


def _mask(values: np.ndarray) -> list[int]:
    """Whether an odd number of hashes fall in each of 256 bins, as four 64-bit numbers."""
    odd = np.bincount((values & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


class NgramJoin:
    """The join of one table; the steps keep their tables in the shared folder."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id"):
        self.spark: SparkSession = docs.sparkSession
        small_batches(self.spark)
        k1, k2 = key128(F.col(id_col), F.col(text_col))
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
        self.words, self.percent = words, percent

    # 1: sets, classes, groups

    def _map(self, schema: str, make, only=None, mark=None) -> DataFrame:
        """make(set) -> the values after doc_id, k1 and k2, or None for no row; list values are hash arrays. only, mark: broadcast
        filters; documents whose k1 only does not admit are left out, and whether mark admits it is the number before make's values."""
        width, schema = self.words, "doc_id long, k1 long, k2 long, " + schema
        names, lists = [x.split()[0] for x in schema.split(", ")], ["array" in x for x in schema.split(", ")]

        def run(batches):
            for batch in batches:
                if only is not None:
                    batch = batch.filter(pa.array(admits(only.value, batch.column("k1").to_numpy())))
                keys = [batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")]
                keys += [] if mark is None else [admits(mark.value, batch.column("k1").to_numpy()).astype(int).tolist()]
                keys = list(zip(*keys))
                for at, texts in batches_of(batch.column("text")):
                    rows = [(*key, *made) for key, s in zip(keys[at:], sequences(texts, width)) if (made := make(distinct(s))) is not None]
                    if rows:
                        yield pa.RecordBatch.from_arrays([_arrays(list(c)) if is_list else pa.array(c, pa.int64()) for c, is_list in zip(zip(*rows), lists)], names)

        return self.docs.mapInArrow(run, schema)

    def _frequent(self) -> np.ndarray:
        """The frequent shingles, ascending: counted where the order may look at them. Documents whose first 2 p shingles leave
        fewer than p others give all of theirs in a second count."""
        percent = self.percent

        def heads(s):
            return (s[: 2 * prefix_length(len(s), percent)],) if len(s) else None

        def counted(frame: DataFrame) -> np.ndarray:
            counts = frame.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > FREQUENT)
            top = counts.orderBy(F.desc("count"), "token").limit(ORDER_LIMIT).select("token").toArrow().column("token")
            return np.sort(top.to_numpy().view(np.uint64))

        first = counted(self._map("tokens array<long>", heads))
        if not len(first):
            return first
        sent = self.spark.sparkContext.broadcast(first)

        def tails(s):
            p = prefix_length(len(s), percent)
            return (s[2 * p :],) if len(s) > 2 * p and np.count_nonzero(~_in_sorted(s[: 2 * p], sent.value)) < p else None

        rest = counted(self._map("tokens array<long>", tails))
        return np.union1d(first, rest)

    def _prefixes(self):
        """A function of a set: the rare and the frequent tokens by which it meets others."""
        frequent, percent = self.spark.sparkContext.broadcast(self._frequent()), self.percent

        def prefix(s):
            p, late = prefix_length(len(s), percent), _in_sorted(s, frequent.value)
            early = s[~late][:p]
            return early, s[late][: p - len(early)]

        return prefix

    def prepare(self) -> None:
        prefix = self._prefixes()
        marks = [f"{m} long" for m in MASK]
        made = self._map(", ".join(["n long, c1 long, c2 long", *marks, "rare array<long>, common array<long>"]), lambda s: (len(s), *_class_key(s), *_mask(s), *prefix(s)) if len(s) else (0, 0, 0, 0, 0, 0, 0, s, s))
        self.members = stored(made.withColumn("row", F.monotonically_increasing_id()), "ngram-docs")
        # a class is named by one of its rows, and first says which of its rows comes first: the smallest id, none last
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
        self.classes = stored(self.members.where("n > 0").groupBy("c1", "c2", "n").agg(F.min(first).alias("first"), F.min("row").alias("cid"), *[F.first(m).alias(m) for m in MASK]), "ngram-classes")
        #: the names of rows that are there more than once
        self.again = stored(self.members.where("n > 0").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "ngram-again")
        self.mark = self.spark.sparkContext.broadcast(bit_filter(self.again, "k1"))
        one_each = self.members.withColumnRenamed("row", "cid").join(self.classes.select("cid").hint("merge"), "cid", "left_semi").select("cid", "n", "rare", "common")
        groups = one_each.select("cid", "n", F.xxhash64(F.lit(1), "rare", "common").alias("p1"), F.xxhash64(F.lit(2), "rare", "common").alias("p2"))
        same = groups.groupBy("n", "p1", "p2").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("size")).where("size > 1")
        #: (cid, gid) of groups with more than one class
        self.grouped = stored(groups.join(same, ["n", "p1", "p2"]).select("cid", "gid"), "ngram-groups")
        alone = stored(one_each.join(self.grouped.where("cid != gid").select("cid").hint("merge"), "cid", "left_anti"), "ngram-prefixes")
        self.prefixes = alone
        # each group's representative at the places of its prefix
        rare = alone.select("cid", "n", F.size("rare").alias("skip"), F.posexplode("rare").alias("place", "token"))
        late = alone.where(F.size("common") > 0).select("cid", "n", F.size("rare").alias("skip"), F.posexplode("common").alias("place", "token"))
        common = late.select("cid", "n", "skip", (F.col("place") + F.col("skip")).alias("place"), "token")
        crowded = stored(rare.groupBy("token").count().where(F.col("count") > FREQUENT).select("token"), "ngram-crowded")
        if not crowded.isEmpty():  # only rows that a filter admits meet the crowded shingles
            marked = self._marked(alone, bit_filter(crowded, "token"))
            maybe = marked.where("asked").drop("asked")
            common = common.unionByName(maybe.join(crowded.hint("merge"), "token", "left_semi"))
            rare = marked.where("NOT asked").drop("asked").unionByName(maybe.join(crowded.hint("merge"), "token", "left_anti"))
        self.rare, self.common = rare, stored(common, "ngram-common")

    def _marked(self, alone: DataFrame, bits: np.ndarray) -> DataFrame:
        """A row a rare shingle of each prefix, and whether the filter admits it. Batches of arrays become batches of rows at once:
        a column function after an explode would queue all rows on disk."""
        sent = self.spark.sparkContext.broadcast(bits)

        def run(batches):
            for batch in batches:
                lists = batch.column("rare")
                sizes, token = np.asarray(lists.value_lengths()).astype(np.int32), np.asarray(lists.flatten())
                each = lambda x: pa.array(np.repeat(x, sizes))
                place = np.arange(len(token), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([each(batch.column("cid").to_numpy()), each(batch.column("n").to_numpy()), each(sizes), pa.array(place), pa.array(token), pa.array(admits(sent.value, token))], ["cid", "n", "skip", "place", "token", "asked"])

        return alone.select("cid", "n", "rare").mapInArrow(run, "cid long, n long, skip int, place int, token long, asked boolean")

    # 2: candidates

    def _pass(self, a: str, b: str):
        """Length and position filters for two sides with columns n and place."""
        n1, n2, q = F.col(f"{a}.n"), F.col(f"{b}.n"), self.percent
        left = F.least(n1 - F.col(f"{a}.place"), n2 - F.col(f"{b}.place"))
        return (100 * F.least(n1, n2) >= q * F.greatest(n1, n2)) & ((100 + q) * left >= q * (n1 + n2))

    def _near(self, a: str, b: str):
        """Whether the masks of two sets allow them to link: a difference of n1 + n2 - 2 * intersection is at most (100 - q) / (100 + q)
        of n1 + n2. A group of several classes has no mask and passes."""
        differ = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MASK), F.lit(0))
        return (100 + self.percent) * F.coalesce(differ, F.lit(0)) <= (100 - self.percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    @staticmethod
    def _pairs(joined: DataFrame) -> DataFrame:
        return joined.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).where("a < b").distinct()

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(a, b) of representatives: all pairs around rare shingles; pairs with a centre around frequent ones. The centre is the
        one with fewest rare shingles, then of least id, so that the shingles of a group of near copies agree on few centres."""
        x, y = self.rare.alias("x"), self.rare.alias("y")
        rare = self._pairs(x.hint("merge").join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & self._pass("x", "y")))
        centre = stored(self.common.groupBy("token").agg(F.min(F.struct("skip", "cid", "n", "place")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", "c.*"), "ngram-centres")
        # very many prefixes hold a frequent shingle, so they meet copies of its centre under a salt
        around = self.common.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int")).alias("x").hint("merge")
        centres = centre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("y")
        around = self._pairs(around.join(centres, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.cid") != F.col("y.cid")) & self._pass("x", "y")))
        rare = stored(rare, "ngram-pairs", [self.prefixes])
        return rare, around

    # 3: verification and components

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of stored pairs, from the whole sets."""
        named = self.classes.select("cid", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
        keyed = pairs
        for side in "ab":
            keyed = keyed.join(named.select(F.col("cid").alias(side), F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2")).hint("merge"), side)
        keyed = stored(keyed, "ngram-keyed")
        used = keyed.select(F.col("a1").alias("k1")).unionByName(keyed.select(F.col("b1").alias("k1"))).distinct()
        only = self.spark.sparkContext.broadcast(bit_filter(used, "k1"))
        sets = self._map("again long, tokens array<long>", lambda s: (s,) if len(s) else None, only, self.mark).select("k1", "k2", "again", "tokens")
        sets = stored(sets, "ngram-sets")
        once = sets.where("again = 1").groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"))  # equal rows make one set
        whole, sets = sets, sets.where("again = 0").drop("again").unionByName(once)
        both = keyed.join(sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("tokens").alias("s")).hint("merge"), ["a1", "a2"])
        both = both.join(sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("tokens").alias("t")).hint("merge"), ["b1", "b2"])
        same = F.size(F.array_intersect("s", "t"))
        return stored(both.select("a", "b", (100 * same >= self.percent * (F.size("s") + F.size("t") - same)).alias("linked")), "ngram-verified", [whole, keyed])

    def _open(self, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The classes with their labels and groups, each group's least and greatest label, and the prefixes around frequent
        shingles whose groups lie in different components."""
        named = self.classes.select("cid", "n", *MASK).join(labels, "cid", "left").select("cid", "n", *MASK, F.coalesce("label", "cid").alias("label"))
        group = stored(named.join(self.grouped, "cid", "left").select("cid", "n", *MASK, "label", F.coalesce("gid", "cid").alias("gid")), "ngram-labels")
        # a representative stands for all labels of its group's members, and only one that is alone for its mask
        alone = [F.when(F.count(F.lit(1)) == 1, F.first(m)).alias(m) for m in MASK]
        span = group.groupBy("gid").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), *alone)
        common = stored(self.common.join(span.withColumnRenamed("gid", "cid"), "cid"), "ngram-common")
        mixed_tokens = common.groupBy("token").agg(F.min("l1").alias("t1"), F.max("l2").alias("t2")).where("t1 < t2").select("token")
        return group, span, common.join(mixed_tokens.hint("merge"), "token", "left_semi")

    def _drawn(self, labels: DataFrame, turn: int) -> DataFrame:
        """(a, b): each group around open frequent shingles with the centre of one of them, both drawn by a hash of the turn."""
        rows = stored(self._open(labels)[2], "ngram-open")
        own = rows.groupBy("cid").agg(F.min_by(F.struct("token", "n", "place", "l1", "l2", *MASK), F.xxhash64(F.lit(turn), "token", "cid")).alias("o")).select("cid", "o.*")
        centre = rows.groupBy("token").agg(F.min_by(F.struct("cid", "n", "place", "l1", "l2", *MASK), F.xxhash64(F.lit(turn), "cid")).alias("c")).select("token", "c.*")
        x = own.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int")).alias("x").hint("merge")
        y = centre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("y")
        differ = F.least("x.l1", "y.l1") < F.greatest("x.l2", "y.l2")
        return self._pairs(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.cid") != F.col("y.cid")) & differ & self._pass("x", "y") & self._near("x", "y")))

    def _unchecked(self, labels: DataFrame, rare: DataFrame) -> DataFrame:
        """(a, b) of classes in different components that may link: members of candidate groups, around rare and frequent shingles."""
        group, span, open_rows = self._open(labels)
        x, y = open_rows.alias("x"), open_rows.alias("y")
        differ = F.least("x.l1", "y.l1") < F.greatest("x.l2", "y.l2")
        around = self._pairs(x.hint("merge").join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & differ & self._pass("x", "y") & self._near("x", "y")))
        if self.grouped.isEmpty():
            return stored(around, "ngram-pairs")
        asked = rare.unionByName(around).unionByName(self.grouped.select(F.col("gid").alias("a"), F.col("gid").alias("b"))).distinct()
        for side in "ab":
            asked = asked.join(span.select(F.col("gid").alias(side), F.col("l1").alias(f"{side}1"), F.col("l2").alias(f"{side}2")), side)
        asked = stored(asked.where(~((F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2")) & (F.col("a1") == F.col("b1")))).select("a", "b"), "ngram-asked")
        left = asked.join(group.withColumnRenamed("gid", "a").hint("merge"), "a").alias("x").hint("merge")
        met = left.join(group.alias("y"), (F.col("x.b") == F.col("y.gid")) & (F.col("x.label") != F.col("y.label")) & self._near("x", "y"))
        return stored(self._pairs(met), "ngram-pairs")

    def links(self) -> DataFrame:
        """(a, b) of classes: enough links for the components of all links, which are kept as self.labels(cid, label)."""
        self.prepare()
        rare, around = self.candidates()
        inside = self.grouped.where("cid != gid").select(F.least("cid", "gid").alias("a"), F.greatest("cid", "gid").alias("b"))
        first = self.verified(stored(rare.unionByName(around).unionByName(inside).distinct(), "ngram-pairs"))
        found = first.where("linked").select("a", "b")
        self.labels = stored(components(found), "ngram-labels")
        if self.common.isEmpty() and self.grouped.isEmpty():
            return found
        checked = first.select("a", "b")
        for turn in range(TURNS):  # other centres join most of what the first ones left apart, before all pairs are taken
            drawn = stored(self._drawn(self.labels, turn).join(checked.hint("merge"), ["a", "b"], "left_anti"), "ngram-pairs")
            if drawn.isEmpty():
                break
            found, checked = self._joined(found, drawn), checked.unionByName(drawn)
        more = stored(self._unchecked(self.labels, rare).join(checked.hint("merge"), ["a", "b"], "left_anti"), "ngram-pairs")
        return found if more.isEmpty() else self._joined(found, more)

    def _joined(self, found: DataFrame, pairs: DataFrame) -> DataFrame:
        """found with the links among the pairs, which join the components that they lie between."""
        links = self.verified(pairs).where("linked").select("a", "b")
        if not links.isEmpty():
            self.labels = merged(self.labels, links)
        return found.unionByName(links)

    def labelled(self) -> DataFrame:
        """Every row's doc_id, k1, k2, n and first: of its component's rows the first, null for empty sets."""
        self.links()
        firsts = self.classes.select("cid", "c1", "c2", "first").join(self.labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        smallest = firsts.groupBy("label").agg(F.min("first").alias("least"))
        named = stored(firsts.join(smallest, "label").select("c1", "c2", F.col("least").alias("first")), "ngram-components", [self.common])
        full = self.members.where("n > 0").select("doc_id", "k1", "k2", "n", "c1", "c2").join(named.hint("merge"), ["c1", "c2"]).select("doc_id", "k1", "k2", "n", "first")
        return full.unionByName(self.members.where("n = 0").select("doc_id", "k1", "k2", "n", F.lit(None).cast(named.schema["first"].dataType).alias("first")))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        return self.labelled().select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components(edges: DataFrame) -> DataFrame:
    """(cid, label): the smallest id of each node's component, by alternating large and small stars until all are stars
    (Kiveris et al. 2014); each round's tables replace those of the round before."""

    def star(pairs: DataFrame) -> DataFrame:
        """Each node's neighbours with the smallest of them and the node."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.hint("merge"), "u").withColumn("m", F.least("u", "m"))

    def settled(pairs: DataFrame) -> bool:
        """Whether each node points at one that points nowhere."""
        ends = pairs.select(F.col("v").alias("u")).distinct().withColumn("far", F.lit(True))
        return pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(ends, "u", "left").where("n > 1 OR far").isEmpty()

    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    while not settled(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "star", [pairs])
        small = star(large)
        pairs = stored(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct(), "star", [large])
    return pairs.select(F.col("u").alias("cid"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Stored labels(cid, label) with further links(a, b): the components of the labels that the links lie between. Nodes without a label
    are their own."""
    for side in "ab":
        links = links.join(labels.select(F.col("cid").alias(side), F.col("label").alias(f"l{side}")).hint("merge"), side, "left").withColumn(side, F.coalesce(f"l{side}", side)).drop(f"l{side}")
    over = stored(components(links.select("a", "b")), "ngram-merged")
    moved = labels.join(over.select(F.col("cid").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left").select("cid", F.coalesce("to", "label").alias("label"))
    return stored(moved.unionByName(over.join(labels.select("cid").hint("merge"), "cid", "left_anti").select("cid", "label")), "ngram-labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return NgramJoin(docs, words, percent, text_col, id_col).components()


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near duplicates: the one of smallest id, rows without an id last. Rows with one id but
    other texts are other documents. Of rows that are equal in id and text one stays, any of them; rows without words all stay."""
    rows = stored(NgramJoin(docs, words, percent, text_col, id_col).labelled().where("n > 0").select("k1", "k2", (F.struct("k1", "k2") == F.struct("first.k1", "first.k2")).alias("stays")), "ngram-rows")
    gone = rows.where("NOT stays").select("k1", "k2")
    again = stored(rows.where("stays").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "ngram-again")
    return drop_rows(docs, gone, text_col, id_col, again)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def join_sql(words: int, percent: int, more: str = "") -> str:
    """SQL of the join; more: further columns."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id{more}
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


OP5_SQL = join_sql(4, 85)
