"""URL filter: rules first, then the ratio of two character language models.

A rule is a host and a path; it fits its host and all subdomains where the path starts with the rule's, and the longest rule
that fits wins. URLs that the rules allow or block are the accepted and rejected examples. For each kind a Markov model of
variable order (contexts of 0 to ORDER characters; one that was not seen is left out) is counted over all examples,
with Witten-Bell smoothing down to an even spread over ALPHABET characters. A URL's score is the log-likelihood under the accepted model less
that under the rejected one, by its length; it is allowed from a threshold on, which is the one of best balanced accuracy on
examples that were not counted: models of each half score the other half. All three models are counted and scored in one chain
of joins, since the driver's memory grows with what it plans, whatever the input.

Counts, contexts and scores are tables; nothing that grows with the URLs is broadcast by this module.

Cases: null URLs and URLs without `://` have empty host and path and fit no rule; a null or empty URL has score 0; without
examples of both kinds every score is 0 and the threshold is 0, so the method allows; repeated URLs are scored once and judged each; an empty
table gives an empty result; very long URLs are read whole, a row a character; host, path, rule, score and verdict are made new
where pages have such columns, and other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, key128, stored, table

ORDER, ALPHABET, SALTS = 4, 256, 16
START, END = "\x02", "\x03"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        own_host, own_path = rule.split("/", 1)
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams(url: Column) -> Column:
    """Each character and the end, after the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), F.coalesce(url, F.lit("")), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - ORDER), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_scores(counts: DataFrame, models: int) -> DataFrame:
    """(gram, scores): for each model the log ratio of the last character's probabilities, null where no URL asks for it.
    counts: (gram, and for each model a, b and asked with its number). A context with its next character is a tail; tails of all
    lengths are counted at once. Of those that a gram goes through, all but the longest are gathered for each distinct suffix."""
    names, asked = [f"{kind}{m}" for m in range(models) for kind in "ab"], [f"asked{m}" for m in range(models)]
    tails = lambda whole, longest: F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.right(whole, n))).alias("tail")
    length = F.char_length("tail")
    salt = lambda short: F.when(length <= 2, short).otherwise(F.lit(0))  # noqa: E731  short tails end very many suffixes
    seen = counts.select(tails("gram", ORDER + 1), *names, *asked).groupBy("tail").agg(*[F.sum(n).alias(n) for n in names], *[F.bool_or(n).alias(n) for n in asked])
    same = Window.partitionBy(F.expr("substring(tail, 1, char_length(tail) - 1)"))  # at most a row a character
    shares = []
    for n in names:
        kinds = F.count_if(F.col(n) > 0).over(same)
        whole = F.nullif(F.sum(n).over(same) + kinds, F.lit(0))  # null: a context that was not seen leaves the shorter one's probability
        shares.append(F.struct(F.coalesce(F.col(n) / whole, F.lit(0.0)).alias("own"), F.coalesce(kinds / whole, F.lit(1.0)).alias("rest")).alias(n))
    seen = seen.select("tail", *shares, *asked)
    short = seen.where(length <= ORDER).select("tail", *names).withColumn("salt", F.explode(F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))))
    steps = seen.where(length == ORDER).select(F.col("tail").alias("suffix")).select("suffix", tails("suffix", ORDER)).withColumn("salt", salt(F.pmod(F.xxhash64("suffix"), F.lit(SALTS)).cast("int")))
    steps = steps.join(short.hint("merge"), ["tail", "salt"]).groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct(length.alias("length"), *names))).alias("steps"))
    after = lambda p, step: step["own"] + step["rest"] * p
    chance = lambda n: F.aggregate("steps", F.lit(1 / ALPHABET), lambda p, step: after(p, step[n])).alias(f"p_{n}")
    whole = seen.where(length == ORDER + 1).withColumn("suffix", F.right("tail", F.lit(ORDER))).join(steps.select("suffix", *map(chance, names)).hint("merge"), "suffix")
    log = lambda n: F.ln(after(F.col(f"p_{n}"), F.col(n)))
    return whole.select(F.col("tail").alias("gram"), F.array(*[F.when(F.col(f"asked{m}"), log(f"a{m}") - log(f"b{m}")) for m in range(models)]).alias("scores"))


def key_scores(urls: DataFrame, models: list[Column], asks: Column) -> DataFrame:
    """(u1, u2, good, score) of the URLs that ask: key128(), and the score under the model whose number asks has. urls: (url, good).
    A model is true for the URLs it counts as accepted, false for the rejected ones, else null; all models are counted in one
    pass. A gram that every URL has meets its scores under a salt."""
    u1, u2 = key128(F.col("url"))
    counts = urls.select(*[x.alias(f"m{m}") for m, x in enumerate(models)], asks.alias("asks"), F.explode(grams(F.col("url"))).alias("gram")).groupBy("gram")
    counts = counts.agg(*[x for m in range(len(models)) for x in (F.count_if(f"m{m}").alias(f"a{m}"), F.count_if(~F.col(f"m{m}")).alias(f"b{m}"), F.bool_or(F.col("asks") == m).alias(f"asked{m}"))])
    scores = gram_scores(stored(counts, "url-grams"), len(models)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = urls.where(asks.isNotNull()).select(u1.alias("u1"), u2.alias("u2"), "good", asks.alias("asks"), F.explode(grams(F.col("url"))).alias("gram")).withColumn("salt", F.pmod("u1", F.lit(SALTS)).cast("int"))
    return rows.join(scores.hint("merge"), ["gram", "salt"]).groupBy("u1", "u2", "good").agg(F.avg(F.get("scores", F.col("asks"))).alias("score"))


def url_scores(examples: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (distinct) with score, by one model of the examples: (url, good)."""
    u1, u2 = key128(F.col("url"))
    both = examples.select("url", "good", F.lit(None).cast("int").alias("asks")).unionByName(urls.select("url", F.lit(None).cast("boolean").alias("good"), F.lit(0).alias("asks")))
    return urls.withColumn("u1", u1).withColumn("u2", u2).join(key_scores(both, [F.col("good")], F.col("asks")).drop("good"), ["u1", "u2"]).drop("u1", "u2")


def threshold_of(scored: DataFrame) -> float:
    """The score of best balanced accuracy, in steps of 0.01, from (good, score)."""
    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).cast("int")
    rows = scored.groupBy(cell.alias("cell"), "good").count().collect()  # at most 4002 rows
    good, bad = ({r["cell"]: r["count"] for r in rows if r["good"] is g} for g in (True, False))
    if not good or not bad:
        return 0.0
    all_good, all_bad, kept, lost = sum(good.values()), sum(bad.values()), sum(good.values()), 0
    best = (-1.0, 0)
    for c in range(min([*good, *bad]), max([*good, *bad]) + 2):
        best = max(best, (round(kept / all_good + lost / all_bad, 12), -abs(c), -c))
        kept, lost = kept - good.get(c, 0), lost + bad.get(c, 0)
    return -best[2] / 100


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, score (null where a rule decides) and verdict."""
    host, path = url_parts(F.col(url_col))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    parted = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", name).withColumn("_says", says)
    good = F.col("good")
    urls = stored(parted.select(F.coalesce(url_col, F.lit("")).alias("url"), (F.col("_says") == "allow").alias("good")).distinct(), "urls")
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2)) == 0
    u1, u2 = key128(F.coalesce(url_col, F.lit("")))
    if urls.agg(F.max(good) & ~F.min(good)).first()[0]:  # examples of both kinds
        scores = key_scores(urls, [F.when(half, good), F.when(~half, good), good], F.when(good.isNull(), 2).when(half, 1).otherwise(0))
        scores = stored(scores, "url-scores")
        threshold = threshold_of(scores.where(good.isNotNull()))
    else:
        threshold, scores = 0.0, urls.select(*[k.alias(n) for k, n in zip(key128(F.col("url")), ("u1", "u2"))], "good", F.lit(0.0).alias("score"))
    own = scores.where(good.isNull()).select(F.col("u1").alias("_u1"), F.col("u2").alias("_u2"), F.col("score").alias("_score"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = parted.withColumn("_u1", u1).withColumn("_u2", u2).withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    out = salted.join(own.hint("merge"), ["_u1", "_u2", "_salt"], "left")
    score = F.when(F.col("_score").isNotNull() & (F.coalesce(url_col, F.lit("")) == ""), 0.0).otherwise(F.col("_score"))
    verdict = F.coalesce("_says", F.when(score >= threshold, "allow").otherwise("block"))
    return out.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")], "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
