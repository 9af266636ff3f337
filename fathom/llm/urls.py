"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs, here those that a rule decides. Features: lengths, depth,
digit ratio, character entropy, parameter counts, and how often labelled URLs of the same suffix are
blocked (counted over all of them, smoothed, and for a labelled URL without those of its own fold, so that no
label shows in its own features). All features are column expressions; scoring runs in the JVM. Training uses at
most ``MAX_TRAIN`` labelled URLs, those with the least hashes. ``held_out`` measures the trees on suffixes whose
labels they never saw.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule and is
judged by its features; repeated rows are judged each for itself; without labelled URLs of both kinds
everything undecided is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, skew

#: (host, path, verdict) in the form the query's contract gives them.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MAX_TRAIN = 20_000
SMOOTHING = 20.0
FOLDS = 5
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "has_fragment", "is_https", "suffix_rate", "host_suffix_rate")


def parts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col(id_column).alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add the longest rule that fits, and its verdict; null where none does."""
    out, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out, verdict = F.when(fits, F.lit(host + path)).otherwise(out), F.when(fits, F.lit(says)).otherwise(verdict)
    return urls.withColumn("rule", out).withColumn("verdict", verdict)


def entropy(text: Column) -> Column:
    """Bits by character."""
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))

    def more(sum_: Column, letter: Column) -> Column:
        k = n - F.length(F.replace(text, letter, F.lit("")))
        return sum_ + F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)

    return F.when(n == 0, 0.0).otherwise(F.aggregate(letters, F.lit(0.0), more))


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that a url alone gives, and the suffixes that statistics are kept for."""

    def count(text: Column, letter: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, letter, ""))).cast("double")

    url, host, path = F.col("url"), F.col("host"), F.col("path")
    digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
    labels = F.split(host, "\\.")
    return urls.select(
        "*", F.length(url).cast("double").alias("url_length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        count(host, ".").alias("host_depth"), count(path, "/").alias("path_depth"), (digits / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        entropy(url).alias("entropy"), (count(url, "&") + count(url, "?")).alias("n_params"), count(url, "-").alias("n_hyphens"),
        url.contains("#").cast("double").alias("has_fragment"), url.startswith("https").cast("double").alias("is_https"),
        F.element_at(labels, -1).alias("suffix"), F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2)).alias("host_suffix"),
    )


def suffix_rates(urls: DataFrame, column: str) -> DataFrame:
    """By suffix: how many rows have it (n), and by fold how many labelled ones (all) and blocked ones (bad)."""
    folds = [F.struct(F.sum(F.when(F.col("fold") == f, F.col("label"))).alias("bad"), F.count(F.when(F.col("fold") == f, F.col("label"))).alias("all")) for f in range(FOLDS)]
    return urls.groupBy(F.col(column).alias("_s")).agg(F.count("*").alias("n"), F.array(*folds).alias("folds"))


def _rate(column: str, prior: float) -> Column:
    """The smoothed share of blocked URLs of a suffix in ``folds``, for labelled rows without their own fold. Those of the first fold get what a
    suffix without labels has: else the trees, to which a suffix's other labels tell nearly all, would learn nothing for suffixes that they never saw."""
    others = F.filter("folds", lambda _, i: F.col("label").isNull() | (i != F.col("fold")))

    def total(field: str) -> Column:
        return F.aggregate(others, F.lit(0.0), lambda a, x: a + F.coalesce(x[field], F.lit(0.0)))

    unseen = F.col("folds").isNull() | (F.col("label").isNotNull() & (F.col("fold") == 0))
    return F.when(unseen, F.lit(prior)).otherwise((total("bad") + SMOOTHING * prior) / (total("all") + SMOOTHING)).alias(f"{column}_rate")


def score(urls: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Add ``blocked``, the trees' probability. ``urls``: stored, as from ``lexical``, with label (1 blocked, 0 allowed, null unknown)."""
    n, positive = urls.agg(F.count("label"), F.sum("label")).first()
    if not n or not 0 < positive < n:
        return urls.withColumns({c: F.lit(0.0) for c in ("blocked", "suffix_rate", "host_suffix_rate")})
    rated = urls.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    for column in ("suffix", "host_suffix"):
        rates = scratch.table(suffix_rates(rated, column), f"{column}-rates")
        rated = rated.withColumn("_s", F.col(column))
        rated = skew.looked_up(rated, rates, ["_s"], "n", "left").select(*[c for c in rated.columns if c != "_s"], _rate(column, positive / n))
    ready = scratch.table(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated), "url-features")
    # a bounded sample by hash, the same on every run
    train = ready.where("label IS NOT NULL").select("features", "label", F.xxhash64("url", F.lit(1)).alias("_h"))
    sample = scratch.table(train.orderBy("_h").limit(max_train).select("features", "label"), "url-sample")
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, cacheNodeIds=False).fit(sample.coalesce(2))
    scored = model.transform(ready)
    return scored.withColumn("blocked", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "fold")


def _prepared(pages: DataFrame, id_column: str, url_column: str, rules) -> DataFrame:
    urls = lexical(with_rule(parts(pages, id_column, url_column), rules))
    label = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("double"))
    return scratch.table(urls.withColumn("label", label), "urls")


def held_out(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, threshold: float = 0.5, every: int = 4, by: str = "host_suffix") -> DataFrame:
    """One row: how many labelled URLs are of suffixes held out (one in ``every``, by hash), how many of them the trees, trained on
    the others, judge as their label says, and how many the more common label would. ``by``: what is held out as a whole, a column of
    ``lexical`` such as host_suffix, host or url; among few suffixes none that is held out may have a label."""
    urls = _prepared(pages, id_column, url_column, rules).withColumn("truth", F.col("label"))
    hidden = F.pmod(F.xxhash64(by), F.lit(every)) == 0
    scored = score(urls.withColumn("label", F.when(~hidden, F.col("label")))).where(hidden & F.col("truth").isNotNull())
    right = ((F.col("blocked") > threshold).cast("double") == F.col("truth")).cast("long")
    return scored.agg(F.count("*").alias("n"), F.sum(right).alias("n_right"), F.greatest(F.sum("truth"), F.sum(1 - F.col("truth"))).cast("long").alias("n_common"))


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' score and features."""
    scored = score(_prepared(pages, id_column, url_column, rules))
    method = F.when(F.col("blocked") > threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", method)).select("page_id", "host", "path", "rule", "verdict", "blocked", *FEATURES)


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", F.round("blocked", 6).alias("blocked"))
