"""URL verdicts by rules and, where no rule fits, by gradient-boosted trees on lexical features.

Features are lengths, depth, digit ratio, entropy of the characters, counts of parameters and of hyphens and dots in the
host, and two statistics of the host's suffix over all labelled rows: what share of them has it and what share of those
is blocked. They are column expressions, and the trees are Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rules as (host, start of the path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words in a host that label a URL as blocked for training.
SEED_WORDS = ["adult", "bets", "casino", "spam"]
#: Different URLs that a training set has at most, about; a documented bound on what the trees are fitted to, never on what
#: is counted or judged.
TRAINING_ROWS, TREES, DEPTH = 20_000, 12, 4
FEATURES = ["chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "dots", "suffix_seen", "suffix_blocked"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return common.lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none fits.

    A rule fits its host and all subdomains, for paths that start with the rule's. The list of rules is given by the
    caller and part of the plan, so it is meant to be short.
    """
    rule = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit(""))))
    total = F.aggregate(each, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    return F.when(n > 0, total).otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """Add host, path, suffix and the features of url that need no training rows."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "chars": F.char_length(url).cast("double"),
            "host_chars": F.char_length(host).cast("double"),
            "path_chars": F.char_length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("[^/]+")).cast("double"),
            "digit_ratio": count(url, "0123456789") / F.greatest(F.char_length(url), F.lit(1)),
            "entropy": _entropy(url),
            "parameters": count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").cast("double"),
            "hyphens": count(host, "-").cast("double"),
            "dots": count(host, ".").cast("double"),
        }
    )


def train(labelled: DataFrame, max_rows: int = TRAINING_ROWS):
    """Trees fitted on rows (url, blocked 0 or 1), the suffix statistics, and the share of blocked rows.

    The statistics and the share are those of all rows. The trees are fitted on about max_rows different URLs, drawn by a
    hash, each weighted by its number of copies, and the classes so that both weigh the same: blocked URLs are rare, and
    hosts not seen before would else hardly ever be blocked. They are None if a class is missing there.
    """
    all_rows = labelled.select("url", F.col("blocked").cast("double").alias("blocked"))
    whole = all_rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("url").alias("urls"), F.avg("blocked").alias("blocked")).first()
    suffix = F.substring_index(host_of(F.col("url")), ".", -1)
    suffixes = all_rows.groupBy(suffix.alias("suffix")).agg((F.count(F.lit(1)) / F.lit(max(1, whole.rows))).alias("suffix_seen"), ((F.sum("blocked") + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_blocked"))
    suffixes = common.stored(suffixes, "suffixes")
    share = min(1.0, max_rows / max(1, whole.urls))
    drawn = all_rows.filter(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    single = drawn.groupBy("url", "blocked").agg(F.count(F.lit(1)).cast("double").alias("copies"))
    rows = common.stored(with_features(single).sortWithinPartitions("url", "blocked"), "training-urls")
    if rows.select("blocked").distinct().count() < 2:
        return None, suffixes, whole.blocked
    even = F.col("copies") / F.when(F.col("blocked") == 1, 2 * whole.blocked).otherwise(2 * (1 - whole.blocked))
    ready = _assembled(rows, suffixes).select("features", "blocked", "copies", even.alias("weight")).coalesce(4)
    trees = GBTClassifier(featuresCol="features", labelCol="blocked", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3)
    return trees.fit(ready), suffixes, whole.blocked


def _assembled(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    joined = rows.join(suffixes, "suffix", "left").fillna({"suffix_seen": 0.0, "suffix_blocked": 0.5})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict (allow or block).

    Without labelled rows (url, blocked) the pages label themselves: blocked where the host has a seed word, else not.
    What rules say is no label, because they name hosts and paths, of which the features know nothing. Null URLs and those without :// have an empty host and path, which no rule fits. If the
    training rows have one verdict alone, it is everyone's; without any, allow. Only the two columns are read; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"))
    if labelled is None:
        seeded = F.greatest(*[F.contains(host_of(F.col("url")), F.lit(w)) for w in SEED_WORDS])
        labelled = own.filter("url IS NOT NULL").select("url", seeded.cast("int").alias("blocked"))
    trees, suffixes, blocked = train(labelled)
    featured = with_features(own)
    if trees is None:
        method = F.lit("block" if blocked and blocked > 0.5 else "allow")
        judged = featured
    else:
        judged = trees.transform(_assembled(featured, suffixes))
        method = F.when(vector_to_array("probability")[1] >= 0.5, "block").otherwise("allow")
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
