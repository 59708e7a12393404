"""Connected parts of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklog.sources.shared import stored


def parts(links: DataFrame) -> DataFrame:
    """_node and _part of each end of the links (_a, _b, both long): ends that links join, in whatever direction, have equal parts.

    Every round gives each node a random name and takes it for the least name among it and its neighbours; links between
    nodes that became one go. A round leaves about half of the nodes, so all of them together are a few times the first,
    and their number grows with the logarithm of the longest way. Names are hashes: should two be equal, parts become one.
    """
    rounds, left = [], stored(_once(links), "links")
    while not left.isEmpty():
        name = lambda c, n=len(rounds): F.xxhash64(c, F.lit(n))
        both = left.unionByName(left.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = stored(both.groupBy("_a").agg(F.least(name("_a"), F.min(name("_b"))).alias("_to")), "least-names")
        rounds.append(least)
        begin = left.join(least, "_a").select(F.col("_to").alias("_a"), "_b")
        left = stored(_once(begin.join(least.select(F.col("_a").alias("_b"), "_to"), "_b").select("_a", F.col("_to").alias("_b"))), "links")
    if not rounds:
        return left.select(F.col("_a").alias("_node"), F.col("_b").alias("_part"))
    named = rounds.pop()
    while rounds:
        later = named.select(F.col("_a").alias("_to"), F.col("_to").alias("_last"))
        named = stored(rounds.pop().join(later, "_to", "left").select("_a", F.coalesce("_last", "_to").alias("_to")), "part-names")
    return named.select(F.col("_a").alias("_node"), F.col("_to").alias("_part"))


def _once(links: DataFrame) -> DataFrame:
    return links.filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
