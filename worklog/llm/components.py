"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node of the edges (a, b), in either direction, repeated or not.

    In each round all nodes are ranked anew by a hash; a node moves to the first of itself and its neighbours, and from
    there one step further. The edges follow their ends, and those within one node go. What is left are nodes that come
    before all their neighbours, on average a fixed share of them whatever their names, so the number of rounds grows
    with the logarithm of the longest path. Every round is written to the shared folder, and those before it removed. No
    edges give no rows.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rest = common.stored(edges.filter("a <> b").select(low, high).distinct(), "edges")
    labels, turn = rest.select(F.col("a").alias("node"), F.col("a").alias("component")), 0
    while not rest.isEmpty():
        with common.scratch(spark):

            def ranked(node: str, turn: int = turn) -> Column:
                return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("node"))

            ends = rest.select(F.col("a").alias("node"), "b").unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("b")))
            # Written first, so that a node with very many followers can be split in the join.
            moves = common.stored(ends.groupBy("node").agg(F.min(ranked("b")).alias("_near")).select("node", F.least(ranked("node"), "_near")["node"].alias("to")), "moves")
            onward = moves.select(F.col("node").alias("to"), F.col("to").alias("component"))
            moved = common.stored(moves.join(onward, "to").select("node", "component"), "moved", outlive=not turn)
            for end in ("a", "b"):
                rest = rest.join(moved.select(F.col("node").alias(end), F.col("component").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
            rest = common.stored(rest.filter("a <> b").select(low, high).distinct(), "edges", outlive=True)
            if turn:
                step = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
                labels = common.stored(labels.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels", outlive=True)
            else:
                labels = moved
            turn += 1
    least = labels.groupBy("component").agg(F.min("node").alias("_least"))
    return labels.join(least, "component").select("node", F.col("_least").alias("component"))
