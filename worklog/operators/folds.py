"""Folding ordered rows of many keys through a small set of states, in tables and column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklog.sources.shared import stored

#: Rows that are folded as one list: 2 ** BITS.
BITS = 10


def positioned(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with _pos, a number that rises with the order within each key; written, so that the numbers stay.

    Rows are dealt to ranges of key and order together, so a key with very many rows has its part of several ranges.
    """
    by = [*keys, *order]
    return stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id()), "positioned")


def states_before(items: DataFrame, keys: Sequence[str], start: DataFrame, states: int) -> DataFrame:
    """keys, _pos and _state, the state before each item: items are (keys, _pos, _map), start is (keys, _state).

    A map has the state that follows each of the states 0, 1, ... Maps are composed in lists of 2 ** BITS at most; where a
    key has more, each list becomes one composed map, the lists are folded in the same way, and each list begins with the
    state that its turn brings. Keys without a start have no rows.
    """
    longest = items.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= 1 << BITS:
        return _unrolled(_lists(items, keys), keys, start)
    chunked = items.withColumn("_chunk", F.shiftright("_pos", BITS))
    chunks = stored(_lists(chunked, [*keys, "_chunk"]), "fold-chunks")
    upper = chunks.select(*keys, F.col("_chunk").alias("_pos"), _composed("_list", states).alias("_map"))
    begin = states_before(upper, keys, start, states).withColumnRenamed("_pos", "_chunk")
    return _unrolled(chunks, [*keys, "_chunk"], begin).drop("_chunk")


def _lists(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_map"))).alias("_list"))


def _composed(column: str, states: int) -> Column:
    """All maps of a list as one."""
    same = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(column, same, lambda now, item: F.transform(now, lambda s: F.get(item["_map"], s)))


def _unrolled(lists: DataFrame, keys: Sequence[str], start: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<_pos:bigint,_state:int>>")
    begin = F.struct(F.col("_state").alias("now"), none.alias("seen"))
    step = lambda held, item: F.struct(
        F.get(item["_map"], held["now"]).alias("now"), F.concat(held["seen"], F.array(F.struct(item["_pos"].alias("_pos"), held["now"].alias("_state")))).alias("seen")
    )
    rows = lists.join(start, list(keys)).select(*keys, F.explode(F.aggregate("_list", begin, step, lambda held: held["seen"])).alias("_seen"))
    return rows.select(*keys, "_seen._pos", "_seen._state")
