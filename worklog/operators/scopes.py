"""Conflicts between the path scopes of different tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklog.functions.expr import glob_regex, valid_glob
from worklog.schema import TERMINAL
from worklog.sources.shared import stored

#: Scopes of one segment or project that meet the others in one part.
PART_ROWS = 10_000


def active_scopes(scopes: DataFrame, tasks: DataFrame) -> DataFrame:
    live = tasks.filter(~F.col("status").isin(TERMINAL)).select("project_id", F.col("id").alias("task_id"))
    return scopes.join(live, ["project_id", "task_id"], "left_semi")


def _first_segment(pattern):
    return F.split(pattern, "/", 2)[0]


def scope_conflicts(scopes: DataFrame, tasks: DataFrame, task_id: str | None = None) -> DataFrame:
    """project_id, task_a, pattern_a, task_b, pattern_b, kind: each pair of scopes of different open tasks once.

    Definite if one pattern as a glob matches the other's text, else Possible if their first path segments are equal or
    one is no valid glob. A glob without a wildcard in its first segment matches only texts with that segment, so those
    pairs are found by an equi-join; patterns that begin with a wildcard or are invalid are compared with all others of
    the project. The pairs are the result, so there may be many; segments and projects with many scopes are split, each
    part of one side meeting the whole of the other. With a task only that task's scopes are compared with the rest.
    """
    own = active_scopes(scopes, tasks).select("project_id", "task_id", "pattern").distinct()
    own = own.withColumns({"_first": _first_segment(F.col("pattern")), "_valid": valid_glob(F.col("pattern")), "_regex": glob_regex(F.col("pattern"))})
    own = stored(own.withColumn("_wide", ~F.col("_valid") | F.col("_first").rlike(r"[*?\[{]")), "scopes")
    mine = own if task_id is None else own.filter(F.col("task_id") == task_id)
    met = _met(mine, own, ["project_id", "_first"]).unionByName(_met(mine, own.filter("_wide"), ["project_id"]))
    if task_id is not None:
        met = met.unionByName(_met(mine.filter("_wide"), own, ["project_id"]))
    first = F.struct("task_id_a", "pattern_a") < F.struct("task_id_b", "pattern_b")
    other = lambda c: c[:-1] + ("b" if c.endswith("_a") else "a")
    turned = [F.when(first, F.col(c)).otherwise(F.col(other(c))).alias(c) for c in met.columns if c != "project_id"]
    pairs = met.filter("task_id_a <> task_id_b").select("project_id", *turned).distinct()
    both = F.col("_valid_a") & F.col("_valid_b")
    hit = F.when(both, F.rlike("pattern_b", F.col("_regex_a")) | F.rlike("pattern_a", F.col("_regex_b"))).otherwise(False)
    kind = F.when(hit, "Definite").when(~both | (F.col("_first_a") == F.col("_first_b")), "Possible")
    return pairs.withColumn("kind", kind).filter("kind IS NOT NULL").select("project_id", F.col("task_id_a").alias("task_a"), "pattern_a", F.col("task_id_b").alias("task_b"), "pattern_b", "kind")


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a with every row of b that has its keys, columns named by side; a's rows of a hot key are dealt to parts."""
    columns = ["task_id", "pattern", "_first", "_valid", "_regex"]
    parts = a.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
    left = a.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("task_id", "pattern"), F.col("_parts")).cast("int"))
    right = b.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    on = [*keys, "_part"]
    named = lambda df, side: df.select(*[F.col(c).alias(f"_k{i}" if c != "project_id" else c) for i, c in enumerate(on)], *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return named(left, "a").join(named(right, "b"), ["project_id", *[f"_k{i}" for i, c in enumerate(on) if c != "project_id"]]).select("project_id", *[f"{c}_{side}" for side in "ab" for c in columns])


def team_scope_conflicts(scopes: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, task_a, pattern_a, task_b, pattern_b: scopes of different open tasks with equal patterns, or where
    one is ``**``."""
    return equal_or_all(active_scopes(scopes, tasks), ["project_id"])


def equal_or_all(scopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, task_a, pattern_a, task_b, pattern_b: scopes (keys, task_id, pattern) of different tasks within a key
    with equal patterns, or where one is ``**``."""
    own = scopes.select(*keys, "task_id", "pattern").distinct()
    a = own.select(*keys, F.col("task_id").alias("task_a"), F.col("pattern").alias("pattern_a"))
    b = own.select(*keys, F.col("task_id").alias("task_b"), F.col("pattern").alias("pattern_b"))
    columns = [*keys, "task_a", "pattern_a", "task_b", "pattern_b"]
    equal = a.withColumn("pattern_b", F.col("pattern_a")).join(b, [*keys, "pattern_b"]).select(*columns)
    everything = a.join(b.filter("pattern_b = '**'"), list(keys)).select(*columns)
    first = F.struct("task_a", "pattern_a") < F.struct("task_b", "pattern_b")
    turned = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y)).alias(x)
    pairs = equal.unionByName(everything).filter("task_a <> task_b")
    return pairs.select(*keys, turned("task_a", "task_b"), turned("pattern_a", "pattern_b"), turned("task_b", "task_a"), turned("pattern_b", "pattern_a")).distinct()
