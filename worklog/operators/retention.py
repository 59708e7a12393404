"""Retention of old tasks and of worktree registrations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklog.sources.shared import exists, move, remove, scratch, stored

CHILDREN = ["checkpoints", "progress_items", "scopes", "decisions", "handoffs"]


def archive_completed(tables: dict[str, DataFrame], now: Column, days: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(kept, archived) tables: completed tasks not updated for so many days leave with all that hangs on them.

    Their checkpoints, corrections, progress, scopes, decisions, hand-offs and dependencies in either direction go along;
    parents, sessions and worktrees that stay lose their link to them. The event log stays as it is.
    """
    judged = _judged(tables, _gone(tables["tasks"], now, days))
    archived = {name: df.filter("_gone").drop("_gone") for name, df in judged.items() if "_gone" in df.columns}
    return {name: df.filter("NOT _gone").drop("_gone") if name in archived else df for name, df in judged.items()}, archived


def _gone(tasks: DataFrame, now: Column, days: int) -> DataFrame:
    old = (F.col("status") == "completed") & (F.col("updated_at") < now - F.make_dt_interval(days=F.lit(days)))
    return tasks.filter(old).select("project_id", F.col("id").alias("task_id")).distinct()


def _judged(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without links to what is gone; those that rows leave have _gone, from one join for each of their keys."""

    def marked(df: DataFrame, column: str, ids: DataFrame, key: str = "task_id") -> DataFrame:
        """Rows whose column is among the ids have _gone, others keep theirs."""
        rows = df.join(ids.select("project_id", F.col(key).alias(column), F.lit(True).alias("_hit")), ["project_id", column], "left")
        before = F.col("_gone") if "_gone" in df.columns else F.lit(False)
        return rows.select(*[c for c in df.columns if c != "_gone"], (before | F.col("_hit").isNotNull()).alias("_gone"))

    judged = dict(tables)
    if "parent_task_id" in tables["tasks"].columns:
        judged["tasks"] = _orphaned(tables["tasks"], gone)
    for name, columns in ({"tasks": ["id"], "task_dependencies": ["task_id", "prerequisite_task_id"]} | {name: ["task_id"] for name in CHILDREN}).items():
        for column in columns if name in tables else []:
            judged[name] = marked(judged[name], column, gone)
    if "_orphaned" in judged["tasks"].columns:
        parent = F.when(F.col("_gone") | ~F.col("_orphaned"), F.col("parent_task_id"))
        judged["tasks"] = judged["tasks"].withColumn("parent_task_id", parent).drop("_orphaned")
    if "checkpoint_corrections" in tables and "checkpoints" in tables:
        ids = judged["checkpoints"].filter("_gone").select("project_id", "id").distinct()
        judged["checkpoint_corrections"] = marked(tables["checkpoint_corrections"], "checkpoint_id", ids, "id")
    for name in ("sessions", "worktrees"):
        if name in tables and "task_id" in tables[name].columns:
            judged[name] = _unlinked(tables[name], "task_id", gone)
    return judged


def _orphaned(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """Tasks with whether their parent is gone; those without a parent, most as a rule, need not move for it."""
    hit = gone.select("project_id", F.col("task_id").alias("parent_task_id"), F.lit(True).alias("_hit"))
    below = tasks.filter("parent_task_id IS NOT NULL").join(hit, ["project_id", "parent_task_id"], "left")
    top = tasks.filter("parent_task_id IS NULL").withColumn("_orphaned", F.lit(False))
    return top.unionByName(below.select(*tasks.columns, F.col("_hit").isNotNull().alias("_orphaned")))


def _unlinked(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    rows = df.join(gone.withColumn("_hit", F.lit(True)), ["project_id", column], "left")
    return rows.withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).select(*df.columns)


def write_archive(archived: dict[str, DataFrame], folder: str, run: str | None = None) -> None:
    """Archived rows, below each table's name in the folder, as the part of a run; without a name each call is a run.

    A run that is written again takes its own place.
    """
    run = run or uuid.uuid4().hex
    for name, df in archived.items():
        df.write.mode("overwrite").partitionBy("project_id").parquet(f"{folder}/{name}/run={run}")


def retire(spark: SparkSession, paths: dict[str, str], folder: str, run: str, now: Column, days: int) -> None:
    """archive_completed over stored tables: what is archived goes below the folder, as write_archive's, and the tables at
    the paths keep the rest.

    Both sides are staged first and marked as whole. Then archives are moved to their place, and only then the tables are
    put in the place of the old ones, which stay below _runs until all are there. Each step sees what is done already: a
    run that was killed anywhere is finished by the same call, and one that is done changes nothing. A table is joined
    and written once for both sides.
    """
    own = f"{folder}/_runs/{run}"
    if exists(spark, f"{own}/done"):
        return
    kept, archived = (lambda name: f"{own}/rows/{name}/_gone=false"), (lambda name: f"{own}/rows/{name}/_gone=true")
    if not exists(spark, f"{own}/staged"):
        tables = {n: spark.read.parquet(p) for n, p in paths.items()}
        with scratch(spark), _open_writers(spark):
            for name, df in _judged(tables, stored(_gone(tables["tasks"], now, days), "gone-tasks")).items():
                if "_gone" not in df.columns:
                    df.write.mode("overwrite").parquet(kept(name))
                    continue
                df.write.mode("overwrite").partitionBy("_gone").parquet(f"{own}/rows/{name}")
                for side in (kept(name), archived(name)):
                    if not exists(spark, side):
                        spark.createDataFrame([], df.drop("_gone").schema).write.parquet(side)
        _mark(spark, f"{own}/staged")
    for name in paths:
        if exists(spark, archived(name)):
            move(spark, archived(name), f"{folder}/{name}/run={run}")
    for name, path in paths.items():
        if exists(spark, kept(name)):
            if exists(spark, path):
                move(spark, path, f"{own}/old/{name}")
            move(spark, kept(name), path)
    _mark(spark, f"{own}/done")
    remove(spark, f"{own}/old")


@contextmanager
def _open_writers(spark: SparkSession) -> Iterator[None]:
    """Within, a task keeps a file open for each of two partitions; rows need not be sorted by partition."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(path)


def prune_registry(registered: DataFrame, observed: DataFrame, sessions: DataFrame, checkpoints: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(worktrees, sessions, checkpoints, events): registrations that are not observed go, their sessions and checkpoints
    are detached, and each leaves an event."""
    stale = registered.join(observed, ["project_id", "normalized_path"], "left_anti")
    ids = stale.select("project_id", F.col("id").alias("worktree_id"))
    payload = F.to_json(F.struct(F.col("normalized_path").alias("path"), F.col("branch")))
    events = stale.select(
        F.concat(F.lit("prune-"), "id").alias("id"), "project_id", F.lit("worktree.pruned").alias("type"), F.lit("worktree").alias("aggregate_type"), F.col("id").alias("aggregate_id"),
        payload.alias("payload_json"), now.alias("occurred_at"),
    )
    kept = registered.join(ids.withColumnRenamed("worktree_id", "id"), ["project_id", "id"], "left_anti")
    return kept, _unlinked(sessions, "worktree_id", ids), _unlinked(checkpoints, "worktree_id", ids), events
