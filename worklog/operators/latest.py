"""Latest rows, ranks and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklog.sources.shared import stored

LIST_FIELDS = ["done", "remaining", "blockers", "risks", "next_steps", "notes"]


def latest_checkpoints(df: DataFrame) -> DataFrame:
    """The newest checkpoint of each task."""
    newest = df.groupBy("project_id", "task_id").agg(F.max_by(F.struct(*df.columns), F.struct("created_at", "id")).alias("_row"))
    return newest.select("_row.*")


def recent_events(df: DataFrame, by: str = "task_id", n: int = 10) -> DataFrame:
    """The newest n events of each key."""
    order = Window.partitionBy("project_id", by).orderBy(F.desc("occurred_at"), F.desc("id"))
    return df.filter(F.col(by).isNotNull()).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def current_session(df: DataFrame) -> DataFrame:
    """project_id, agent_id, session_id of each agent's active session that started last."""
    return df.filter("state = 'active'").groupBy("project_id", "agent_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("session_id"))


def rebuild_session(checkpoints: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, session_id: that of the newest checkpoint of the given tasks that has one."""
    inside = tasks.select("project_id", F.col("id").alias("task_id"))
    rows = checkpoints.filter("session_id IS NOT NULL").join(inside, ["project_id", "task_id"], "left_semi")
    return rows.groupBy("project_id").agg(F.max_by("session_id", F.struct("created_at", "id")).alias("session_id"))


def assign_positions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (project_id, task_id, id, created_at) with position: after the largest of the task, from 0, by time and id."""
    last = existing.groupBy("project_id", "task_id").agg(F.max("position").alias("_last"))
    order = Window.partitionBy("project_id", "task_id").orderBy("created_at", "id")
    return new.join(last, ["project_id", "task_id"], "left").withColumn("position", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).cast("int")).drop("_last")


def allocate_display_ids(new: DataFrame, sequences: DataFrame) -> DataFrame:
    """new (project_id, kind, id, prefix) with display_id: numbers without gaps that go on from the stored sequence.

    Rows are numbered by id. A project and kind may hold most of the rows, so the rows are dealt to sorted ranges of
    (project, kind, id), one a partition: ids are ranked within a range, and the ranges' counts, a row for each range and
    key, give each its start.
    """
    from worklog.functions.expr import format_display_id

    keys = ["project_id", "kind"]
    rows = stored(new.repartitionByRange(*keys, "id").withColumn("_range", F.spark_partition_id()), "ranged-ids")
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("id"))
    numbered = rows.join(starts, [*keys, "_range"]).withColumn("_rank", rank).join(sequences.select(*keys, "next_value"), keys, "left")
    number = F.col("_start") + F.col("_rank") + F.coalesce("next_value", F.lit(1)) - 1
    return numbered.withColumn("display_id", format_display_id(F.col("prefix"), number)).select(*new.columns, "display_id")


def reorder(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items with the positions that order (project_id, task_id, id, new_position) gives them; others keep theirs."""
    keys = ["project_id", "task_id", "id"]
    return items.join(order.select(*keys, "new_position"), keys, "left").withColumn("position", F.coalesce("new_position", "position").cast("int")).select(*items.columns)


def corrected_checkpoints(cp: DataFrame, corr: DataFrame) -> DataFrame:
    """Checkpoints whose list fields show their latest correction that is not null."""
    last = corr.groupBy("project_id", F.col("checkpoint_id").alias("id")).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("corrected_at", F.col("id")))).alias(f"_{f}") for f in LIST_FIELDS]
    )
    rows = cp.join(last, ["project_id", "id"], "left")
    return rows.withColumns({f: F.coalesce(f"_{f}", f) for f in LIST_FIELDS}).select(*cp.columns)
