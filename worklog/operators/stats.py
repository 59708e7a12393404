"""Counts and statistics; every child table is aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklog.functions.expr import seconds_between
from worklog.schema import TERMINAL


def task_status_counts(tasks: DataFrame) -> DataFrame:
    """Per project the tasks that are planned, ready, in progress, completed and cancelled, and all of them."""
    named = ["planned", "ready", "in_progress", "completed", "cancelled"]
    return tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in named])


def entity_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """project_id and <name>_total for each table; no rows count 0."""
    rows = None
    for name, df in tables.items():
        counts = df.groupBy("project_id").agg(F.count(F.lit(1)).alias(f"{name}_total"))
        rows = counts if rows is None else rows.join(counts, "project_id", "full_outer")
    return rows.select("project_id", *[F.coalesce(f"{n}_total", F.lit(0)).alias(f"{n}_total") for n in tables])


def session_seconds(df: DataFrame) -> DataFrame:
    """Add seconds: from start to end, or to the last activity; nulls where a time is missing."""
    return df.withColumn("seconds", seconds_between(F.col("started_at"), F.coalesce("ended_at", "last_activity_at")))


def agent_stats(agents: DataFrame, sessions: DataFrame, checkpoints: DataFrame, tasks: DataFrame, progress: DataFrame, agent: str | None = None, compat: bool = False) -> DataFrame:
    """Per agent its sessions, seconds, checkpoints, completed tasks and reported blockers, longest first.

    With compat an agent without sessions is reported with one.
    """
    keys = ["project_id", "agent_id"]
    time = session_seconds(sessions).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_sessions"), F.sum("seconds").alias("total_seconds"))
    saved = checkpoints.filter("agent_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("total_checkpoints"))
    done = tasks.filter("status = 'completed' AND owner_agent_id IS NOT NULL").groupBy("project_id", F.col("owner_agent_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("tasks_completed"))
    of_session = sessions.select("project_id", F.col("id").alias("source_session_id"), "agent_id")
    blockers = progress.filter("type = 'blocker'").join(of_session, ["project_id", "source_session_id"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("blockers_reported"))
    rows = agents.select("project_id", F.col("id").alias("agent_id"), F.col("name").alias("agent_name"))
    if agent is not None:
        rows = rows.filter((F.col("agent_id") == agent) | (F.col("agent_name") == agent))
    for side in (time, saved, done, blockers):
        rows = rows.join(side, keys, "left")
    numbers = ["total_sessions", "total_seconds", "total_checkpoints", "tasks_completed", "blockers_reported"]
    least = {n: (1 if compat and n == "total_sessions" else 0) for n in numbers}
    return rows.select(*keys, "agent_name", *[F.coalesce(n, F.lit(least[n])).cast("long").alias(n) for n in numbers]).orderBy(F.desc("total_seconds"), "agent_name", "agent_id")


def team_status(teams: DataFrame, members: DataFrame, agents: DataFrame, sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per team its counts and member_list: (agent_id, role, kind, session_id, open_tasks as ids, open_count), sorted."""
    now = sessions.filter("state = 'active'").groupBy("project_id", "agent_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("session_id"))
    open_tasks = tasks.filter(~F.col("status").isin(TERMINAL) & F.col("team_id").isNotNull())
    owned = open_tasks.filter("owner_agent_id IS NOT NULL").groupBy("project_id", "team_id", F.col("owner_agent_id").alias("agent_id")).agg(F.sort_array(F.collect_list("id")).alias("open_tasks"))
    kinds = agents.select("project_id", F.col("id").alias("agent_id"), "kind")
    rows = members.select("project_id", "team_id", "agent_id", "role").join(kinds, ["project_id", "agent_id"], "left").join(now, ["project_id", "agent_id"], "left").join(owned, ["project_id", "team_id", "agent_id"], "left")
    rows = rows.withColumn("open_tasks", F.coalesce("open_tasks", F.array().cast("array<string>")))
    listed = rows.groupBy("project_id", "team_id").agg(
        F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list(F.struct("agent_id", "role", "kind", "session_id", "open_tasks", F.size("open_tasks").alias("open_count")))).alias("member_list")
    )
    free = open_tasks.filter("owner_agent_id IS NULL").groupBy("project_id", "team_id").agg(F.count(F.lit(1)).alias("unassigned_open_tasks"))
    out = teams.select("project_id", F.col("id").alias("team_id"), "name", "commander_agent_id").join(listed, ["project_id", "team_id"], "left").join(free, ["project_id", "team_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    commander = F.when(F.col("commander_agent_id").isNotNull(), 1).otherwise(0).cast("long")
    return out.select("project_id", "team_id", "name", zero("members"), commander.alias("commanders"), (F.coalesce("members", F.lit(0)) - commander).cast("long").alias("subagents"), zero("unassigned_open_tasks"), "member_list")


def project_overview(projects: DataFrame, agents: DataFrame, tasks: DataFrame, sessions: DataFrame, worktrees: DataFrame, n: int = 15) -> DataFrame:
    """Per project counts of active sessions and agents, tasks and worktrees; the n newest open tasks and how many more."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    live = tasks.filter(F.col("status").isin("in_progress", "review", "blocked"))
    newest = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = live.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("active_tasks"))
    rows = projects.select(F.col("id").alias("project_id"), "name")
    for side in (count(sessions.filter("state = 'active'"), "active_sessions"), count(agents.filter("status = 'active'"), "active_agents"), count(tasks, "tasks"), count(worktrees, "worktrees"), count(live, "_live"), top):
        rows = rows.join(side, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    more = F.greatest(F.lit(0).cast("long"), F.coalesce("_live", F.lit(0)) - n)
    return rows.select("project_id", "name", *[zero(c) for c in ("active_sessions", "active_agents", "tasks", "worktrees")], F.coalesce("active_tasks", F.array().cast("array<string>")).alias("active_tasks"), more.alias("more_tasks"))


def task_facts(tasks: DataFrame, progress: DataFrame, sessions: DataFrame, deps: DataFrame) -> DataFrame:
    """Per task open_progress, has_active_session, has_incomplete_prerequisite and has_owner."""
    from worklog.operators.deps import incomplete_prerequisites

    keys = ["project_id", "id"]
    waiting = progress.filter("status = 'open'").groupBy("project_id", F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("open_progress"))
    busy = sessions.filter("state = 'active' AND task_id IS NOT NULL").select("project_id", F.col("task_id").alias("id"), F.lit(True).alias("has_active_session")).distinct()
    held = incomplete_prerequisites(deps, tasks).select("project_id", F.col("task_id").alias("id"), F.lit(True).alias("has_incomplete_prerequisite")).distinct()
    rows = tasks.select("project_id", "id", "status", F.col("owner_agent_id").isNotNull().alias("has_owner")).join(waiting, keys, "left").join(busy, keys, "left").join(held, keys, "left")
    return rows.select(*keys, "status", "has_owner", F.coalesce("open_progress", F.lit(0)).alias("open_progress"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_active_session", "has_incomplete_prerequisite")])


def busy_agents(tasks: DataFrame) -> DataFrame:
    """Agents that own open tasks, and how many."""
    return tasks.filter(~F.col("status").isin(TERMINAL) & F.col("owner_agent_id").isNotNull()).groupBy("project_id", F.col("owner_agent_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("open_tasks"))
