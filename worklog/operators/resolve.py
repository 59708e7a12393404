"""Resolving references to records: tasks, agents, teams, paths and worktrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_refs(df: DataFrame, ref_col: str, dim: DataFrame, keys: Sequence[str], id_col: str = "id", out: str = "resolved_id") -> DataFrame:
    """Add the id that a human reference names, the keys tried in order; null if none fits.

    Keys are looked up within a project. A key that several records share names the first of them by name, then id.
    """
    by = "name" if "name" in dim.columns else id_col
    found = []
    for k, key in enumerate(keys):
        side = dim.filter(F.col(key).isNotNull()).groupBy(F.col("project_id").alias(f"_p{k}"), F.col(key).alias(f"_k{k}")).agg(F.min_by(id_col, F.struct(by, id_col)).alias(f"_id{k}"))
        df = df.join(side, (df["project_id"] == side[f"_p{k}"]) & (df[ref_col] == side[f"_k{k}"]), "left").drop(f"_p{k}", f"_k{k}")
        found.append(F.col(f"_id{k}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"_id{k}" for k in range(len(keys))])


def ancestor_prefixes(path, mode: str = "separator"):
    """The path and each of its leading parts that end before a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def prefix_join(paths: DataFrame, prefixes: DataFrame, path_col: str = "path", prefix_col: str = "path_prefix", value_col: str = "project_id", mode: str = "longest", order_col: str | None = None) -> DataFrame:
    """Add the value of the prefix that a path lies under, or null.

    Paths lie under a prefix that they equal or that a slash follows. The longest prefix counts, or with mode "latest"
    the one with the largest order_col. Each path is opened into its own leading parts, so this is an equi-join.
    """
    rank = F.struct(F.length(prefix_col), prefix_col) if mode == "longest" else F.struct(order_col, F.length(prefix_col), prefix_col)
    side = prefixes.select(F.regexp_replace(prefix_col, "(?<=.)/+$", "").alias("_prefix"), F.col(value_col).alias("_value"), rank.alias("_rank"))
    opened = paths.select(path_col).distinct().withColumn("_prefix", F.explode(ancestor_prefixes(F.col(path_col))))
    best = opened.join(side, "_prefix").groupBy(path_col).agg(F.max_by("_value", "_rank").alias(value_col))
    return paths.join(best, path_col, "left")


def resolve_current_task(ctx: DataFrame, tasks: DataFrame, sessions: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Add task_id and source to context rows (ctx_id, project_id, agent_id, cwd, task_ref).

    An explicit reference (display id or id) ends the search even if it names nothing. Else the task of the project's
    active session that started last, the task of the worktree that the directory lies in, or the agent's only task in
    progress.
    """
    explicit = resolve_refs(ctx, "task_ref", tasks.select("project_id", "id", "display_id"), ["display_id", "id"], out="_explicit")
    last = sessions.filter("state = 'active' AND task_id IS NOT NULL").groupBy("project_id").agg(F.max_by("task_id", F.struct("started_at", "id")).alias("_session_task"))
    bound = worktrees.filter("task_id IS NOT NULL").select(F.col("normalized_path").alias("path_prefix"), F.col("task_id").alias("_worktree_task"))
    only = tasks.filter("status = 'in_progress' AND owner_agent_id IS NOT NULL").groupBy("project_id", F.col("owner_agent_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_own_task"))
    rows = explicit.join(last, "project_id", "left").withColumnRenamed("cwd", "path")
    rows = prefix_join(rows, bound, value_col="_worktree_task").withColumnRenamed("path", "cwd")
    rows = rows.join(only.filter("_n = 1").drop("_n"), ["project_id", "agent_id"], "left")
    asked = F.col("task_ref").isNotNull()
    source = F.when(asked, F.when(F.col("_explicit").isNotNull(), "explicit").otherwise("not_found"))
    for name in ("session", "worktree", "own"):
        source = source.when(F.col(f"_{name}_task").isNotNull(), name)
    task = F.when(asked, F.col("_explicit")).otherwise(F.coalesce("_session_task", "_worktree_task", "_own_task"))
    return rows.select(*ctx.columns, task.alias("task_id"), source.otherwise("none").alias("source"))


def resolve_current_agent(ctx: DataFrame, agents: DataFrame, default_name: str | None = None) -> DataFrame:
    """Add resolved_agent and candidates to context rows (ctx_id, project_id, agent_ref).

    An explicit name or id, else the default name, else the only active agent of the project; of several, up to ten
    names are listed and none is chosen.
    """
    rows = resolve_refs(ctx, "agent_ref", agents, ["name", "id"], out="_explicit")
    named = agents.filter(F.col("name") == F.lit(default_name)).groupBy("project_id").agg(F.min("id").alias("_default"))
    active = agents.filter("status = 'active'").groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
    ranked = F.row_number().over(_by_name())
    few = agents.filter("status = 'active'").withColumn("_r", ranked).filter("_r <= 10").groupBy("project_id").agg(F.sort_array(F.collect_list("name")).alias("_names"))
    rows = rows.join(named, "project_id", "left").join(active, "project_id", "left").join(few, "project_id", "left")
    fallback = F.coalesce("_default", F.when(F.col("_n") == 1, F.col("_one")))
    agent = F.when(F.col("agent_ref").isNotNull(), F.col("_explicit")).otherwise(fallback)
    return rows.select(*ctx.columns, agent.alias("resolved_agent"), F.when(agent.isNull() & F.col("agent_ref").isNull() & (F.col("_n") > 1), F.col("_names")).alias("candidates"))


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("project_id").orderBy("name", "id")


def resolve_team(ctx: DataFrame, tasks: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """Add team_id to context rows (ctx_id, project_id, task_id, agent_id): the task's team, else the agent's first team
    by name, else the project's only team."""
    by_task = tasks.filter("team_id IS NOT NULL").select("project_id", F.col("id").alias("task_id"), F.col("team_id").alias("_task_team"))
    named = members.join(teams.select("project_id", F.col("id").alias("team_id"), F.col("name").alias("_name")), ["project_id", "team_id"])
    by_agent = named.groupBy("project_id", "agent_id").agg(F.min_by("team_id", F.struct("_name", "team_id")).alias("_agent_team"))
    only = teams.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_only"))
    rows = ctx.join(by_task, ["project_id", "task_id"], "left").join(by_agent, ["project_id", "agent_id"], "left").join(only, "project_id", "left")
    return rows.select(*ctx.columns, F.coalesce("_task_team", "_agent_team", F.when(F.col("_n") == 1, F.col("_only"))).alias("team_id"))


def orphaned_tasks(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks whose owner is no agent of the project."""
    owners = agents.select("project_id", F.col("id").alias("owner_agent_id"))
    return tasks.filter("owner_agent_id IS NOT NULL").join(owners, ["project_id", "owner_agent_id"], "left_anti")


def reconcile_registry(registered: DataFrame, observed: DataFrame) -> DataFrame:
    """project_id, normalized_path, verdict: observed but not registered (candidate, unless detached or the root), or
    registered but not observed (stale)."""
    keys = ["project_id", "normalized_path"]
    new = observed.filter("NOT detached AND NOT is_root").join(registered, keys, "left_anti").select(*keys, F.lit("candidate").alias("verdict"))
    return new.unionByName(registered.join(observed, keys, "left_anti").select(*keys, F.lit("stale").alias("verdict")))
