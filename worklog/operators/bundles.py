"""Denormalised reports; every part is aggregated per key before it is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklog.functions.expr import clip_json_strings
from worklog.operators.latest import current_session, latest_checkpoints, recent_events
from worklog.operators.resolve import resolve_current_task
from worklog.operators.scopes import equal_or_all
from worklog.sources.shared import stored

SLICE = ["project_id", "team_id", "key"]
CONTEXT = ["project_id", "ctx_id"]


def _collected(df: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """The keys, all rows of each, or the first so many, in the order of the columns as a list, and n_ with the number of all."""
    own, kept = df.select(*keys, F.struct(*columns).alias("_row")), F.col("_row")
    if limit is not None:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_row")))
        kept = F.when(F.col("_n") <= limit, kept)
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sort_array(F.collect_list(kept)).alias(name))


def _lists(tables: dict[str, DataFrame], events: int, since: Column | None, compact: bool) -> dict[str, DataFrame]:
    """The rows behind a bundle's progress and events, by project_id and task_id."""
    visible = tables["progress_items"].filter("status = 'open'" if compact else "status <> 'removed'")
    log = tables["events"] if since is None else tables["events"].filter(F.col("occurred_at") >= since)
    payload = [clip_json_strings(F.col("payload_json")).alias("payload_json")] if compact else []
    newest = recent_events(log, "task_id", events)
    keys = ["project_id", "task_id"]
    return {"progress": visible.select(*keys, "position", "id", "type", "content"), "events": newest.select(*keys, "occurred_at", "id", "type", *payload)}


def bundle_lists(rows: DataFrame, tables: dict[str, DataFrame], events: int = 10, since: Column | None = None, compact: bool = False) -> dict[str, DataFrame]:
    """progress, events and decisions of each context row (project_id, ctx_id, task_id), whole, as tables with its project_id and ctx_id.

    They have all that the lists of resume_bundle and context_bundle have, for lists that are too long for one row; the nodes
    and edges of context_bundle are those of context_graph.
    """
    of = rows.filter("task_id IS NOT NULL").select(*CONTEXT, "task_id").distinct()
    lists = _lists(tables, events, since, compact) | {"decisions": tables["decisions"].select("project_id", "task_id", "display_id", "title")}
    return {name: of.join(df, ["project_id", "task_id"]).drop("task_id") for name, df in lists.items()}


def resume_bundle(ctx: DataFrame, tables: dict[str, DataFrame], events: int = 10, since: Column | None = None, compact: bool = False) -> DataFrame:
    """Per context row: current session and task, latest checkpoint, visible progress and the newest events.

    Lists are whole and in their order; n_progress and n_events count them.
    """
    return _with_lists(_resolved(ctx, tables), tables, events, since, compact)


def _resolved(ctx: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return resolve_current_task(ctx, tables["tasks"], tables["sessions"], tables["worktrees"]).join(current_session(tables["sessions"]), ["project_id", "agent_id"], "left")


def _with_lists(rows: DataFrame, tables: dict[str, DataFrame], events: int, since: Column | None, compact: bool) -> DataFrame:
    """Context rows with current task and session, and what resume_bundle adds to them."""
    task = tables["tasks"].select("project_id", F.col("id").alias("task_id"), F.struct("id", "display_id", "title", "status", "priority").alias("task"))
    saved = latest_checkpoints(tables["checkpoints"]).select("project_id", "task_id", F.struct("id", "created_at", "done", "remaining").alias("checkpoint"))
    keys = ["project_id", "task_id"]
    whole = [_collected(df, keys, name, [c for c in df.columns if c not in keys]) for name, df in _lists(tables, events, since, compact).items()]
    for side in (task, saved, *whole):
        rows = rows.join(side, keys, "left")
    return rows


def context_graph(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) round the task_id and the file of each context row (project_id, ctx_id, task_id, perhaps file).

    The edges that touch the task's node or that of the file node with this name, each once a context; the known nodes
    at their other ends, and the file's own node.
    """
    starts = rows.filter("task_id IS NOT NULL").select(*CONTEXT, F.col("task_id").alias("_start")).distinct()
    own = None
    if "file" in rows.columns:
        named = nodes.filter("node_type = 'file'").select("project_id", F.col("name").alias("file"), F.col("id").alias("_start"))
        own = rows.join(named, ["project_id", "file"]).select(*CONTEXT, "_start").distinct()
        starts = starts.unionByName(own).distinct()
    ends = ["source_id", "target_id"]
    either = F.explode(F.array(*[F.struct(F.col(here).alias("_start"), F.col(there).alias("id")) for here, there in (ends, ends[::-1])]))
    sides = edges.select("project_id", *ends, "relation_type", either.alias("_end")).select("project_id", *ends, "relation_type", "_end.*")
    touching = stored(sides.join(starts, ["project_id", "_start"]).select(*CONTEXT, *ends, "relation_type", "id"), "touching-edges")
    seen = touching.select(*CONTEXT, "id")
    if own is not None:
        seen = seen.unionByName(own.withColumnRenamed("_start", "id"))
    found = seen.distinct().join(nodes.select("project_id", "id", "node_type", "name"), ["project_id", "id"])
    return found.select(*CONTEXT, "id", "node_type", "name"), touching.select(*CONTEXT, *ends, "relation_type").distinct()


def context_bundle(ctx: DataFrame, tables: dict[str, DataFrame], compact: bool = True, now: Column | None = None, look_back_days: int = 7, events: int = 10) -> DataFrame:
    """The resume bundle with the task's decisions, and the nodes and edges round the task and the context's file.

    The compact form has open progress alone, clips long strings and looks back so many days. Lists are whole; events are
    the newest so many. ctx needs a ctx_id, and a column file where neighbours of files are asked for.
    """
    since = now - F.make_dt_interval(days=F.lit(look_back_days)) if compact and now is not None else None
    own = stored(_resolved(ctx, tables), "contexts")
    rows = _with_lists(own, tables, events, since, compact)
    decided = _collected(tables["decisions"], ["project_id", "task_id"], "decisions", ["display_id", "title"])
    nodes, edges = context_graph(own, tables["graph_nodes"], tables["graph_edges"])
    rows = rows.join(decided, ["project_id", "task_id"], "left").join(_collected(nodes, CONTEXT, "nodes", ["id", "node_type", "name"]), CONTEXT, "left")
    return rows.join(_collected(edges, CONTEXT, "edges", ["source_id", "target_id", "relation_type"]), CONTEXT, "left")


def team_lists(tables: dict[str, DataFrame], view: str = "commander", key: str | None = None, events: int = 50) -> dict[str, DataFrame]:
    """The parts of a team's context as whole tables with project_id, team_id and key in front: members, tasks, inner
    dependencies, scopes, conflicts, open blockers, progress, latest checkpoints, decisions, hand-offs, the newest events
    and the session to rebuild from.

    A slice is a team (commander), the tasks that an agent owns in a team (member) or a task; key is its id. Every list
    is narrowed alike: a member's slice has that member, a task's slice the task's owner. Without key all slices are
    given at once. Tasks of unknown teams are in none.
    """
    by = {"commander": "team_id", "member": "owner_agent_id", "task": "id"}
    if view not in by:
        raise ValueError(f"unknown view {view}")
    known = tables["teams"].select("project_id", F.col("id").alias("team_id"))
    tasks = tables["tasks"].join(known, ["project_id", "team_id"], "left_semi").withColumn("key", F.col(by[view])).filter("key IS NOT NULL")
    if key is not None:
        tasks = tasks.filter(F.col("key") == key)
    tasks = stored(tasks.select(*dict.fromkeys([*SLICE, "id", "created_at", "status", "owner_agent_id"])), "team-tasks")
    people = tables["team_members"].join(known, ["project_id", "team_id"], "left_semi")
    if view == "task":
        people = people.join(tasks.select(*SLICE, F.col("owner_agent_id").alias("agent_id")), ["project_id", "team_id", "agent_id"])
    else:
        people = people.withColumn("key", F.col("team_id" if view == "commander" else "agent_id"))
    if key is not None:
        people = people.filter(F.col("key") == key)
    slices = tasks.select(*SLICE, F.col("id").alias("task_id"))
    inside = lambda df: df.join(slices, ["project_id", "task_id"])
    far = slices.withColumnRenamed("task_id", "prerequisite_task_id")
    scopes = stored(inside(tables["scopes"]).select(*SLICE, *[c for c in tables["scopes"].columns if c not in SLICE]), "team-scopes")
    progress = inside(tables["progress_items"])
    newest = Window.partitionBy(*SLICE).orderBy(F.desc("occurred_at"), F.desc("id"))
    log = inside(tables["events"]).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= events)
    saved = inside(tables["checkpoints"]).filter("session_id IS NOT NULL").groupBy(*SLICE).agg(F.max_by("session_id", F.struct("created_at", "id")).alias("session_id"))
    return {
        "members": people.select(*SLICE, "agent_id", "role"),
        "tasks": tasks.select(*SLICE, "created_at", "id", "status", "owner_agent_id"),
        "dependencies": inside(tables["task_dependencies"]).join(far, [*SLICE, "prerequisite_task_id"], "left_semi").select(*SLICE, "task_id", "prerequisite_task_id", "kind"),
        "scopes": scopes.select(*SLICE, "task_id", "pattern"),
        "conflicts": equal_or_all(scopes, SLICE).select(*SLICE, F.col("task_a").alias("task_id"), F.col("pattern_a").alias("pattern"), F.col("task_b").alias("other_task_id"), F.col("pattern_b").alias("other_pattern")),
        "blockers": progress.filter("type = 'blocker' AND status = 'open'").select(*SLICE, "created_at", "id", "task_id", "content"),
        "progress": progress.select(*SLICE, "task_id", "position", "id", "type", "status", "content"),
        "checkpoints": inside(latest_checkpoints(tables["checkpoints"])).select(*SLICE, "task_id", "id", "created_at"),
        "decisions": inside(tables["decisions"]).select(*SLICE, "created_at", "id", "task_id", "display_id", "title"),
        "handoffs": inside(tables["handoffs"]).select(*SLICE, "created_at", "id", "task_id", "state", "from_agent_id", "to_agent_id"),
        "events": log.select(*SLICE, "occurred_at", "id", "type", "task_id", "actor_agent_id"),
        "rebuild": saved.select(*SLICE, "session_id"),
    }


def team_context(tables: dict[str, DataFrame], view: str = "commander", key: str | None = None, events: int = 50, limit: int | None = None) -> DataFrame:
    """A row for each slice of team_lists: name of the team, its lists and rebuild_session.

    A list is whole; where limit is given, it has so many entries at most, the first in the order of its columns. n_ and its
    name counts all of them. A row grows with its team; team_lists has the lists as tables.
    """
    parts = team_lists(tables, view, key, events)
    named = tables["teams"].select("project_id", F.col("id").alias("team_id"), "name")
    if view == "commander":
        rows = named.withColumn("key", F.col("team_id"))
        rows = rows if key is None else rows.filter(F.col("key") == key)
    else:
        rows = parts["members"].select(*SLICE).unionByName(parts["tasks"].select(*SLICE)).distinct().join(named, ["project_id", "team_id"])
    for name, part in parts.items():
        side = part.withColumnRenamed("session_id", "rebuild_session") if name == "rebuild" else _collected(part, SLICE, name, [c for c in part.columns if c not in SLICE], limit)
        rows = rows.join(side, SLICE, "left")
    return rows
