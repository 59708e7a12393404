"""Lists of records: filters, projections and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklog.functions.expr import clip_json_strings, like_any, lookup, normalise_enum
from worklog.schema import LEGACY_EVENTS


def project_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The columns that are asked for and exist, in their own order."""
    return df.select([c for c in df.columns if c in fields])


def list_tasks(df: DataFrame, status: str | None = None, owner: str | None = None, ready: bool = False, blocked: bool = False, mine: str | None = None) -> DataFrame:
    """Tasks by status and owner, newest first; ready takes planned and ready ones."""
    wanted: list[Column] = []
    if status:
        wanted.append(F.col("status") == status)
    if owner or mine:
        wanted.append(F.col("owner_agent_id") == (owner or mine))
    if ready:
        wanted.append(F.col("status").isin("planned", "ready"))
    if blocked:
        wanted.append(F.col("status") == "blocked")
    for w in wanted:
        df = df.filter(w)
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def list_agents(df: DataFrame, status: str | None = None) -> DataFrame:
    return (df.filter(F.col("status") == status) if status else df).orderBy("name", "id")


def list_handoffs(df: DataFrame, status: str | None = "pending", target: str | None = None) -> DataFrame:
    """Hand-offs in a state (open is pending, rejected is declined; None: all), for one agent or all, newest first."""
    if status:
        df = df.filter(F.col("state") == normalise_enum(F.lower(F.lit(status)), "handoff_state"))
    if target:
        df = df.filter(F.col("to_agent_id") == target)
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def list_progress(df: DataFrame, include_removed: bool = False) -> DataFrame:
    return (df if include_removed else df.filter("status <> 'removed'")).orderBy("task_id", "position", "id")


def list_entity(df: DataFrame, kind: str, task_id: str | None = None) -> DataFrame:
    """Checkpoints, decisions, sessions and worktrees newest first, teams by name; of one task or all."""
    if task_id:
        df = df.filter(F.col("task_id") == task_id)
    newest = {"checkpoints": "created_at", "decisions": "created_at", "sessions": "started_at", "worktrees": "bound_at"}
    return df.orderBy("name", "id") if kind == "teams" else df.orderBy(F.desc(newest[kind]), F.desc("id"))


def active_sessions(df: DataFrame, agent: str | None = None, worktree: str | None = None) -> DataFrame:
    df = df.filter("state = 'active'")
    if agent:
        df = df.filter(F.col("agent_id") == agent)
    if worktree:
        df = df.filter(F.col("worktree_id") == worktree)
    return df.orderBy(F.desc("last_activity_at"), F.desc("id"))


def filter_events(df: DataFrame, task: str | None = None, actor: str | None = None, session: str | None = None, event_type: str | None = None, since=None, until=None) -> DataFrame:
    """Events by their keys and an inclusive span of time; a type also finds its old misspelt name."""
    for name, value in (("task_id", task), ("actor_agent_id", actor), ("session_id", session)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    if event_type is not None:
        df = df.filter(F.col("type").isin(event_type, *[old for old, new in LEGACY_EVENTS.items() if new == event_type]))
    if since is not None:
        df = df.filter(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("occurred_at") <= F.lit(until))
    return df


def normalise_event_types(df: DataFrame) -> DataFrame:
    return df.withColumn("type", lookup(F.col("type"), LEGACY_EVENTS))


def page_events(df: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """A page of events, newest first, with one row more than asked for where another page follows.

    The cursor is the last row's (occurred_at, id); only events strictly below it come.
    """
    if cursor is not None:
        at, event = cursor
        df = df.filter((F.col("occurred_at") < F.lit(at)) | ((F.col("occurred_at") == F.lit(at)) & (F.col("id") < F.lit(event))))
    return df.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit + 1)


def compact_progress(df: DataFrame) -> DataFrame:
    return df.filter("status = 'open'").select("id", "task_id", "type", "content", "position")


def compact_task(df: DataFrame) -> DataFrame:
    return df.select("id", "display_id", "title", "status", "priority")


def compact_event(df: DataFrame) -> DataFrame:
    return df.select("type", "occurred_at", clip_json_strings(F.col("payload_json")).alias("payload_json"))


def search_decisions(df: DataFrame, q: str) -> DataFrame:
    """Decisions whose title, context, body, consequences or rationale hold the text, newest first."""
    fields = ["title", "context", "decision_body", "consequences", "rationale"]
    return df.filter(like_any([F.col(c) for c in fields], q)).orderBy(F.desc("created_at"), F.desc("id"))
