"""Entity schemas and the fixed rule values of the work log."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampNTZType()
_LIST = T.ArrayType(_S)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "projects": _struct(id=_S, name=_S, task_prefix=_S, repository_root=_S, git_common_dir=_S, main_branch=_S, schema_version=T.IntegerType(), created_at=_TS, updated_at=_TS),
    "events": _struct(id=_S, project_id=_S, type=_S, aggregate_type=_S, aggregate_id=_S, payload_json=_S, occurred_at=_TS, actor_agent_id=_S, session_id=_S, task_id=_S),
    "sequences": _struct(project_id=_S, kind=_S, next_value=_L),
    "agents": _struct(id=_S, project_id=_S, name=_S, provider=_S, role=_S, kind=_S, status=_S, metadata_json=_S, created_at=_TS, updated_at=_TS, last_active_at=_TS),
    "tasks": _struct(
        id=_S, project_id=_S, display_id=_S, title=_S, description=_S, status=_S, priority=_S, owner_agent_id=_S, parent_task_id=_S, metadata_json=_S,
        created_at=_TS, updated_at=_TS, started_at=_TS, completed_at=_TS, required_role=_S, team_id=_S,
    ),
    "task_dependencies": _struct(id=_S, project_id=_S, task_id=_S, prerequisite_task_id=_S, kind=_S, created_at=_TS),
    "progress_items": _struct(
        id=_S, project_id=_S, display_id=_S, task_id=_S, source_session_id=_S, type=_S, status=_S, content=_S, percentage=T.IntegerType(), position=T.IntegerType(),
        created_at=_TS, updated_at=_TS, completed_at=_TS, removed_at=_TS,
    ),
    "worktrees": _struct(id=_S, project_id=_S, task_id=_S, normalized_path=_S, git_common_dir=_S, branch=_S, head=_S, git_snapshot_json=_S, bound_at=_TS, updated_at=_TS),
    "sessions": _struct(
        id=_S, project_id=_S, agent_id=_S, task_id=_S, worktree_id=_S, state=_S, provider=_S, working_directory=_S, branch=_S, head=_S, metadata_json=_S,
        started_at=_TS, last_activity_at=_TS, ended_at=_TS, summary=_S, updated_at=_TS,
    ),
    "checkpoints": _struct(
        id=_S, project_id=_S, task_id=_S, session_id=_S, worktree_id=_S, agent_id=_S, branch=_S, head=_S, dirty=T.BooleanType(),
        staged_files=_LIST, modified_files=_LIST, deleted_files=_LIST, untracked_files=_LIST, changed_files=_LIST,
        renamed_files=T.ArrayType(T.StructType([T.StructField("from", _S), T.StructField("to", _S)])),
        diff_files=_L, diff_insertions=_L, diff_deletions=_L, done=_LIST, remaining=_LIST, blockers=_LIST, risks=_LIST, next_steps=_LIST, notes=_LIST, vcs_backend=_S, created_at=_TS,
    ),
    "checkpoint_corrections": _struct(
        id=_S, checkpoint_id=_S, project_id=_S, done=_LIST, remaining=_LIST, blockers=_LIST, risks=_LIST, next_steps=_LIST, notes=_LIST, reason=_S, corrected_at=_TS
    ),
    "scopes": _struct(id=_S, project_id=_S, task_id=_S, pattern=_S, kind=_S, created_at=_TS),
    "decisions": _struct(
        id=_S, project_id=_S, task_id=_S, session_id=_S, display_id=_S, title=_S, context=_S, decision_body=_S, consequences=_S, rationale=_S, alternatives=_LIST, tags=_LIST,
        created_by_agent=_S, created_by_session=_S, superseded_by=_S, created_at=_TS, updated_at=_TS,
    ),
    "handoffs": _struct(
        id=_S, project_id=_S, from_agent_id=_S, to_agent_id=_S, task_id=_S, session_id=_S, state=_S, display_id=_S, summary=_S, context_json=_S, head=_S, branch=_S,
        created_at=_TS, updated_at=_TS, accepted_at=_TS, declined_at=_TS, expires_at=_TS,
    ),
    "graph_nodes": _struct(id=_S, project_id=_S, node_type=_S, name=_S, description=_S, metadata=_S, created_at=_TS, updated_at=_TS),
    "graph_edges": _struct(source_id=_S, target_id=_S, project_id=_S, relation_type=_S, created_at=_TS, created_by=_S, metadata=_S),
    "teams": _struct(id=_S, project_id=_S, name=_S, commander_agent_id=_S, created_at=_TS, updated_at=_TS),
    "team_members": _struct(project_id=_S, team_id=_S, agent_id=_S, role=_S, created_at=_TS, updated_at=_TS),
    "path_mappings": _struct(path_prefix=_S, project_id=_S),
}

# The words that columns may hold.
ENUMS = {
    "task_status": ["planned", "ready", "in_progress", "blocked", "review", "completed", "cancelled"],
    "task_priority": ["low", "normal", "high", "urgent"],
    "session_state": ["active", "paused", "ended", "stale", "abandoned"],
    "progress_type": ["todo", "blocker", "risk", "note"],
    "progress_status": ["open", "completed", "removed"],
    "handoff_state": ["pending", "accepted", "declined", "expired", "closed"],
    "agent_status": ["active", "inactive", "deactivated"],
    "agent_kind": ["commander", "subagent"],
    "dependency_kind": ["strong", "informational"],
    "scope_kind": ["include", "exclude"],
}

# Other names for the same word, by domain.
ALIASES = {
    "task_priority": {"backlog": "low", "medium": "normal", "critical": "urgent"},
    "progress_type": {"block": "blocker"},
    "handoff_state": {"open": "pending", "rejected": "declined"},
}

# Event names and their old misspelt forms.
LEGACY_EVENTS = {"task.completeed": "task.completed", "task.releaseed": "task.released", "task.canceled": "task.cancelled"}

# The event of each task action.
ACTION_EVENTS = {
    "claim": "task.claimed", "release": "task.released", "start": "task.started", "block": "task.blocked", "unblock": "task.unblocked",
    "review": "task.reviewed", "complete": "task.completed", "cancel": "task.cancelled", "reopen": "task.reopened",
}

TERMINAL = ["completed", "cancelled"]

# Session moves and progress moves that are allowed.
SESSION_MOVES = {"active": ["paused", "ended", "stale", "abandoned"], "paused": ["active", "ended", "abandoned"], "stale": ["active", "ended", "abandoned"]}
PROGRESS_MOVES = {"open": ["completed", "removed"], "completed": ["open", "removed"]}
