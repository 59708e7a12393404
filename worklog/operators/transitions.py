"""State changes judged and applied to whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklog.functions.expr import lookup
from worklog.operators import folds
from worklog.operators.folds import positioned, states_before
from worklog.operators.listing import normalise_event_types
from worklog.operators.resolve import resolve_refs
from worklog.schema import ACTION_EVENTS, ENUMS, LEGACY_EVENTS, PROGRESS_MOVES, SESSION_MOVES, TERMINAL
from worklog.sources.shared import stored

DENIED = "INVALID_TASK_TRANSITION"
#: Status and whether there is an owner: what the requests of one batch change of a task's facts.
STATES = [(status, owned) for status in ENUMS["task_status"] for owned in (False, True)]
#: The columns that order several requests for one row; request is unique.
TURN = ["at", "request"]


def _rules(strict: bool) -> list[tuple[Column, str | Column, str]]:
    """(condition, new status or denial code, what happens to the owner) in the order in which they are tried."""
    action, status = F.col("action"), F.col("status")
    deps, owned = ~F.col("has_incomplete_prerequisite"), F.col("has_owner")
    busy, reason = F.col("has_active_session"), F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0
    pending = F.col("open_progress") > 0
    does = lambda name, *states: (action == name) & (status.isin(*states) if states else F.lit(True))
    open_status = ~status.isin(*TERMINAL)
    back = F.when(deps, "ready").otherwise("planned")
    return [
        (does("claim", "ready") & ~owned & deps, "in_progress", "actor"),
        (does("claim") & owned, "TASK_ALREADY_CLAIMED", "deny"),
        (does("claim") & ~deps, "DEPENDENCY_INCOMPLETE", "deny"),
        (does("release", "in_progress", "blocked", "review") & ~busy, back, "clear"),
        (does("release") & busy, "STATE_CONFLICT", "deny"),
        (does("start", "ready", "planned") & deps, "in_progress", "keep"),
        (does("start", "in_progress"), "in_progress", "keep"),
        (does("start") & ~deps, "DEPENDENCY_INCOMPLETE", "deny"),
        (does("block", "in_progress", "ready", "planned", "review") & reason, "blocked", "keep"),
        (does("block") & ~reason, "VALIDATION_FAILED", "deny"),
        (does("unblock", "blocked", "planned") & ~deps, "DEPENDENCY_INCOMPLETE", "deny"),
        (does("unblock", "blocked", "planned"), F.when(owned, "in_progress").otherwise("ready"), "keep"),
        (does("review", "in_progress"), "review", "keep"),
        (does("complete", "review", "in_progress") & pending & F.lit(strict), "STATE_CONFLICT", "deny"),
        (does("complete", "review", "in_progress"), "completed", "keep"),
        (does("cancel") & open_status & reason, "cancelled", "clear"),
        (does("cancel") & open_status, "VALIDATION_FAILED", "deny"),
        (does("reopen", "completed", "cancelled"), back, "clear"),
    ]


def evaluate_transitions(requests: DataFrame, facts: DataFrame, strict: bool = False) -> DataFrame:
    """Judge requests (project_id, id, action, actor, reason) by the tasks' facts: new_status, owner, warning, denial.

    owner is the actor, clear or keep. Exactly one of new_status and denial is null. Tasks that are not known are
    denied as RESOURCE_NOT_FOUND.
    """
    return _judge(requests.join(facts, ["project_id", "id"], "left"), requests.columns, strict)


def _judge(rows: DataFrame, columns: Sequence[str], strict: bool) -> DataFrame:
    status = owner = denial = None
    for condition, says, what in _rules(strict):
        says = F.lit(says) if isinstance(says, str) else says
        hit = F.coalesce(condition, F.lit(False))
        if status is None:
            status, owner, denial = F, F, F
        status = status.when(hit, F.lit(None) if what == "deny" else says)
        owner = owner.when(hit, F.lit(None) if what == "deny" else F.lit(what))
        denial = denial.when(hit, says if what == "deny" else F.lit(None))
    unknown = F.col("status").isNull()
    warned = (F.col("action") == "complete") & (F.col("open_progress") > 0)
    return rows.select(
        *columns, F.col("status").alias("old_status"), F.when(~unknown, status).alias("new_status"), F.when(~unknown, owner).alias("owner"),
        F.when(unknown, "RESOURCE_NOT_FOUND").otherwise(denial.otherwise(DENIED)).alias("denial"), F.when(~unknown & status.isNotNull() & warned, "open progress items remain").alias("warning"),
    )


def _state_of(status: Column, owned: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ENUMS["task_status"]]), status).cast("int") * 2 - 2 + owned.cast("int")


def _state_maps(spark: SparkSession, strict: bool) -> DataFrame:
    """For each action and case of the facts that stay, the state that follows each of STATES: nine times sixteen rows."""
    every = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    cases = spark.range(1).select(every(ACTION_EVENTS).alias("action"))
    for flag in ("_reasoned", "has_incomplete_prerequisite", "has_active_session", "_pending"):
        cases = cases.withColumn(flag, every([False, True]))
    cases = cases.withColumn("_state", every(range(len(STATES))))
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_state"))
    cases = cases.withColumns({"status": at([s for s, _ in STATES]), "has_owner": at([o for _, o in STATES])})
    cases = cases.withColumns({"reason": F.when(F.col("_reasoned"), "reason"), "open_progress": F.col("_pending").cast("long")})
    keep = ["action", "_reasoned", "has_incomplete_prerequisite", "has_active_session", "_pending", "_state", "has_owner"]
    judged = _judge(cases, keep, strict)
    owned = F.when(F.col("owner") == "actor", True).when(F.col("owner") == "clear", False).otherwise(F.col("has_owner"))
    after = F.when(F.col("new_status").isNull(), F.col("_state")).otherwise(_state_of(F.col("new_status"), owned))
    lists = judged.groupBy(*keep[:5]).agg(F.sort_array(F.collect_list(F.struct("_state", after.alias("to")))).alias("_all"))
    return lists.select(*keep[:5], F.col("_all.to").alias("_map"))


def evaluate_in_order(requests: DataFrame, facts: DataFrame, strict: bool = False) -> DataFrame:
    """Judge requests (project_id, id, action, actor, reason, at, request) of which a task may have many, in order of at and request.

    Each finds the status and the owner that those before it have left; the other facts stay as they are. The rules and
    columns are those of evaluate_transitions, old_status being the status just before. Denied requests and unknown
    actions change nothing. A request without a time comes first; request has to tell a task's requests apart.

    The requests of a task are folded as one list where it has at most 2 ** BITS of them, so they move once, to their
    task's facts; those of other tasks get numbers over all ranges and are folded by lists of lists.
    """
    keys = ["project_id", "id"]
    many = stored(requests.groupBy(*keys).count().filter(F.col("count") > 1 << folds.BITS).select(*keys), "tasks-with-many-requests")
    if many.isEmpty():
        return _evaluate_lists(requests, facts, strict)
    own = reduce(lambda a, b: a & b, [requests[k].eqNullSafe(many[k]) for k in keys])
    return _evaluate_lists(requests.join(many, own, "left_anti"), facts, strict).unionByName(_evaluate_numbered(requests.join(many, own, "left_semi"), facts, strict))


def _cases(requests: DataFrame, facts: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Requests with their task's facts, the maps of all cases, and the map that changes nothing."""
    keys = ["project_id", "id"]
    reasoned = F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0
    known = facts.select(*keys, "status", "has_owner", "open_progress", "has_active_session", "has_incomplete_prerequisite")
    rows = requests.join(known, keys, "left").withColumns({"_reasoned": reasoned, "_pending": F.col("open_progress") > 0})
    return rows, F.broadcast(_state_maps(requests.sparkSession, strict)), F.array(*[F.lit(s) for s in range(len(STATES))])


CASE = ["action", "_reasoned", "has_incomplete_prerequisite", "has_active_session", "_pending"]


def _evaluate_lists(requests: DataFrame, facts: DataFrame, strict: bool) -> DataFrame:
    keys, own = ["project_id", "id"], ["open_progress", "has_active_session", "has_incomplete_prerequisite"]
    rows, maps, same = _cases(requests, facts, strict)
    item = F.struct(*TURN, *[c for c in requests.columns if c not in (*keys, *TURN)], F.coalesce("_map", same).alias("_map"))
    begin = _state_of(F.col("status"), F.col("has_owner"))
    lists = rows.join(maps, CASE, "left").groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_list"), F.first(begin).alias("_begin"), *[F.first(c).alias(c) for c in own])
    held = F.struct(F.col("_begin").alias("now"), F.array().cast("array<int>").alias("seen"))
    step = lambda held, item: F.struct(F.get(item["_map"], held["now"]).alias("now"), F.concat(held["seen"], F.array(held["now"])).alias("seen"))
    before = lists.withColumn("_seen", F.aggregate("_list", held, step, lambda held: held["seen"]))
    met = before.select(*keys, *own, "_seen", F.posexplode("_list").alias("_n", "_item")).select(*[F.col(k).alias(k) for k in keys], *own, "_item.*", F.get("_seen", F.col("_n")).alias("_state"))
    return _judge(_as_found(met), requests.columns, strict)


def _evaluate_numbered(requests: DataFrame, facts: DataFrame, strict: bool) -> DataFrame:
    keys = ["project_id", "id"]
    rows, maps, same = _cases(requests, facts, strict)
    rows = positioned(rows, keys, TURN)
    items = rows.filter("status IS NOT NULL").join(maps, CASE, "left").select(*keys, "_pos", F.coalesce("_map", same).alias("_map"))
    start = facts.select(*keys, _state_of(F.col("status"), F.col("has_owner")).alias("_state"))
    before = states_before(items, keys, start, len(STATES))
    return _judge(_as_found(rows.join(before, [*keys, "_pos"], "left")), requests.columns, strict)


def _as_found(met: DataFrame) -> DataFrame:
    """Rows with the status and the owner's presence that their _state stands for."""
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_state"))
    return met.withColumns({"status": at([s for s, _ in STATES]), "has_owner": at([o for _, o in STATES])})


def initial_status(new: DataFrame, deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """new (project_id, id, requested) with status or denial.

    Planned if asked for or if any prerequisite is not completed, else ready; an explicit ready with such a
    prerequisite is refused.
    """
    done = tasks.select("project_id", F.col("id").alias("prerequisite_task_id"), (F.col("status") == "completed").alias("_done"))
    open_deps = deps.join(done, ["project_id", "prerequisite_task_id"], "left").groupBy("project_id", F.col("task_id").alias("id")).agg(F.bool_or(~F.coalesce("_done", F.lit(False))).alias("_open"))
    rows = new.join(open_deps, ["project_id", "id"], "left")
    held = F.coalesce("_open", F.lit(False))
    refused = held & (F.coalesce("requested", F.lit("")) == "ready")
    status = F.when(refused, None).when(held | (F.col("requested") == "planned"), "planned").otherwise("ready")
    return rows.select(*new.columns, status.alias("status"), F.when(refused, "DEPENDENCY_INCOMPLETE").alias("denial"))


def _judged(requests: DataFrame, rows: DataFrame, state: str, moves: dict[str, list[str]]) -> DataFrame:
    allowed = F.lit(False)
    for start, ends in moves.items():
        allowed = allowed | ((F.col(state) == start) & F.col("target").isin(*ends))
    verdict = F.when(F.col(state).isNull(), "not_found").when(allowed, "allowed").otherwise("denied")
    return requests.join(rows.select("project_id", "id", state), ["project_id", "id"], "left").select(*requests.columns, F.col(state).alias("current"), verdict.alias("verdict"))


def evaluate_session_moves(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Judge requests (project_id, id, target) by the ten allowed pairs of session states."""
    return _judged(requests, sessions, "state", SESSION_MOVES)


def evaluate_progress_moves(requests: DataFrame, items: DataFrame) -> DataFrame:
    return _judged(requests, items, "status", PROGRESS_MOVES)


def _turn(verdicts: DataFrame) -> Column:
    """What orders several verdicts for one row: their turn where they have one, else their own values."""
    return F.struct(*[c for c in TURN if c in verdicts.columns] or sorted(set(verdicts.columns) - {"project_id", "id"}))


def _with_new(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join _new, the status that the last of a row's verdicts leads to."""
    side = verdicts.filter("new_status IS NOT NULL").groupBy("project_id", "id").agg(F.max_by("new_status", _turn(verdicts)).alias("_new"))
    return df.join(side, ["project_id", "id"], "left")


def apply_task_status(tasks: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Tasks after the verdicts, in their order (at, request) where a task has several.

    The first start stays, completed_at is there for completed ones alone, and the owner is that of the last verdict that
    sets or clears it. Verdicts that are not from evaluate_in_order may be one for each task only.
    """
    turn = _turn(verdicts)
    owning = F.col("owner").isin("actor", "clear")
    side = verdicts.filter("new_status IS NOT NULL").groupBy("project_id", "id").agg(
        F.max_by("new_status", turn).alias("_new"), F.bool_or(F.col("new_status") == "in_progress").alias("_begun"), F.bool_or(owning).alias("_owning"),
        F.max_by(F.when(F.col("owner") == "actor", F.struct("actor")), F.when(owning, turn)).alias("_owner"), F.count(F.lit(1)).alias("_verdicts"),
    )
    if not set(TURN) <= set(verdicts.columns):
        several = F.raise_error(F.concat(F.lit("several verdicts without an order for task "), "id"))
        side = side.withColumn("_new", F.when(F.col("_verdicts") > 1, several).otherwise(F.col("_new")))
    rows = tasks.join(side, ["project_id", "id"], "left")
    moved, new = F.col("_new").isNotNull(), F.col("_new")
    return rows.withColumns(
        {
            "status": F.coalesce(new, "status"),
            "started_at": F.when(F.col("_begun"), F.coalesce("started_at", now)).otherwise(F.col("started_at")),
            "completed_at": F.when(moved, F.when(new == "completed", now)).otherwise(F.col("completed_at")),
            "owner_agent_id": F.when(F.col("_owning"), F.col("_owner.actor")).otherwise(F.col("owner_agent_id")),
            "updated_at": F.when(moved, now).otherwise(F.col("updated_at")),
        }
    ).select(*tasks.columns)


def apply_session_state(sessions: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Sessions after the verdicts (new_status): ended_at is there for ended, abandoned and stale ones alone."""
    rows = _with_new(sessions, verdicts)
    over = F.col("_new").isin("ended", "abandoned", "stale")
    return rows.withColumns({"state": F.coalesce("_new", "state"), "ended_at": F.when(F.col("_new").isNotNull(), F.when(over, now)).otherwise(F.col("ended_at"))}).select(*sessions.columns)


def apply_progress_status(items: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    rows = _with_new(items, verdicts)
    moved = F.col("_new").isNotNull()
    at = lambda status, old: F.when(moved, F.when(F.col("_new") == status, now)).otherwise(F.col(old))
    return rows.withColumns({"status": F.coalesce("_new", "status"), "completed_at": at("completed", "completed_at"), "removed_at": at("removed", "removed_at")}).select(*items.columns)


def mark_stale(sessions: DataFrame, now: Column, after_ms: int = 7_200_000) -> DataFrame:
    """Active sessions without activity for longer than after_ms become stale and end now."""
    late = (F.col("state") == "active") & (F.col("last_activity_at") < now - F.make_dt_interval(secs=F.lit(after_ms / 1000)))
    return sessions.withColumns({"ended_at": F.when(late, now).otherwise(F.col("ended_at")), "state": F.when(late, "stale").otherwise(F.col("state"))})


def supersede_sessions(sessions: DataFrame) -> DataFrame:
    """Add superseded_by: the agent's next session in the same worktree ends an active one at its own start."""
    following = Window.partitionBy("project_id", "agent_id", "worktree_id").orderBy("started_at", "id")
    rows = sessions.withColumns({"superseded_by": F.lead("id").over(following), "_at": F.lead("started_at").over(following)})
    ends = (F.col("state") == "active") & F.col("superseded_by").isNotNull()
    return rows.select(
        *[F.when(ends, "ended").otherwise(F.col("state")).alias("state") if c == "state" else F.when(ends, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "ended_at" else F.col(c) for c in sessions.columns],
        F.when(ends, F.col("superseded_by")).alias("superseded_by"),
    )


def emit_events(verdicts: DataFrame, now: Column) -> DataFrame:
    """An event for each applied change: its type, the task, and before, after and reason as JSON.

    The identifier is a hash of the request: task, action, actor, reason and, where there are such, its turn.
    """
    asked = ["project_id", "id", "action", "actor", "reason", *[c for c in TURN if c in verdicts.columns]]
    name = F.sha2(F.to_json(F.struct(*asked)).cast("binary"), 256)
    payload = F.to_json(F.struct(F.col("old_status").alias("beforeStatus"), F.col("new_status").alias("afterStatus"), "reason"))
    return verdicts.filter("new_status IS NOT NULL").select(
        F.concat_ws("-", F.date_format(now, "yyyyMMddHHmmss"), F.left(name, F.lit(32))).alias("id"), "project_id", lookup(F.col("action"), ACTION_EVENTS).alias("type"), F.lit("task").alias("aggregate_type"),
        F.col("id").alias("aggregate_id"), payload.alias("payload_json"), now.alias("occurred_at"), F.col("actor").alias("actor_agent_id"), F.lit(None).cast("string").alias("session_id"), F.col("id").alias("task_id"),
    )


def replay_status(events: DataFrame) -> DataFrame:
    """project_id, task_id, status, owner of each task as its events tell.

    A created event carries the status, claimed means in progress under the actor, others carry afterStatus; released,
    cancelled and reopened clear the owner.
    """
    rows = normalise_event_types(events).filter("task_id IS NOT NULL AND type LIKE 'task.%'")
    after = F.coalesce(F.get_json_object("payload_json", "$.afterStatus"), F.when(F.col("type") == "task.claimed", "in_progress").when(F.col("type") == "task.created", F.get_json_object("payload_json", "$.status")))
    owner = F.when(F.col("type") == "task.claimed", F.struct(F.col("actor_agent_id").alias("o"))).when(F.col("type").isin("task.released", "task.cancelled", "task.reopened"), F.struct(F.lit(None).cast("string").alias("o")))
    order = F.struct("occurred_at", "id")
    rows = rows.withColumns({"_after": after, "_owner": owner})
    last = rows.groupBy("project_id", "task_id").agg(F.max_by("_after", F.when(F.col("_after").isNotNull(), order)).alias("status"), F.max_by("_owner", F.when(F.col("_owner").isNotNull(), order)).alias("_o"))
    return last.select("project_id", "task_id", "status", F.col("_o.o").alias("owner"))


def log_drift(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, task_id, log_status, stored_status where log and table disagree or one lacks the task."""
    log = replay_status(events).select("project_id", "task_id", F.col("status").alias("log_status"))
    stored = tasks.select("project_id", F.col("id").alias("task_id"), F.col("status").alias("stored_status"))
    return log.join(stored, ["project_id", "task_id"], "full_outer").filter(~F.col("log_status").eqNullSafe(F.col("stored_status")))


def merge_upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str = "updated_at") -> DataFrame:
    """Base rows with the columns replaced by the newest update of their key; updates of new keys are added whole."""
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in base.columns if c not in keys]), F.struct(order, *[F.col(c) for c in base.columns if c not in keys])).alias("_u"))
    rows = base.withColumn("_base", F.lit(True)).join(newest, list(keys), "full_outer")
    pick = lambda c: F.col(c) if c in keys else F.when(F.col("_base") & (F.col("_u").isNull() | F.lit(c not in cols)), F.col(c)).otherwise(F.col(f"_u.{c}")).alias(c)
    return rows.select(*[pick(c) for c in base.columns])


def supersede_decisions(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decisions with superseded_by set by pairs (project_id, old_ref, new_ref) of display ids or ids."""
    dim = decisions.select("project_id", "id", "display_id")
    both = resolve_refs(resolve_refs(pairs, "old_ref", dim, ["display_id", "id"], out="_old"), "new_ref", dim, ["display_id", "id"], out="_new")
    shown = decisions.select("project_id", F.col("id").alias("_new"), F.col("display_id").alias("_shown"))
    side = both.filter("_old <> _new").join(shown, ["project_id", "_new"]).groupBy("project_id", F.col("_old").alias("id")).agg(F.max("_shown").alias("_by"))
    return decisions.join(side, ["project_id", "id"], "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*decisions.columns)


def apply_handoff_moves(requests: DataFrame, handoffs: DataFrame, facts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(handoffs, outcomes) after requests (project_id, id, target, actor, claim, and at and request to order them).

    Accepting with claim takes the task for the actor by the task rules, as those before it have left the task; where that
    is denied the hand-off stays as it is and the outcome has the denial. Of several moves of one hand-off the last that is
    not denied counts. Without at and request, requests are ordered by actor and target.
    """
    turn = [c for c in TURN if c in requests.columns]
    tasks_of = handoffs.select("project_id", F.col("id").alias("_handoff"), F.col("task_id"))
    asked = requests.withColumnRenamed("id", "_handoff")
    if len(turn) < len(TURN):
        asked = asked.withColumns({"at": F.lit(None).cast("timestamp_ntz"), "request": F.concat_ws("|", "actor", "target", F.col("claim").cast("string"))})
    asked = asked.join(tasks_of, ["project_id", "_handoff"], "left")
    claims = asked.filter("claim AND target = 'accepted'").select(
        "project_id", F.col("task_id").alias("id"), F.lit("claim").alias("action"), "actor", F.lit(None).cast("string").alias("reason"), "at", F.struct("request", "_handoff").alias("request")
    )
    judged = evaluate_in_order(claims, facts).select("project_id", "at", F.col("request.request").alias("request"), F.col("request._handoff").alias("_handoff"), "denial")
    same = asked["project_id"].eqNullSafe(judged["project_id"]) & asked["_handoff"].eqNullSafe(judged["_handoff"]) & asked["request"].eqNullSafe(judged["request"]) & asked["at"].eqNullSafe(judged["at"]) & asked["claim"] & (asked["target"] == "accepted")
    met = asked.join(judged.dropDuplicates(["project_id", "_handoff", "request", "at"]), same, "left")
    denial = F.when(asked["task_id"].isNull(), "RESOURCE_NOT_FOUND").otherwise(judged["denial"])
    outcomes = met.select(asked["project_id"], asked["_handoff"].alias("id"), "target", "actor", asked["at"], asked["request"], denial.alias("denial"))
    side = outcomes.filter("denial IS NULL").groupBy("project_id", "id").agg(F.max_by("target", F.struct(*TURN)).alias("_new"))
    at = lambda state, old: F.when(F.col("_new") == state, now).otherwise(F.col(old))
    moved = handoffs.join(side, ["project_id", "id"], "left").withColumns(
        {"state": F.coalesce("_new", "state"), "accepted_at": at("accepted", "accepted_at"), "declined_at": at("declined", "declined_at"), "updated_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))}
    )
    return moved.select(*handoffs.columns), outcomes.select("project_id", "id", "target", "actor", *turn, "denial")


def known_event_types() -> list[str]:
    return sorted({*ACTION_EVENTS.values(), *LEGACY_EVENTS.values(), "task.created"})
