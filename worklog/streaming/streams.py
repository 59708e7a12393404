"""Structured Streaming jobs on the event log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from worklog.functions.expr import lookup
from worklog.operators.transitions import DENIED, evaluate_transitions, merge_upsert
from worklog.schema import ACTION_EVENTS, LEGACY_EVENTS, SCHEMAS, SESSION_MOVES
from worklog.sources.shared import scratch, stored


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The event log as a stream of new Parquet files."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _timed(stream: DataFrame, watermark: str, column: str = "occurred_at") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark)


def ingest_events(stream: DataFrame, path: str, checkpoint: str, rejects: str | None = None, watermark: str = "1 hour") -> list[StreamingQuery]:
    """Valid events with canonical names to a table, each id once within the watermark; others to rejects, from the same read.

    There is no way to change or delete an event. Each batch is a partition batch_id of its own that a repeated batch
    writes anew, so it adds nothing. Returns the query in a list; it stops when the files at hand are done, and
    ingest_report tells what became of all rows. Rejects need no time and are never late or doubled.
    """
    named = stream.withColumn("type", lookup(F.col("type"), LEGACY_EVENTS))
    ok = F.col("id").isNotNull() & F.col("project_id").isNotNull() & F.col("occurred_at").isNotNull() & (F.length(F.trim(F.coalesce("type", F.lit("")))) > 0)
    json_ok = F.col("payload_json").isNull() | F.expr("try_parse_json(payload_json)").isNotNull()
    judged = named.withColumn("_ok", F.coalesce(ok & json_ok, F.lit(False))).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    judged = judged.observe("ingest", F.count(F.lit(1)).alias("source"), F.count_if(~F.col("_ok")).alias("rejected"))
    keyed = judged.withColumns({"_time": F.when(F.col("_ok"), F.col("occurred_at")), "_key": F.when(F.col("_ok"), F.to_json(F.struct("project_id", "id"))).otherwise(F.uuid())})
    once = keyed.withWatermark("_time", watermark).dropDuplicatesWithinWatermark(["_key"])

    def write(batch: DataFrame, number: int) -> None:
        held = batch.drop("_time", "_key").persist()
        held.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        if rejects:
            held.filter("NOT _ok").drop("_ok").write.mode("overwrite").parquet(f"{rejects}/batch_id={number}")
        held.unpersist()

    return [once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()]


def ingest_report(query: StreamingQuery) -> dict[str, int]:
    """How many rows of an ingest came from the source, were rejected, doubled, late (behind the watermark), or are good."""
    total = dict.fromkeys(("source", "rejected", "duplicate", "late"), 0)
    for progress in query.recentProgress:
        seen = progress["observedMetrics"].get("ingest")
        total["source"] += seen["source"] if seen else 0
        total["rejected"] += seen["rejected"] if seen else 0
        for state in progress["stateOperators"]:
            total["duplicate"] += state["customMetrics"].get("numDroppedDuplicateRows", 0)
            total["late"] += state["numRowsDroppedByWatermark"]
    return total | {"good": total["source"] - total["rejected"] - total["duplicate"] - total["late"]}


def running_event_counts(stream: DataFrame, bucket: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """project_id, type, start, events by time bucket; for update or append mode."""
    rows = _timed(stream, watermark).groupBy(F.window("occurred_at", bucket), "project_id", "type").agg(F.count(F.lit(1)).alias("events"))
    return rows.select("project_id", "type", F.col("window.start").alias("start"), "events")


def upsert_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of running_event_counts up to date, partitioned by day: after each batch it has all that was counted so far.

    A batch brings the buckets that changed, with their whole counts. Days that it touches are read, merged and written
    anew, so repeating a batch changes nothing. Returns the query; it stops when the files at hand are done.
    """
    spark = counts.sparkSession
    keys = ["project_id", "type", "start"]
    dated = counts.withColumn("day", F.to_date("start"))
    spark.createDataFrame([], dated.schema).write.mode("append").partitionBy("day").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        with scratch(session):
            changed = stored(batch, "changed-counts")
            days = [r["day"] for r in changed.select("day").distinct().collect()]  # as many as a batch has
            base = session.read.schema(dated.schema).parquet(path).filter(F.col("day").isin(days))
            merged = stored(merge_upsert(base.select(*dated.columns), changed, keys, ["events"], "events"), "merged-counts")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return dated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def detect_stale(stream: DataFrame, after: str = "2 hours", watermark: str = "0 seconds") -> DataFrame:
    """project_id, session_id, started_at, last_activity_at, stale_at, agent_id, task_id: a row for each spell without activity after it.

    Activity extends a session; the row comes when the watermark has passed the last activity by the given time. Agent and
    task are those of the last event that has one.
    """
    spell = F.session_window("occurred_at", after)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("occurred_at")))
    rows = _timed(stream.filter("session_id IS NOT NULL"), watermark).groupBy(spell, "project_id", "session_id").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_activity_at"), last("actor_agent_id").alias("agent_id"), last("task_id").alias("task_id")
    )
    return rows.select("project_id", "session_id", "started_at", "last_activity_at", F.col("session_window.end").alias("stale_at"), "agent_id", "task_id")


# The state that a session's event leads to; started begins a session.
SESSION_EVENTS = {"session.paused": "paused", "session.resumed": "active", "session.ended": "ended", "session.abandoned": "abandoned", "session.stale": "stale"}
#: What a task's fate depends on besides its status, in the order of a case's name.
FLAGS = ["has_owner", "reasoned", "has_incomplete_prerequisite", "has_active_session", "pending"]
STATUSES = ["planned", "ready", "in_progress", "blocked", "review", "completed", "cancelled"]
GUARD_OUTPUT = "string, id string, type string, before string, after string, verdict string"

Judge = Callable[[list, dict], tuple[str | None, str | None, str]]


def task_rules(spark: SparkSession, strict: bool = False) -> dict[str, tuple[str | None, str | None, str | None]]:
    """What evaluate_transitions says in every case: action, status and flags -> new status, owner, denial.

    Nine actions in seven states under five flags are 2,016 cases, whatever the data, so they are collected.
    """
    every = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    cases = spark.range(1).withColumn("project_id", F.lit("")).withColumn("action", every(ACTION_EVENTS)).withColumn("status", every(STATUSES))
    for flag in FLAGS:
        cases = cases.withColumn(flag, every([False, True]))
    cases = cases.withColumn("id", F.concat_ws("|", "action", "status", *[F.col(f).cast("int").cast("string") for f in FLAGS]))
    asked = cases.select("project_id", "id", "action", F.lit("").alias("actor"), F.when(F.col("reasoned"), "reason").alias("reason"))
    facts = cases.select("project_id", "id", "status", "has_owner", F.col("pending").cast("long").alias("open_progress"), "has_active_session", "has_incomplete_prerequisite")
    return {r.id: (r.new_status, r.owner, r.denial) for r in evaluate_transitions(asked, facts, strict).collect()}


def _judge_task(rules: dict, initial: str) -> Judge:
    actions = {event: action for action, event in ACTION_EVENTS.items()}

    def judge(event: list, memory: dict) -> tuple[str | None, str | None, str]:
        kind, flags = event[0], event[1:]
        before = memory.get("status")
        if kind == "task.created":
            memory.setdefault("status", initial)
            return before, memory["status"], "allowed" if before is None else DENIED
        before = before or initial
        case = "|".join([actions[kind], before, *[str(int(f)) for f in (memory.get("owned", False), *flags)]])
        after, owner, denial = rules[case]
        if owner in ("actor", "clear"):
            memory["owned"] = owner == "actor"
        memory["status"] = after or before
        return before, memory["status"], denial or "allowed"

    return judge


def _judge_session(event: list, memory: dict) -> tuple[str | None, str | None, str]:
    before = memory.get("status")
    if event[0] == "session.started":
        memory.setdefault("status", "active")
        return before, memory["status"], "allowed" if before is None else "denied"
    before = before or "active"
    target = SESSION_EVENTS[event[0]]
    allowed = target in SESSION_MOVES.get(before, [])
    memory["status"] = target if allowed else before
    return before, memory["status"], "allowed" if allowed else "denied"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start streams with guards within: their state needs the RocksDB store."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Guard(StatefulProcessor):
    """Waiting events of a key as a list, what is known of the key as a value, and timers of event time.

    An event waits until the watermark has reached it; events that come behind the watermark are dropped by Spark as late.
    New events are only added to the list. It is read when a timer says that its first event is due, and what is not due
    goes back. Each element of the list has many events as one text, because every element and every call on the state is
    a message between Python and the store. With keep_ms an event that comes so long after the last one finds nothing
    known, and the value goes when the watermark has passed the last event by so much.
    """

    #: Events of one element.
    PACK = 4096

    def __init__(self, key: str, details: Sequence[str], judge: Judge, keep_ms: int | None):
        self.key, self.details, self.judge, self.keep_ms = key, list(details), judge, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.known = handle.getValueState("known", "status string, owned boolean, last long")

    def _packed(self, events: list) -> list[tuple[str]]:
        return [(json.dumps(events[n : n + self.PACK]),) for n in range(0, len(events), self.PACK)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for part in rows:
            micros = part["micros"].tolist()
            self.waiting.appendList(self._packed(list(zip(micros, *[part[c].tolist() for c in ("id", "type", *self.details)], strict=True))))
            first = min(micros) if first is None else min(first, *micros)
        self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        reached = timerValues.getCurrentWatermarkInMs()
        held = sorted((e for (pack,) in self.waiting.get() for e in json.loads(pack)), key=lambda e: (e[0], e[1]))
        due, later = [e for e in held if e[0] <= reached * 1000], [e for e in held if e[0] > reached * 1000]
        known = self.known.get()
        memory = {} if known is None else {k: v for k, v in (("status", known[0]), ("owned", known[1])) if v is not None}
        out, last = [], known[2] if known is not None else None
        for event in due:
            if self.keep_ms is not None and last is not None and event[0] - last > self.keep_ms * 1000:
                memory.clear()
            out.append((*key, event[1], event[2], *self.judge(event[2:], memory)))
            last = event[0]
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if due:
            if later:
                self.waiting.put(self._packed(later))
            else:
                self.waiting.clear()
            self.known.update((memory.get("status"), memory.get("owned"), last))
            if self.keep_ms is not None:
                self.handle.registerTimer(max(-(-last // 1000) + self.keep_ms, reached) + 1)
            yield pd.DataFrame(out, columns=["project_id", self.key, "id", "type", "before", "after", "verdict"])
        elif last is not None and self.keep_ms is not None and last < (reached - self.keep_ms) * 1000:
            self.known.clear()

    def close(self) -> None:
        pass


def _guarded(events: DataFrame, key: str, details: Sequence[str], judge: Judge, keep_ms: int | None) -> DataFrame:
    """Verdicts in order of event time and id, whatever batches the events come in. See _Guard.

    A key's list has the events within the watermark's delay and one batch, so maxFilesPerTrigger bounds it.
    """
    timed = events.withColumn("micros", F.unix_micros("occurred_at"))
    return timed.groupBy("project_id", key).transformWithStateInPandas(_Guard(key, details, judge, keep_ms), f"project_id string, {key} {GUARD_OUTPUT}", "append", "EventTime")


def guard_transitions(stream: DataFrame, watermark: str = "0 seconds", initial: str = "ready", facts: DataFrame | None = None, strict: bool = False, keep_ms: int | None = None) -> DataFrame:
    """A verdict for each task action by the rules of evaluate_transitions: allowed, or the code of the denial.

    Status and owner are those that the task's events so far have led to; a task that was not created is in its initial
    status. Prerequisites, active sessions and open progress come from facts (as of task_facts) and count as none without
    them; a cancel's or block's reason comes from the payload. A task can be created once. Other events are no actions
    and have no verdict. With keep_ms a task that has been silent for so long is forgotten and is in its initial status
    again. The stream has to be started within keyed_state.
    """
    spark = stream.sparkSession
    actions = stream.filter("task_id IS NOT NULL").withColumn("type", lookup(F.col("type"), LEGACY_EVENTS)).filter(F.col("type").isin("task.created", *ACTION_EVENTS.values()))
    reason = F.coalesce(F.try_variant_get(F.try_parse_json("payload_json"), "$.reason", "string"), F.lit(""))
    actions = _timed(actions, watermark).withColumn("reasoned", F.length(F.trim(reason)) > 0)
    if facts is None:
        actions = actions.withColumns({f: F.lit(False) for f in FLAGS[2:]})
    else:
        known = facts.select("project_id", F.col("id").alias("task_id"), "has_incomplete_prerequisite", "has_active_session", (F.col("open_progress") > 0).alias("pending"))
        actions = actions.join(known, ["project_id", "task_id"], "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS[2:]})
    return _guarded(actions.select("project_id", "task_id", "id", "type", "occurred_at", *FLAGS[1:]), "task_id", FLAGS[1:], _judge_task(task_rules(spark, strict), initial), keep_ms)


def guard_sessions(stream: DataFrame, watermark: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """A verdict for each session event by the allowed pairs of session states: allowed or denied.

    A session can be started once; one that was not is taken to be active. keep_ms and the state are those of
    guard_transitions.
    """
    moves = stream.filter("session_id IS NOT NULL").filter(F.col("type").isin("session.started", *SESSION_EVENTS))
    return _guarded(_timed(moves, watermark).select("project_id", "session_id", "id", "type", "occurred_at"), "session_id", [], _judge_session, keep_ms)
