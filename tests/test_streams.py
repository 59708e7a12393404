from datetime import datetime, timedelta

import pytest

from worklog.schema import SCHEMAS
from worklog.streaming import streams

START = datetime(2024, 1, 1)


def event(n, kind="task.started", minutes=0, task="t", session="s", project="p", payload="{}"):
    return (f"e{n:03d}", project, kind, "task", task, payload, START + timedelta(minutes=minutes), "a", session, task)


@pytest.fixture
def log(spark, tmp_path):
    def write(*batches):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
            for f in (tmp_path / f"part{n}").glob("*.parquet"):
                (tmp_path / "log").mkdir(exist_ok=True)
                f.rename(tmp_path / "log" / f"{n:03d}.parquet")
        return str(tmp_path / "log")

    return write


def run(df, name, mode, spark):
    with streams.keyed_state(spark):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_ingest(spark, log, tmp_path):
    path = log([event(1), event(1), event(2, "task.canceled"), event(3, payload="{bad"), event(4, kind=" ")], [event(1), event(5, minutes=1)])
    for q in streams.ingest_events(streams.read_events(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad")):
        q.awaitTermination(120)
    good = {(r.id, r.type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert good == {("e001", "task.started"), ("e002", "task.cancelled"), ("e005", "task.started")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert {r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"e003", "e004"}


def test_ingest_accounts_for_every_row(spark, log, tmp_path):
    """Good, rejected, doubled and late rows are all rows; a batch that is written again adds nothing."""
    first = [event(n, minutes=100 + n) for n in range(5)] + [event(2, minutes=102), event(7, payload="{bad"), (None, *event(8)[1:])]
    path = log(first, [event(50, minutes=1), event(1, minutes=101), event(9, minutes=300)], [event(51, minutes=2), event(10, minutes=301)])
    out, state, bad = (str(tmp_path / x) for x in ("out", "cp", "bad"))
    (q,) = streams.ingest_events(streams.read_events(spark, path, 1), out, state, bad, "1 hour")
    q.awaitTermination(120)
    report = streams.ingest_report(q)
    assert report == {"source": 13, "rejected": 2, "duplicate": 2, "late": 2, "good": 7} or report == {"source": 13, "rejected": 2, "duplicate": 2, "late": 1, "good": 8}
    count = lambda p: spark.read.parquet(p).count()
    assert (count(out), count(bad)) == (report["good"], report["rejected"])
    for n in (tmp_path / "cp" / "commits").glob("[0-9]*"):
        n.unlink()  # as if the query had been killed before its batches were marked as done
    for f in (tmp_path / "cp" / "commits").glob(".*"):
        f.unlink()
    (q,) = streams.ingest_events(streams.read_events(spark, path, 1), out, state, bad, "1 hour")
    q.awaitTermination(120)
    assert (count(out), count(bad)) == (report["good"], report["rejected"])


def test_live_counts_at_every_trigger(spark, log, tmp_path):
    rows = [event(n, minutes=37 * n, kind=["task.started", "task.blocked"][n % 2]) for n in range(80)]
    parts = [rows[:30], rows[10:20] + rows[30:60], rows[60:]]
    out, state, given, want = str(tmp_path / "out"), str(tmp_path / "cp"), [], {}
    for part in parts:
        spark.createDataFrame(part, SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "live"))
        path = str(tmp_path / "live")
        streams.upsert_counts(streams.running_event_counts(streams.read_events(spark, path), watermark="10 days"), out, state).awaitTermination(120)
        given += part
        want = {}
        for r in given:
            key = (r[2], r[6].replace(minute=0))
            want[key] = want.get(key, 0) + 1
        assert {(r.type, r.start): r.events for r in spark.read.parquet(out).collect()} == want


def test_counts_are_those_of_a_batch(spark, log):
    rows = [event(n, minutes=7 * n, kind=["task.started", "task.blocked"][n % 2]) for n in range(40)]
    path = log(rows[:20], rows[20:])
    got = run(streams.running_event_counts(streams.read_events(spark, path, 1)), "counts", "complete", spark)
    want = {}
    for r in rows:
        key = (r[2], r[6].replace(minute=0))
        want[key] = want.get(key, 0) + 1
    assert {(r.type, r.start): r.events for r in got} == want


def test_stale_sessions(spark, log):
    path = log([event(1, minutes=0), event(2, minutes=60), event(3, minutes=0, session="r")], [event(4, minutes=600, session="q")], [event(5, minutes=601, session="q")])
    got = run(streams.detect_stale(streams.read_events(spark, path, 1)), "stale", "append", spark)
    assert {(r.agent_id, r.task_id) for r in got} == {("a", "t")}
    assert {(r.session_id, r.last_activity_at, r.stale_at) for r in got} == {("s", START + timedelta(minutes=60), START + timedelta(minutes=180)), ("r", START, START + timedelta(minutes=120))}


def test_guard_is_the_rule_in_order(spark, log):
    kinds = ["task.created", "task.claimed", "task.claimed", "task.reviewed", "task.completeed", "task.blocked", "task.reopened"]
    rows = [event(n, k, n, task=t) for t in ("t", "u") for n, k in enumerate(kinds)]
    rows = [(f"{r[0]}{r[9]}", *r[1:]) for r in rows]
    path = log(rows[:4] + rows[7:9], rows[4:7] + rows[9:])
    got = run(streams.guard_transitions(streams.read_events(spark, path, 1)), "guard", "append", spark)
    for task in ("t", "u"):
        own = [r for r in sorted(got, key=lambda r: r.id) if r.task_id == task]
        assert [r.after for r in own] == ["ready", "in_progress", "in_progress", "review", "completed", "completed", "ready"]
        assert [r.verdict == "allowed" for r in own] == [True, True, False, True, True, False, True]


def test_guard_waits_for_the_watermark(spark, log):
    """Events that come a batch late, but within the watermark's delay, are judged in their place."""
    kinds = ["task.created", "task.claimed", "task.reviewed", "task.completed", "task.reopened", "task.claimed"]
    rows = [event(n, k, n) for n, k in enumerate(kinds)]
    end = [event(90, "task.created", 60, task="end")]
    apart = streams.guard_transitions(streams.read_events(spark, log([rows[0], rows[3]], [rows[1], rows[5]], [rows[4], rows[2]], end), 1), "30 minutes")
    got = sorted(run(apart, "apart", "append", spark), key=lambda r: r.id)
    assert [(r.type, r.after, r.verdict) for r in got] == [(k, a, "allowed") for k, a in zip(kinds, ["ready", "in_progress", "review", "completed", "ready", "in_progress"])]


def test_guard_knows_owners_reasons_and_prerequisites(spark, log):
    reason = '{"reason": "why"}'
    rows = [event(0, "task.claimed"), event(1, "task.claimed", 1), event(2, "task.blocked", 2), event(3, "task.blocked", 3, payload=reason), event(4, "note.added", 4), event(5, "task.claimed", 5, task="u"), event(6, "task.unblocked", 6)]
    facts = spark.createDataFrame([("p", "u", True, False, 0)], "project_id string, id string, has_incomplete_prerequisite boolean, has_active_session boolean, open_progress long")
    got = run(streams.guard_transitions(streams.read_events(spark, log(rows)), facts=facts), "facts", "append", spark)
    assert {r.id: r.verdict for r in got} == {"e000": "allowed", "e001": "TASK_ALREADY_CLAIMED", "e002": "VALIDATION_FAILED", "e003": "allowed", "e005": "DEPENDENCY_INCOMPLETE", "e006": "allowed"}


def test_session_guard(spark, log):
    kinds = ["session.started", "session.paused", "session.paused", "session.resumed", "session.ended", "session.resumed", "session.started"]
    path = log([event(n, f"{k}", n) for n, k in enumerate(kinds)][::-1])
    got = sorted(run(streams.guard_sessions(streams.read_events(spark, path)), "sessions", "append", spark), key=lambda r: r.id)
    assert [r.verdict for r in got] == ["allowed", "allowed", "denied", "allowed", "allowed", "denied", "denied"]
    assert [r.after for r in got] == ["active", "paused", "paused", "active", "ended", "ended", "ended"]


def state_rows(spark, path):
    return spark.read.format("statestore").option("stateVarName", "known").load(path).count()


def test_silent_tasks_are_forgotten(spark, log, tmp_path):
    """State of a task goes when it has been silent for long, and the task begins anew."""
    day = 24 * 60
    path = log([event(0, "task.claimed", 0), event(1, "task.claimed", 1, task="u")], [event(2, "task.claimed", 2 * day, task="v")], [event(3, "task.claimed", 4 * day), event(4, "task.started", 4 * day, task="w")], [event(5, "task.started", 5 * day, task="x")])
    for keep, verdict, held in ((day * 60_000, "allowed", 3), (None, "TASK_ALREADY_CLAIMED", 5)):
        guard = streams.guard_transitions(streams.read_events(spark, path, 1), keep_ms=keep)
        with streams.keyed_state(spark):
            q = guard.writeStream.format("memory").queryName(f"kept{bool(keep)}").option("checkpointLocation", str(tmp_path / f"cp{bool(keep)}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert {r.id: r.verdict for r in spark.table(f"kept{bool(keep)}").collect()}["e003"] == verdict
            assert state_rows(spark, str(tmp_path / f"cp{bool(keep)}")) <= held
