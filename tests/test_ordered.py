"""Several requests for one row in a batch, against a loop that takes one after the other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from worklog.operators import folds, transitions
from worklog.schema import ACTION_EVENTS
from worklog.streaming.streams import task_rules

NOW = datetime(2024, 1, 1)
ASKED = "project_id string, id string, action string, actor string, reason string, at timestamp_ntz, request long"
FACTS = "project_id string, id string, status string, has_owner boolean, open_progress long, has_active_session boolean, has_incomplete_prerequisite boolean"
TASKS = "project_id string, id string, status string, owner_agent_id string, started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz"


def random_batch(rnd, tasks, requests, hot):
    facts = [(f"p{n % 2}", f"t{n}", rnd.choice(["planned", "ready", "in_progress", "blocked", "review", "completed", "cancelled"]), rnd.random() < 0.3, rnd.randrange(2), rnd.random() < 0.3, rnd.random() < 0.3) for n in range(tasks)]
    asked = []
    for n in range(requests):
        t = 0 if rnd.random() < hot else rnd.randrange(tasks + 1)
        reason = rnd.choice([None, " ", "because"])
        asked.append((f"p{t % 2}", f"t{t}", rnd.choice([*ACTION_EVENTS, "dance"]), f"a{rnd.randrange(4)}", reason, NOW + timedelta(seconds=rnd.randrange(requests // 2)), n))
    return facts, asked


def one_by_one(rules, facts, asked):
    state, out = {f[:2]: [f[2], f[3], *f[4:]] for f in facts}, []
    for p, t, action, actor, reason, at, request in sorted(asked, key=lambda r: (r[0], r[1], r[5], r[6])):
        if (p, t) not in state:
            out.append((request, None, None, "RESOURCE_NOT_FOUND", None))
            continue
        status, owned, pending, busy, held = state[p, t]
        case = "|".join([action, status, *[str(int(bool(f))) for f in (owned, (reason or "").strip(), held, busy, pending)]])
        new, owner, denial = rules.get(case, (None, None, transitions.DENIED))
        out.append((request, status, new, denial, owner))
        if new:
            state[p, t][:2] = [new, True if owner == "actor" else False if owner == "clear" else owned]
    return sorted(out)


@pytest.mark.parametrize(("seed", "tasks", "requests", "hot", "bits"), [(1, 30, 400, 0.0, 10), (2, 5, 600, 0.6, 3), (3, 3, 90, 0.9, 1)])
def test_order_within_a_batch(spark, monkeypatch, seed, tasks, requests, hot, bits):
    monkeypatch.setattr(folds, "BITS", bits)  # several lists for a task, and lists of lists
    facts, asked = random_batch(random.Random(seed), tasks, requests, hot)
    got = transitions.evaluate_in_order(spark.createDataFrame(asked, ASKED).repartition(5), spark.createDataFrame(facts, FACTS), strict=True).collect()
    assert sorted((r.request, r.old_status, r.new_status, r.denial, r.owner) for r in got) == one_by_one(task_rules(spark, strict=True), facts, asked)


def test_second_claim_finds_the_first(spark):
    facts = spark.createDataFrame([("p", "t", "ready", False, 0, False, False)], FACTS)
    asked = spark.createDataFrame([("p", "t", "claim", "b", None, NOW + timedelta(1), 2), ("p", "t", "claim", "a", None, NOW, 1), ("p", "t", "cancel", "c", "over", NOW + timedelta(2), 3), ("p", "t", "reopen", "d", None, NOW + timedelta(3), 4)], ASKED)
    verdicts = transitions.evaluate_in_order(asked, facts)
    assert [(r.actor, r.new_status, r.denial) for r in verdicts.orderBy("request").collect()] == [("a", "in_progress", None), ("b", None, "TASK_ALREADY_CLAIMED"), ("c", "cancelled", None), ("d", "ready", None)]
    now = F.lit(NOW).cast("timestamp_ntz")
    tasks = spark.createDataFrame([("p", "t", "ready", None, None, None, None), ("p", "u", "ready", "x", None, None, None)], TASKS)
    row = {r.id: r for r in transitions.apply_task_status(tasks, verdicts, now).collect()}
    assert (row["t"].status, row["t"].owner_agent_id, row["t"].started_at, row["t"].completed_at) == ("ready", None, NOW, None)
    assert row["u"].owner_agent_id == "x"
    upto = transitions.apply_task_status(tasks, verdicts.filter("request < 3"), now).filter("id = 't'").first()
    assert (upto.status, upto.owner_agent_id) == ("in_progress", "a")
    events = transitions.emit_events(verdicts, now).collect()
    assert len({e.id for e in events}) == 3


def test_verdicts_without_an_order_are_one_a_task(spark):
    facts = spark.createDataFrame([("p", "t", "ready", False, 0, False, False)], FACTS)
    asked = spark.createDataFrame([("p", "t", a, "a", "r") for a in ("claim", "cancel")], "project_id string, id string, action string, actor string, reason string")
    tasks = spark.createDataFrame([("p", "t", "ready", None, None, None, None)], TASKS)
    with pytest.raises(PySparkException, match="several verdicts"):
        transitions.apply_task_status(tasks, transitions.evaluate_transitions(asked, facts), F.lit(NOW).cast("timestamp_ntz")).collect()


def test_one_of_two_accepts_claims_the_task(spark):
    facts = spark.createDataFrame([("p", "t", "ready", False, 0, False, False)], FACTS)
    handoffs = spark.createDataFrame([("p", h, "t", "pending", None, None, None) for h in ("h1", "h2")], "project_id string, id string, task_id string, state string, accepted_at timestamp_ntz, declined_at timestamp_ntz, updated_at timestamp_ntz")
    rows = [("p", "h1", "accepted", "a", True, NOW + timedelta(1), 1), ("p", "h2", "accepted", "b", True, NOW, 1), ("p", "h9", "accepted", "b", True, NOW, 1)]
    asked = spark.createDataFrame(rows, "project_id string, id string, target string, actor string, claim boolean, at timestamp_ntz, request long")
    now = F.lit(NOW).cast("timestamp_ntz")
    for requests, states in ((asked, {"h1": "pending", "h2": "accepted"}), (asked.drop("at", "request"), {"h1": "accepted", "h2": "pending"})):
        moved, outcomes = transitions.apply_handoff_moves(requests, handoffs, facts, now)
        assert {r.id: r.state for r in moved.collect()} == states
        loser = min(states, key=lambda h: states[h] == "accepted")
        assert {r.id: r.denial for r in outcomes.collect()} == {loser: "TASK_ALREADY_CLAIMED", "h1" if loser == "h2" else "h2": None, "h9": "RESOURCE_NOT_FOUND"}


def test_the_fold_stays_in_the_engine(spark):
    facts, asked = random_batch(random.Random(4), 5, 20, 0)
    plan = transitions.evaluate_in_order(spark.createDataFrame(asked, ASKED), spark.createDataFrame(facts, FACTS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "BroadcastNestedLoop"))
