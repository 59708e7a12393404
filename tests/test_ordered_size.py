"""Requests in order at size: those of a task move once, to its facts."""

from worklog.operators import folds, transitions

ASKED = "project_id string, id string, action string, actor string, reason string, at timestamp_ntz, request long"
FACTS = "project_id string, id string, status string, has_owner boolean, open_progress long, has_active_session boolean, has_incomplete_prerequisite boolean"


def judged(spark, asked, facts):
    return transitions.evaluate_in_order(spark.createDataFrame(asked, ASKED), spark.createDataFrame(facts, FACTS))


def test_requests_of_a_task_move_once(spark):
    asked = [("p", f"t{n % 5}", "start", "a", None, None, n) for n in range(20)]
    facts = [("p", f"t{n}", "ready", False, 0, False, False) for n in range(4)]
    got = judged(spark, asked, facts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and not any("positioned" in f for f in got.inputFiles())
    assert {(r.id, r.denial) for r in got.filter("denial IS NOT NULL").collect()} == {("t4", "RESOURCE_NOT_FOUND")} and got.count() == 20


def test_tasks_with_many_and_few_requests(spark, monkeypatch):
    moves = ["claim", "release", "start", "review", "complete", "reopen"]
    asked = [("p", f"t{n % 3}" if n < 9 else "t0", moves[n % 6], "a", None, None, n) for n in range(40)] + [(None, None, "start", "a", None, None, 100 + n) for n in range(6)]
    facts = [("p", f"t{n}", "ready", False, 0, False, False) for n in range(3)]
    rows = lambda: sorted(map(str, judged(spark, asked, facts).collect()))
    whole = rows()
    monkeypatch.setattr(folds, "BITS", 2)
    assert rows() == whole and len(whole) == 46
