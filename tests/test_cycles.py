"""Cycles against walks over small random graphs."""

import random

import pytest

from worklog.operators import deps

EDGES = "project_id string, task_id string, prerequisite_task_id string"


def reaches(edges, start, goal):
    seen, ahead = {start}, [start]
    while ahead:
        n = ahead.pop()
        if n == goal:
            return True
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                ahead.append(b)
    return False


def verdict(edges, a, b):
    return "self_dependency" if a == b else "cycle" if reaches(edges, b, a) else "ok"


def random_edges(rnd, nodes, n):
    return [(f"t{rnd.randrange(nodes):02d}", f"t{rnd.randrange(nodes):02d}") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], EDGES)


@pytest.mark.parametrize(("seed", "nodes", "n", "acyclic"), [(1, 40, 45, True), (2, 30, 40, False)])
def test_candidates_by_the_edges_alone(spark, seed, nodes, n, acyclic):
    rnd = random.Random(seed)
    edges = [e for e in random_edges(rnd, nodes, n) if not acyclic or e[0] > e[1]]
    asked = sorted(set(random_edges(rnd, nodes + 2, 150)))
    got = {(r.task_id, r.prerequisite_task_id): r.verdict for r in deps.would_cycle(frame(spark, edges), frame(spark, asked)).collect()}
    assert got == {(a, b): verdict(edges, a, b) for a, b in asked}


@pytest.mark.parametrize(("seed", "nodes", "old", "new"), [(1, 12, 6, 40), (2, 25, 20, 30)])
def test_each_candidate_sees_those_before_it(spark, seed, nodes, old, new):
    rnd = random.Random(seed)
    edges, asked = random_edges(rnd, nodes, old), list(enumerate(random_edges(rnd, nodes, new)))
    held, want = list(edges), {}
    for k, (a, b) in asked:
        want[k] = verdict(held, a, b)
        if want[k] == "ok":
            held.append((a, b))
    rnd.shuffle(asked)
    rows = spark.createDataFrame([("p", *e, k) for k, e in asked], f"{EDGES}, turn int")
    got = {r.turn: r.verdict for r in deps.would_cycle_in_order(frame(spark, edges), rows, "turn").collect()}
    assert got == want and "cycle" in got.values()


def test_of_two_opposite_candidates_the_first_is_ok(spark):
    rows = spark.createDataFrame([("p", "x", "y", 2), ("p", "y", "x", 1), ("q", "x", "y", 0), ("p", "z", "z", 0)], f"{EDGES}, turn int")
    got = {(r.project_id, r.turn): r.verdict for r in deps.would_cycle_in_order(frame(spark, []), rows, "turn").collect()}
    assert got == {("p", 1): "ok", ("p", 2): "cycle", ("q", 0): "ok", ("p", 0): "self_dependency"}


def test_levels_leave_few_pairs_to_walk(spark):
    chain = [(f"t{n + 1:03d}", f"t{n:03d}") for n in range(60)]
    walked = []
    back = [(b, a) for a, b in chain]
    far = [("t000", "t060")]
    got = {(r.task_id, r.prerequisite_task_id): r.verdict for r in deps.would_cycle(frame(spark, chain), frame(spark, chain + back + far), walked).collect()}
    assert got == {**{e: "ok" for e in chain}, **{e: "cycle" for e in back + far}}
    assert sum(walked) < 3 * len(chain)  # starts times what they reach would be 1,830


def loops(n, size):
    """Chains of edges with a link from each one's first task to its last."""
    chain = [(f"t{k:02d}.{i + 1:02d}", f"t{k:02d}.{i:02d}") for k in range(n) for i in range(size)]
    return chain, [(f"t{k:02d}.00", f"t{k:02d}.{size:02d}") for k in range(n)]


@pytest.mark.parametrize("grouped", [8])
def test_parts_that_are_too_large_for_a_row_are_walked(spark, monkeypatch, grouped):
    monkeypatch.setattr(deps, "GROUPED", grouped)
    test_candidates_by_the_edges_alone(spark, 3, 30, 32, False)
    test_each_candidate_sees_those_before_it(spark, 3, 9, 4, 12)


def test_small_parts_need_no_walks(spark, monkeypatch):
    calls = []
    for name in ("_walked", "_in_rounds"):
        monkeypatch.setattr(deps, name, lambda *_, n=name: calls.append(n))
    chain, back = loops(20, 12)
    asked = [(*e, k) for k, e in enumerate(chain[::3] + back)]
    rows = spark.createDataFrame([("p", *r) for r in asked], f"{EDGES}, turn int")
    got = {(r.task_id, r.prerequisite_task_id): r.verdict for r in deps.would_cycle_in_order(frame(spark, [e for e in chain if e not in chain[::3]]), rows, "turn").collect()}
    assert got == {e: "cycle" if e in back else "ok" for e in chain[::3] + back}
    again = {(r.task_id, r.prerequisite_task_id): r.verdict for r in deps.would_cycle(frame(spark, chain), frame(spark, back + chain)).collect()}
    assert again == {e: "cycle" if e in back else "ok" for e in chain + back}
    assert calls == []
