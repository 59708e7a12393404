import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from worklog.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), total=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), total * sum(sizes.values()), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if cap * sizes[s] < share * weight[s]}
        if not full:
            target.update({s: share * weight[s] for s in free})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_match_repeated_sharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 5, 100, rnd.randrange(10_000)]) for i in range(11)} | {None: 40}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water_fill(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix_comes_near_targets_and_repeats(spark):
    rnd = random.Random(5)
    data = [(i, " ".join(["w"] * rnd.randrange(60)), rnd.choice("aaaabcd")) for i in range(900)]
    docs = cases.frame(spark, data)
    first, second = (mixing.mix_plan(d).collect() for d in (docs, docs.repartition(7)))
    assert {tuple(r) for r in first} == {tuple(r) for r in second}
    source = {i: s for i, _, s in data}
    taken, target = defaultdict(int), {}
    for r in first:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 60
    want = sum(1.5 * len(t.split()) for _, t, _ in data)
    assert want - 60 <= sum(taken.values()) <= want
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in first if r["size"])


def brute_queue(spark, data):
    """Words taken of each document: the copies in order of finish time, as long as their sum is within the budget."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    place = {r.i: (r.u % (1 << 30), r.u) for r in spark.createDataFrame([(i,) for i in size], "i long").selectExpr("i", "xxhash64(i, 20) AS u").collect()}
    held = defaultdict(int)
    for i, _, s in data:
        held[s] += size[i]
    target, copies = water_fill(dict(held)), []
    for s in held:
        done = 0
        for i in sorted((i for i, _, x in data if x == s and size[i]), key=lambda i: (*place[i], i)):
            done += size[i]
            copies += [((held[s] * epoch + done) / target[s], s is None, s or "", place[i][1], i, epoch) for epoch in (0, 1) if target[s]]
    taken, total, budget = defaultdict(int), 0, sum(target.values())
    for *_, i, _ in sorted(copies):
        total += size[i]
        if total <= budget:
            taken[i] += size[i]
    return {i: taken[i] for i in size}


@pytest.mark.parametrize(("seed", "parts"), [(1, "4"), (2, "4"), (2, "13")])
def test_taken_matches_a_plain_queue(spark, seed, parts):
    rnd = random.Random(seed)
    data = [(i, " ".join(["w"] * rnd.choice([0, 1, rnd.randrange(50), rnd.randrange(400)])), rnd.choice(["a"] * 6 + ["b", "c", None, "é"])) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r.doc_id: r.taken for r in mixing.mix_plan(cases.frame(spark, data)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_queue(spark, data)


def test_mix_runs_no_python(spark):
    plan = mixing.mix_plan(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    mixed = mixing.mix(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for text in (plan, mixed) for word in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_rows_of_one_identifier_are_mixed_singly(spark):
    data = [(1, " ".join(["w"] * n), s) for n in range(1, 40) for s in "ab"]
    docs = cases.frame(spark, data).withColumns({"_mix_copy": F.lit("own"), "_copy": F.lit("own"), "_row": F.lit("own")})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r._mix_copy for r in mixed.collect()} == {"own"}
    words = Counter((r.text, r.source) for r in mixed.collect())
    assert max(words.values()) <= 2
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r["size"], round(r.target)] += r.taken
    target = water_fill({s: sum(range(1, 40)) for s in "ab"})
    got = Counter()
    for (text, s), n in words.items():
        got[len(text.split()), round(target[s])] += n * len(text.split())
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_mix_of_awkward_tables(spark):
    got = mixing.mix_plan(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    sizes = {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in cases.rows()}
    assert sorted(r["size"] for r in got) == sorted(sizes[t] for _, t, _ in cases.rows())
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix_plan(cases.frame(spark, [])).collect() == []
    assert mixing.mix(cases.frame(spark, [(1, None, "a"), (2, " ", None)])).collect() == []
    assert [r.taken for r in mixing.mix_plan(cases.frame(spark, [(1, "a b", None)])).collect()] == [2]
