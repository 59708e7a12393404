import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklog.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, _id string, _v string, block string, part string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], SCHEMA).repartition(3)


def brute(data, every, positives=5, negatives=3, low=50, high=95):
    rows = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in data if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for k, (j, m, w) in enumerate(rows) if k != n)
        for s, j, m in [x for x in scores if x[2] == label][:positives]:
            found = [(t, x) for t, x, other in scores if other != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, rank, x, -s, -t) for rank, (t, x) in enumerate(found, 1)]
    return sorted(out)


def vectors(rnd, n, width, labels, spread):
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        length = rnd.choice([1, 1, 0.3, 2])
        out.append((i, rnd.randrange(labels), [length * (c + rnd.gauss(0, spread)) / width**0.5 for c in rnd.choice(centres)]))
    return out


@pytest.mark.parametrize(("labels", "spread", "rows", "anchors"), [(3, 0.2, 2048, 512), (3, 0.2, 32, 7), (40, 0.5, 32, 16), (1, 0.2, 64, 16)])
def test_matches_brute_force(spark, monkeypatch, labels, spread, rows, anchors):
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    data = vectors(random.Random(labels), 300, 12, labels, spread)
    got = hn.hard_negatives(frame(spark, data), F.col("vec_id") % 9 == 0).collect()
    assert sorted(map(tuple, got)) == brute(data, 9)


def test_awkward_tables(spark):
    rnd = random.Random(5)
    data = vectors(rnd, 60, 4, 2, 0.4)
    copy = [0.5, 0.25, -0.5, 0.5]
    data += [(100 + i, i % 2, copy) for i in range(30)]  # ties
    data += [(200, 0, copy), (200, 0, copy), (205, 1, copy), (205, 1, copy[::-1])]  # repeated identifiers
    data += [(300, None, copy), (301, 0, None), (305, 0, [1.0, None, 0.0, 0.0]), (310, 1, [float("nan")] * 4), (315, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, copy)]
    data += [(400, 0, [0.0] * 4), (405, 1, []), (410, 0, [1.0, 1.0]), (415, 1, [0.5] * 6), (420, 0, [-1.0, -1.0, 0.0, 0.0])]
    got = hn.hard_negatives(frame(spark, data), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(data, 5)
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert hn.hard_negatives(frame(spark, data), F.col("vec_id") % 1000 == 999).collect() == []


def test_large_components_stay_whole(spark):
    data = [(i, i % 2, [30000.0 + i, 1.0, float(7 * i % 5)]) for i in range(12)]
    got = hn.hard_negatives(frame(spark, data), F.col("vec_id") % 4 == 0, low=0, high=100).collect()
    assert got and all(r.negative_score <= r.positive_score and r.positive_score > 1 << 45 for r in got)


def bucket_of(values):
    lengths = np.sqrt((values.astype(float) ** 2).sum(1))
    orders = np.argsort(hn._normal(values, lengths), axis=0, kind="stable").astype(np.uint16).T
    n = len(values)
    return hn.Vectors(n, values.shape[1], np.arange(n).tobytes(), np.zeros(n, np.int64).tobytes(), values.astype("<i2").tobytes(), np.ascontiguousarray(orders).tobytes())


@pytest.mark.parametrize("spread", [5, 60])
def test_candidates_hold_every_pair_and_few_others(spread):
    rng = np.random.default_rng(spread)
    centres = rng.normal(0, 1, (20, 8))
    centres *= 250 / np.linalg.norm(centres, axis=1)[:, None]  # a bucket's rows have about the same length
    values = np.floor(centres[rng.integers(0, 20, 1000)] + rng.normal(0, spread, (1000, 8))).astype(np.int64)
    bucket, anchors = bucket_of(values), values[:100].astype(float)
    lengths = np.sqrt((anchors**2).sum(1))
    least = 0.9 * lengths * bucket.longest * rng.random(100)
    least[:5], least[5] = -np.inf, np.inf
    held = np.zeros((100, 1000), bool)
    for a, rows in hn.candidates(bucket, anchors, lengths, least):
        held[a[:, None], np.arange(1000)[rows]] = True
    wanted = values[:100] @ values.T >= least[:, None]
    assert not (wanted & ~held).any()
    assert not held[5].any()
    high = least > 0.8 * lengths * bucket.longest
    assert spread > 5 or held[high & np.isfinite(least)].mean() < 0.3


def test_feasible_range_is_the_one_of_the_cap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, p = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 3)))
        low, high = hn.feasible(a, np.full(3, a @ p))
        assert (low <= p).all() and (p <= high).all() and (low >= -1.1).all() and (high <= 1.1).all()


def test_whole_table_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    data = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = hn.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(data, 50)


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_no_step_is_broadcast_whatever_the_parts(spark, monkeypatch, held):
    monkeypatch.setattr(hn, "ROWS", 32)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "HELD", held, raising=False)
    data = vectors(random.Random(2), 300, 12, 3, 0.2)
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    got = hn.hard_negatives(frame(spark, data), F.col("vec_id") % 9 == 0).collect()
    assert sorted(map(tuple, got)) == brute(data, 9)
    plans = [run.physicalPlanDescription() for run in (runs.executionsList().apply(n) for n in range(before, runs.executionsCount()))]
    assert any("MapInArrow" in plan for plan in plans)
    assert not any("BroadcastExchange" in plan for plan in plans)
