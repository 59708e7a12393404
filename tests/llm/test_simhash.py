import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from tests.llm.test_near import words_of
from worklog.llm import simhash


def slow_fingerprint(text, k=4):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(text)]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius):
    """(identifier, fingerprint) to the least identifier that links reach."""
    parent = list(range(len(prints)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, (i, a) in enumerate(prints):
        for y, (j, b) in enumerate(prints[:x]):
            if i is not None and j is not None and (a ^ b).bit_count() <= radius:
                parent[find(x)] = find(y)
    least = defaultdict(list)
    for n, (i, _) in enumerate(prints):
        least[find(n)].append(i)
    return [(i, f"{a:016x}", None if i is None else min(least[find(n)])) for n, (i, a) in enumerate(prints)]


def clustered(rnd, n, flips):
    """Fingerprints around some centres, and random ones."""
    centres = [rnd.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        value = rnd.choice([*centres, rnd.getrandbits(64)])
        for _ in range(rnd.randrange(flips)):
            value ^= 1 << rnd.randrange(64)
        out.add(value)
    return sorted(out)


def frame(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")


@pytest.mark.parametrize(("radius", "block", "flips"), [(0, 2048, 3), (1, 2048, 3), (3, 2048, 8), (4, 16, 9), (4, 70, 9), (4, 2048, 9), (7, 100, 12)])
def test_links_match_brute_force(spark, monkeypatch, radius, block, flips):
    monkeypatch.setattr(simhash, "BLOCK", block)  # several blocks a bucket
    values = clustered(random.Random(radius + block), 400, flips)
    got = {int(np.int64(r.fp).view(np.uint64)): int(np.int64(r.component).view(np.uint64)) for r in simhash.near_fingerprints(frame(spark, values), radius).collect()}
    want = {i: c for i, _, c in slow_groups([(v, v) for v in values], radius)}
    groups = defaultdict(set), defaultdict(set)
    for v in values:
        groups[0][got.get(v, v)].add(v)
        groups[1][want[v]].add(v)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


@pytest.mark.parametrize("radius", range(8))
def test_counters_match_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 1, np.uint64)
    values = np.array([int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 14), replace=False)) for _ in range(150)], np.uint64)
    want = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    want[np.arange(150), np.arange(150)] = False
    assert (simhash.near_matrix(values, 0, radius) == want).all()
    begin = np.array([0, 1, 3, 60, 62, 126, 150])
    x, y = simhash.pairs_in_runs(values, begin, 0, radius)
    runs = [(a, b) for s, e in zip(begin, begin[1:]) for a in range(s, e) for b in range(a + 1, e) if want[a, b]]
    assert sorted(zip(x.tolist(), y.tolist())) == runs


def test_some_set_of_parts_agrees():
    for radius in range(8):
        for parts in range(radius + 1, 2 * radius + 3):
            masks, rnd = simhash.part_masks(parts, radius), random.Random(parts)
            for _ in range(50):
                flips = sum(1 << b for b in rnd.sample(range(64), radius))
                assert any(not flips & m for m in masks)
    assert [simhash.n_parts(n, 4) for n in (0, 1000, 10**6, 10**9, 10**14)] == [5, 5, 5, 6, 10]


def test_abandoned_words_are_not_looked_at_again(monkeypatch):
    looks = []
    whole = simhash._over
    monkeypatch.setattr(simhash, "_over", lambda one, *rest: looks.append(len(one)) or whole(one, *rest))
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64)
    simhash.near_matrix(values, 0, 4)
    assert looks[0] == 4000 and max(looks[5:]) < 510  # a word with the row itself is looked at to the end


@pytest.mark.parametrize("data", [cases.rows(), []])
def test_groups_of_awkward_tables(spark, data):
    got = simhash.simhash_groups(cases.frame(spark, data)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_groups([(i, slow_fingerprint(t)) for i, t, _ in data], 4), key=str)


def test_whole_table_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = simhash.op12_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(slow_groups([(r.doc_id, slow_fingerprint(r.text)) for r in rows], 4))


def test_a_large_group_of_near_copies_costs_its_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    moved = []
    whole = simhash._edges
    monkeypatch.setattr(simhash, "_edges", lambda tasks, *a: moved.append(tasks.count()) or whole(tasks, *a))
    base, rnd, per_row = random.Random(2).getrandbits(64), random.Random(3), []
    for n in (500, 2000):
        values = set()
        while len(values) < n:
            values.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))))
        moved.clear()
        assert len({r.component for r in simhash.near_fingerprints(frame(spark, values), 4).collect()}) == 1
        per_row.append(sum(moved) / n)
    assert per_row[1] < 1.5 * per_row[0]
