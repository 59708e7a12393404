import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import cases
from worklog.llm import common, near_dedup, substring_dedup
from worklog.llm.components import components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_passages(data, length):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text, _ in data:
        w = words_of(text)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, text, _ in data:
        w, gone = words_of(text), set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < order(i):
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def passages(rnd, n):
    """Documents that share cut, shifted and repeated passages."""
    pool = [[f"p{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 90))] for _ in range(8)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rnd.randrange(6)):
            part = rnd.choice(pool)
            cut = rnd.randrange(len(part))
            text += rnd.choice([part, part[cut:], part[:cut], [f"n{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]])
        out.append((i, " ".join(text), "a"))
    return out


@pytest.mark.parametrize(("length", "seed", "segment"), [(12, 1, 1 << 20), (12, 2, 7), (50, 1, 30), (50, 2, 1 << 20)])
def test_passages_match_brute_force(spark, monkeypatch, length, seed, segment):
    whole = substring_dedup.Windows.runs
    monkeypatch.setattr(substring_dedup.Windows, "runs", lambda self, words, _=None: whole(self, words, segment))
    data = passages(random.Random(seed), 120)
    got = substring_dedup.remove_repeats(cases.frame(spark, data), length=length).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept_text) for r in got), key=str) == brute_passages(data, length)
    for r in got:
        assert all(a.start + a.length < b.start for a, b in zip(r.removed, r.removed[1:]))


@pytest.mark.parametrize("data", [cases.rows(), []])
def test_passages_of_awkward_tables(spark, data):
    got = substring_dedup.remove_repeats(cases.frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept_text) for r in got), key=str) == brute_passages(data, 50)


def brute_groups(data, k, percent):
    sets = {}
    for n, (_, text, _) in enumerate(data):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        sets[n] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    parent = {n: n for n in sets}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and data[a][0] is not None and data[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for n in sets:
        i, at = data[n][0], find(n)
        least[at] = i if least[at] is None else min(least[at], i if i is not None else least[at])
    return sorted(((data[n][0], len(sets[n]), least[find(n)]) for n in sets), key=str)


def near_copies(rnd, n):
    out, bases = [], [[f"b{rnd.randrange(10**6)}" for _ in range(rnd.randrange(20, 200))] for _ in range(6)]
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.randrange(12)):
            text[rnd.randrange(len(text))] = f"e{rnd.randrange(40)}"
        out.append((i, " ".join(text), "a"))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_groups_match_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)  # several blocks a cluster
    data = near_copies(random.Random(k), 250)
    got = near_dedup.near_groups(cases.frame(spark, data), k=k, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(data, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_of_awkward_tables(spark):
    got = near_dedup.near_groups(cases.frame(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(cases.rows(), 5, 80)
    assert all(r.kept for r in got if r.doc_id is None)
    docs = cases.frame(spark)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert near_dedup.near_groups(cases.frame(spark, [])).collect() == []


def test_rows_of_one_identifier_are_dropped_singly(spark):
    copy, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(1, copy, "a"), (5, copy + " end", "a"), (5, other, "a"), (7, other + " end", "a")]
    kept = near_dedup.drop_near_duplicates(cases.frame(spark, data)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, copy), (5, other)]


def test_sketches_never_reject_similar_sets():
    rng = np.random.default_rng(3)
    own = near_dedup.Sketcher(near_dedup.n_bands(85))
    for size in (1, 7, 40, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate([a[: max(1, -(-len(a) * 92 // 100))], rng.integers(0, 1 << 63, len(a) // 13, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                odd = [np.frombuffer(own.digest(s)[1], np.uint64) for s in (a, b)]
                assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= own.most_flips(85)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (203, 201), (202, 203), (202, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)} | {201: 201, 202: 201, 203: 201}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    whole = common.scratch
    monkeypatch.setattr(common, "scratch", lambda s: rounds.append(1) or whole(s))
    for n in (20, 320):
        rounds.clear()
        assert {r.component for r in components(spark.range(n).selectExpr("id AS a", "id + 1 AS b")).collect()} == {0}
        assert len(rounds) <= 2 + np.log2(n)


def moved_rows(spark, monkeypatch, data):
    """Rows that tasks get and give, and pairs or tasks' rows for which sets are fetched."""
    counts = {"tasks": 0, "pairs": 0, "sets": 0}

    def counted(name, before, after=None):
        plain = getattr(near_dedup, name)

        def run(first, *rest):
            out = plain(first, *rest)
            counts[before] += first.count()
            if after:
                counts[after] += out.count()
            return out

        monkeypatch.setattr(near_dedup, name, run)

    counted("_pairs", "tasks", "pairs")
    counted("_links", "sets")
    counted("_links_of_tasks", "sets")
    got = near_dedup.near_groups(cases.frame(spark, data)).collect()
    monkeypatch.undo()
    return counts, got


def edited(rnd, n, edits):
    base = [f"b{i}" for i in range(150)]
    for i in range(n):
        text = list(base)
        for k in range(edits):
            text[rnd.randrange(150)] = f"e{i}x{k}"
        yield i, " ".join(text), "a"


@pytest.mark.parametrize(("edits", "alike"), [(1, True), (4, False)])
def test_a_large_group_moves_rows_in_proportion(spark, monkeypatch, edits, alike):
    """Copies of one text, all alike or all less alike than asked for but more than sketches can tell."""
    moved = {}
    for n in (250, 500):
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 250)
        counts, got = moved_rows(spark, monkeypatch, list(edited(random.Random(n), n, edits)))
        assert alike == ({r.component_id for r in got} == {0})
        assert counts["pairs"] <= 45 * n
        moved[n] = counts
    assert moved[500]["pairs"] <= 3 * moved[250]["pairs"] and moved[500]["tasks"] <= 3 * moved[250]["tasks"]


def test_chained_candidates_fetch_no_sets(spark, monkeypatch):
    """Neighbours share part of their words, so they are candidates without being alike; sketches tell without sets."""
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(40 * 400)]
    data = [(i, " ".join(words[80 * i : 80 * i + 130]), "a") for i in range(190)]
    counts, got = moved_rows(spark, monkeypatch, data)
    assert all(r.kept for r in got) and counts["sets"] == 0
