import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from worklog.llm import exact_dedup, line_dedup

STRIP = " \t\n\x0b\x0c\r"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_lines_match_brute_force(spark):
    data = cases.unique()
    holders = defaultdict(set)
    for i, text, _ in data:
        for line in (text or "").split("\n"):
            key = lower(line.strip(STRIP))
            if len(key) >= 40:
                holders[key].add(i)
    want = {}
    for i, text, _ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[k := lower(x.strip(STRIP))]) >= 5 and len(k) >= 40 and max(holders[k]) != i)]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    got = {r[0]: tuple(r)[1:] for r in line_dedup.dedup_lines(cases.frame(spark, data)).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) == 12


def filled(runs, spark):
    """Five batches in descending order; h1 tells the line, and the counts that they should give."""
    want = Counter()
    for b in range(5, 0, -1):
        keys = [(h, -h, 10 * b + h % 3 + d) for h in range(b, 9) for d in range(2)]
        want.update(h for h, *_ in keys)
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, d long"), "d")
    return {h: (n, 10 * min(5, h) + h % 3 + 1) for h, n in want.items()}


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_are_compacted_and_keep_counts(spark, fanout):
    runs = line_dedup.LineRuns(spark, fanout, buckets=4)
    want = filled(runs, spark)
    assert all(len(level) < fanout for level in runs.runs + runs.counts)
    lines = [r.h1 for level in runs.runs for run in level for r in run.collect()]
    assert len(lines) == len(set(lines))
    assert {r.h1: (r.n_docs, r.keep_doc) for r in runs.totals().collect()} == want


def test_the_anti_join_decides(spark):
    class Careless(line_dedup.LineRuns):
        def unknown(self, counted):
            return counted

    runs = Careless(spark, buckets=4)
    want = filled(runs, spark)
    assert {r.h1: (r.n_docs, r.keep_doc) for r in runs.totals().collect()} != want


def test_runs_are_neither_moved_nor_sorted(spark):
    runs = line_dedup.LineRuns(spark, fanout=9, buckets=4)
    filled(runs, spark)
    with line_dedup._in_bucket_order(spark):
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (runs.totals(), runs.unknown(runs.runs[0][0]), runs.merged(runs.runs[0][:2]))]
    for plan in plans:
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_batches_grow_with_the_logarithm():
    assert [line_dedup.n_batches(n) for n in (0, 1, 1 << 18, 1 << 19, 1 << 28)] == [4, 4, 4, 5, 14]


def test_lines_of_awkward_tables(spark):
    got = line_dedup.dedup_lines(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    assert line_dedup.dedup_lines(cases.frame(spark, [])).collect() == []
    alone = line_dedup.dedup_lines(cases.frame(spark, [(None, "y" * 50, "a")] * 6)).collect()
    assert [r.n_dropped for r in alone] == [0] * 6


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_copies_are_settled_by_comparing_whole_texts(spark, monkeypatch):
    data = cases.rows() + [(500 + i, f"copy {i % 5}", "a") for i in range(40)]
    monkeypatch.setattr(exact_dedup, "_sha", lambda norm: F.lit("one hash for all"))
    got = exact_dedup.duplicate_groups(cases.frame(spark, data)).collect()
    groups = defaultdict(list)
    for i, text, _ in data:
        groups[normal(text)].append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)


def test_a_hot_text_is_dealt_to_several_ranges(spark):
    data = [(i, "hot  text" if i % 3 else f"other {i % 30}", "a") for i in range(3000)]
    docs = cases.frame(spark, data)
    hashes, texts = exact_dedup._hot(docs, "doc_id", "text", 150)
    assert [r["_ranges"] for r in hashes.collect()] == [14] and [(r["_keep"], r["_all"]) for r in texts.collect()] == [(1, 2000)]
    got = exact_dedup.duplicate_groups(docs, copies=150).collect()
    assert Counter((r.keep_id, r.group_size) for r in got) == Counter({(1, 2000): 2000} | {(3 * k, 100): 100 for k in range(10)})
    assert sorted(r.doc_id for r in got if r.kept) == [0, 1, *range(3, 30, 3)]
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs, copies=150).collect()) == [0, 1, *range(3, 30, 3)]


def test_texts_are_moved_once(spark):
    plan = exact_dedup.duplicate_groups(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("copies", [1, 2, None])
def test_exact_groups_match_brute_force(spark, copies):
    data = cases.rows()
    got = exact_dedup.duplicate_groups(cases.frame(spark, data), copies=copies).collect()
    groups = defaultdict(list)
    for i, text, _ in data:
        groups[hashlib.sha256(normal(text).encode()).hexdigest()].append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, min((x for x in ids if x is not None), default=None), len(ids), sha) for sha, ids in groups.items() for i in ids
    )
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(groups.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_whole_rows(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({normal(t) for _, t, _ in cases.rows()})
    assert {r.doc_id for r in got if r.text == "same text again"} == {60}
    assert exact_dedup.drop_duplicates(cases.frame(spark, [])).collect() == []
    assert exact_dedup.duplicate_groups(cases.frame(spark, [])).collect() == []


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.duplicate_groups(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
