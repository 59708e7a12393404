"""The stored index: the same postings as a fresh one, and only touched buckets written."""

import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from worklog.operators import search
from worklog.sources import shared

CORPUS = "project_id string, kind string, doc_id string, task_id string, body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def content(df):
    return sorted((r.project_id, r.kind, r.doc_id, r.term, r.doc_len, tuple(r.positions)) for r in df.collect())


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_refresh_writes_only_touched_buckets(spark, tmp_path):
    rnd = random.Random(1)
    rows = [("p", "task", f"d{n}", "t", " ".join(f"w{rnd.randrange(300)}" for _ in range(6))) for n in range(80)] + [("p", "note", "empty", "t", None)]
    index = search.StoredIndex(spark, str(tmp_path / "index"), 32).write(frame(spark, rows))
    assert content(index.postings) == content(search.build_index(frame(spark, rows)))
    assert sorted(map(tuple, index.stats().collect())) == sorted(map(tuple, search.index_stats(frame(spark, rows)).collect()))
    before = files(index.path)
    changed = [("p", "task", "d3", "t", "only one néw wörd"), ("p", "task", "d9", "t", None), ("p", "task", "new", "t", "another")]
    for _ in range(2):  # a second time it changes nothing
        index.refresh(frame(spark, changed))
        gone = {r[2] for r in changed}
        want = [r for r in rows if r[2] not in gone] + [r for r in changed if r[4]]
        assert content(index.postings) == content(search.build_index(frame(spark, want)))
        assert {r.doc_id for r in index.documents.collect()} == {r[2] for r in want}
    after = files(index.path)
    assert 30 < len([f for f in before if after.get(f) == before[f]]) < len(before)


def test_only_buckets_of_asked_terms_are_read(spark, tmp_path):
    rows = [("p", "task", f"d{n}", "t", f"alpha{n} beta{n % 3}") for n in range(40)]
    index = search.StoredIndex(spark, str(tmp_path / "index"), 32).write(frame(spark, rows))
    for text, pruned in (("beta1 alpha7", True), ("beta*", False)):
        leaves = search.parse_queries(spark.createDataFrame([(1, text)], "query_id long, text string"))
        few = index.postings_of(leaves)
        assert ("bucket" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]) == pruned
        whole = search.rank(index.postings, leaves, index.stats()).collect()
        assert sorted(map(tuple, search.rank(few, leaves, index.stats()).collect())) == sorted(map(tuple, whole)) and whole


def test_prefixes_meet_their_terms_alone(spark):
    rows = [("p", "task", f"d{n}", "t", f"x{n} xy{n} y") for n in range(30)]
    index = search.build_index(frame(spark, rows))
    leaves = search.parse_queries(spark.createDataFrame([(1, "xy1*"), (2, "x2*"), (3, "zz*")], "query_id long, text string"))
    hits = {(r.query_id, r.doc_id) for r in search.match_leaves(index, leaves).collect()}
    assert hits == {(1, f"d{n}") for n in (1, *range(10, 20))} | {(2, f"d{n}") for n in (2, *range(20, 30))}


def test_scopes_of_threads_are_apart(spark):
    """A table that one thread stores outlives the scope of another."""
    with ThreadPoolExecutor(1) as other:
        with shared.scratch(spark):
            kept = other.submit(lambda: shared.stored(spark.range(5), "other-thread")).result()
            mine = shared.stored(spark.range(3), "own-thread")
            assert mine.count() == 3
        assert kept.count() == 5
