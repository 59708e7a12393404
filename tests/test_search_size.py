"""Search at size: postings and texts that aren't wanted stay where they are."""

from worklog.operators import search

CORPUS = "project_id string, kind string, doc_id string, task_id string, body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_tokens_are_grouped_within_their_record(spark):
    rows = [("p", "task", f"d{n}", "t", f"b a b {n}") for n in range(20)] + [("p", "task", "none", "t", None)]
    index = search.build_index(frame(spark, rows))
    assert exchanges(index) == 0
    assert sorted((r.term, r.positions, r.doc_len) for r in index.filter("doc_id = 'd7'").collect()) == [("7", [3], 4), ("a", [1], 4), ("b", [0, 2], 4)]
    assert index.filter("doc_id = 'none'").isEmpty()


def test_rows_of_one_record_are_put_together(spark):
    rows = [("p", "task", "d", None, "a b"), ("p", "task", "d", None, "b c"), ("p", "task", "d", "t", "a")]
    got = sorted((r.task_id or "", r.term, r.positions) for r in search.build_index(frame(spark, rows)).collect())
    assert got == [("", "a", [0]), ("", "b", [0, 1]), ("", "c", [1]), ("t", "a", [0])]


def test_only_shown_hits_look_for_tasks_and_texts(spark):
    corpus = frame(spark, [("p", "task", f"d{n}", f"t{n % 2}", "red " * (n + 1)) for n in range(30)])
    tasks = spark.createDataFrame([("p", "t0", "T-0", "ready", "a")], "project_id string, id string, display_id string, status string, owner_agent_id string")
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")
    index, stats = search.build_index(corpus), search.index_stats(corpus)
    hits = search.search(index, stats, asked, tasks, limit=3)
    assert any("best-hits" in f for f in hits.inputFiles())
    assert hits.columns == ["project_id", "task_id", "query_id", "kind", "doc_id", "score", "task_display_id", "task_status", "rank", "branch"]
    assert [(r["rank"], r.task_display_id) for r in hits.orderBy("rank").collect()] == [(n, "T-0" if r.task_id == "t0" else None) for n, r in enumerate(hits.orderBy("rank").collect(), 1)]
    owned = search.search(index, stats, asked, tasks, owner="a", limit=20)
    assert owned.count() == 15 and set(owned.columns) == set(hits.columns)
    shown = search.snippet(hits, corpus, search.parse_queries(asked), n=2)
    assert any("shown-texts" in f for f in shown.inputFiles()) and shown.filter("snippet LIKE '[red]%'").count() == 3
