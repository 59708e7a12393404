"""Each input of the bundles is gone through once, however many of their lists need it."""

import pytest
from pyspark.sql import functions as F

from worklog.operators import bundles
from worklog.plans.queries import _tables, queries
from worklog.sources.demo import Demo


def test_a_list_and_its_number_come_from_one_pass(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "long")
    rows = spark.range(30).select((F.col("id") % 3).alias("k"), seen("id").alias("v"))
    got = {r.k: (r.n_list, [x.v for x in r.list]) for r in bundles._collected(rows, ["k"], "list", ["v"], 2).collect()}
    assert got == {k: (10, [k, k + 3]) for k in range(3)}
    assert read.value == 30


@pytest.mark.parametrize("name", ["l2_context", "l3_member_context"])
def test_orders_are_not_read_again_for_every_list(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_bundles_have_long_lists_whole(spark):
    n = 1500
    tables = _tables(Demo(spark, "/root/testdata/sf0.001"))
    task = tables["tasks"].orderBy("id").first()
    own = [f"'{task.project_id}' AS project_id", f"'{task.id}' AS task_id"]
    items = spark.range(n).selectExpr(*own, "CAST(id AS INT) AS position", "concat('I', id) AS id", "'todo' AS type", "'open' AS status", "'x' AS content")
    decided = spark.range(n).selectExpr(*own, "format_string('DEC-%04d', id) AS display_id", "'y' AS title")
    nodes = spark.range(n).selectExpr("format_string('part-%04d', id) AS id", f"'{task.project_id}' AS project_id", "'file' AS node_type", "CAST(id AS STRING) AS name")
    edges = nodes.selectExpr("project_id", f"'{task.id}' AS source_id", "id AS target_id", "'changed' AS relation_type")
    tables |= {"progress_items": items, "decisions": decided, "graph_nodes": nodes, "graph_edges": edges}
    ctx = spark.createDataFrame([("H", task.project_id, "nobody", "/", task.id)], "ctx_id string, project_id string, agent_id string, cwd string, task_ref string")
    (row,) = bundles.context_bundle(ctx, tables).collect()
    assert [row.n_progress, row.n_decisions, row.n_nodes, row.n_edges] == [n] * 4
    assert [r.id for r in row.progress] == [f"I{k}" for k in range(n)]
    assert [r.display_id for r in row.decisions] == [f"DEC-{k:04d}" for k in range(n)]
    assert [r.id for r in row.nodes] == [r.target_id for r in row.edges] == [f"part-{k:04d}" for k in range(n)]
    (row,) = bundles.resume_bundle(ctx, tables).collect()
    assert row.n_progress == len(row.progress) == n
