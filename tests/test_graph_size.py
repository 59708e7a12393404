"""Edges at size: rows move to tasks of a fixed number before they are told apart."""

import pytest

from worklog.sources import shared
from worklog.sources.demo import VIEWS, Demo

SF = "/root/testdata/sf0.001"


def grouped_after_moving(df):
    """Whether no grouping is below the first exchange."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("Aggregate") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("rows, tasks", [(10, 4), (4 * 2_000_000 + 1, 5)])
def test_tasks_follow_the_number_of_rows(spark, rows, tasks):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (None, None)], "n long, t string")
    got = shared.distinct_rows(df, rows)
    assert got.rdd.getNumPartitions() == tasks
    assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))


def test_edges_are_those_of_the_view(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines = lines.union(lines.limit(5)).union(lines.limit(3).selectExpr("l_orderkey", *["NULL"] * 7, "NULL", *lines.columns[9:]))
    d = Demo(spark, SF)
    d.built["lineitem"] = lines
    want = spark.sql(VIEWS["wl_graph_edges"], lineitem=lines)
    assert d.graph_edges.columns == want.columns
    assert d.graph_edges.exceptAll(want).isEmpty() and want.exceptAll(d.graph_edges).isEmpty()
    assert grouped_after_moving(d.graph_edges)
