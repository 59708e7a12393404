"""Parts of graphs round many foci, against a walk for each."""

import random

from worklog.operators import graph


def walk(nodes, edges, project, focus, depth):
    """What the rule gives for one focus: ids and edges."""
    own = sorted(i for p, i, _ in nodes if p == project)
    names = {i: n for p, i, n in nodes if p == project}
    links = [e for e in edges if e[0] == project]
    start = next((i for i in own if i == focus or names[i].endswith(focus)), None)
    if start is None:
        return set(own), sorted(e[1:] for e in links)
    seen, ahead = {start}, {start}
    for _ in range(depth):
        ahead = {b for _, s, t in links for a, b in ((s, t), (t, s)) if a in ahead} - seen
        seen |= ahead
    return seen & set(own), sorted(e[1:] for e in links if e[1] in seen and e[2] in seen)


def test_many_foci_in_two_projects(spark):
    rnd = random.Random(5)
    nodes = [(p, f"n{i:02d}", f"dir{i % 3}/file{i % 7}") for p in "pq" for i in range(40)]
    edges = sorted({(p, f"n{rnd.randrange(42):02d}", f"n{rnd.randrange(42):02d}") for p in "pq" for _ in range(45)})
    foci = [(rnd.choice("pq"), rnd.choice([f"n{rnd.randrange(40):02d}", f"file{rnd.randrange(9)}", f"dir1/file{rnd.randrange(7)}", "none"]), rnd.randrange(5)) for _ in range(150)]  # more than a word of bits
    foci += [("r", "n01", 2), ("p", "n01", 1), ("p", "n01", 3)]
    n = spark.createDataFrame(nodes, "project_id string, id string, name string")
    e = spark.createDataFrame([(*x, "r") for x in edges], "project_id string, source_id string, target_id string, relation_type string")
    got_nodes, got_edges = graph.focus_subgraphs(n, e, spark.createDataFrame(foci, "project_id string, focus string, depth int"))
    want_nodes, want_edges = [], []
    for p, focus, depth in sorted(set(foci)):
        ids, links = walk(nodes, edges, p, focus, depth)
        want_nodes += [(p, focus, depth, i) for i in ids]
        want_edges += [(p, focus, depth, *x) for x in links]
    assert sorted((r.project_id, r.focus, r.depth, r.id) for r in got_nodes.collect()) == sorted(want_nodes)
    assert sorted((r.project_id, r.focus, r.depth, r.source_id, r.target_id) for r in got_edges.collect()) == sorted(want_edges)


def test_a_focus_that_one_project_lacks_leaves_its_graph_whole(spark):
    n = spark.createDataFrame([(p, f"{p}{i}", f"{p}/{i}") for p in "ab" for i in range(3)], "project_id string, id string, name string")
    e = spark.createDataFrame([(p, f"{p}0", f"{p}1", "r") for p in "ab"], "project_id string, source_id string, target_id string, relation_type string")
    nodes, edges = graph.focus_subgraph(n, e, "a/2", 1)
    assert sorted(r.id for r in nodes.collect()) == ["a2", "b0", "b1", "b2"]
    assert [r.source_id for r in edges.collect()] == ["b0"]
    assert nodes.columns == n.columns and edges.columns == e.columns


def test_edges_are_derived_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "string")
    n = spark.createDataFrame([("p", f"n{i}", f"n{i}") for i in range(6)], "project_id string, id string, name string")
    e = spark.createDataFrame([("p", f"n{i}", f"n{i + 1}", "r") for i in range(5)], "project_id string, source_id string, target_id string, relation_type string")
    edges = graph.focus_subgraph(n, e.withColumn("source_id", seen("source_id")), "n0", 2)[1]
    assert sorted(r.target_id for r in edges.collect()) == ["n1", "n2"]
    assert read.value == 5
