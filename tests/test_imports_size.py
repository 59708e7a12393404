"""Imports at size: a path is tried once, however many files import it."""

from worklog.operators import graph


def test_paths_are_tried_once(spark):
    imports = [("p", f"src/a/{n}.rs", "src/b/deep/Thing.rs") for n in range(20)] + [("p", "web/x/a.ts", "b.ts"), ("p", "web/y/a.ts", "b.ts"), ("p", "a.ts", "src/b/deep/Thing.rs")]
    files = [("p", "src/b/mod.rs"), ("p", "web/x/b.ts"), ("q", "web/y/b.ts")]
    old = [("p", "src/a/3.rs", "src/b/mod.rs", "depends_on"), ("p", "src/a/4.rs", "src/b/mod.rs", "changed")]
    edge = "project_id string, source_id string, target_id string, relation_type string"
    got = graph.resolve_imports(spark.createDataFrame(imports, "project_id string, path string, target string"), spark.createDataFrame(files, "project_id string, path string"), spark.createDataFrame(old, edge))
    assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles() if "found-files" in f}).count() == 2
    assert {(r.source_id, r.target_id) for r in got.collect()} == {(f"src/a/{n}.rs", "src/b/mod.rs") for n in range(20) if n != 3} | {("web/x/a.ts", "web/x/b.ts"), ("a.ts", "src/b/mod.rs")}
