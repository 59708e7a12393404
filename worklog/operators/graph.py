"""The code graph: neighbourhoods, sub-graphs, module roll-up and edges found in source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklog.sources.shared import stored

EDGE = ["project_id", "source_id", "target_id", "relation_type"]


def neighbourhood(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the edges with an end among ids (project_id, id), and all nodes at their ends, each once."""
    own = ids.select("project_id", "id").distinct()
    touching = edges.join(own.withColumnRenamed("id", "source_id"), ["project_id", "source_id"], "left_semi").unionByName(edges.join(own.withColumnRenamed("id", "target_id"), ["project_id", "target_id"], "left_semi")).dropDuplicates(EDGE)
    ends = touching.select("project_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.join(ends, ["project_id", "id"], "left_semi"), touching


def filter_graph(nodes: DataFrame, edges: DataFrame, node_type: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the nodes of the type and the edges with either end among them."""
    own = nodes.filter(F.col("node_type") == node_type)
    return own, neighbourhood(nodes, edges, own)[1]


def focus_subgraph(nodes: DataFrame, edges: DataFrame, focus: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each project by focus_subgraphs, for one focus in all of them."""
    foci = nodes.select("project_id").distinct().select("project_id", F.lit(focus).alias("focus"), F.lit(depth).alias("depth"))
    return tuple(df.drop("focus", "depth") for df in focus_subgraphs(nodes, edges, foci))


def focus_subgraphs(nodes: DataFrame, edges: DataFrame, foci: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with focus and depth, for each of the foci (project_id, focus, depth).

    A focus is the project's first node, by created_at where nodes have it and id, with this id, name or end of a name. Its
    part of the graph is what lies within depth steps, in either direction; edges stay if both ends do. Without such a node
    it is the project's whole graph.

    All foci walk at once: a node has the foci that have come to it as bits, 64 to a row, so a step costs a row for each
    node and 64 foci. Edges are written once, so that no step has to derive them again.
    """
    edges = stored(edges, "graph-edges")
    asked = foci.select("project_id", "focus", "depth").distinct()
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("focus", "depth")).cast("long") - 1
    asked = stored(asked.withColumn("_n", number).withColumns({"_word": F.shiftright("_n", 6), "_bit": F.expr("shiftleft(1L, CAST(pmod(_n, 64) AS INT))")}), "foci")
    start = stored(_focus_nodes(nodes, asked), "focus-nodes")
    either = F.explode(F.array(*[F.struct(F.col(here).alias("id"), F.col(there).alias("_to")) for here, there in (("source_id", "target_id"), ("target_id", "source_id"))]))
    steps = edges.select("project_id", either.alias("_end")).select("project_id", "_end.*")
    farthest = asked.agg(F.max("depth")).first()[0] or 0
    seen = frontier = stored(start.groupBy("project_id", "id", "_word").agg(F.bit_or("_bit").alias("_bits")), "frontier")
    for away in range(1, farthest + 1):
        going = asked.filter(F.col("depth") >= away).groupBy("project_id", "_word").agg(F.bit_or("_bit").alias("_going"))
        ahead = frontier.join(going, ["project_id", "_word"]).withColumn("_bits", F.col("_bits").bitwiseAND(F.col("_going"))).filter("_bits <> 0")
        met = ahead.join(steps, ["project_id", "id"]).groupBy("project_id", F.col("_to").alias("id"), "_word").agg(F.bit_or("_bits").alias("_bits"))
        known = met.join(seen.withColumnRenamed("_bits", "_seen"), ["project_id", "id", "_word"], "left")
        fresh = F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        frontier = stored(known.select("project_id", "id", "_word", fresh.alias("_bits")).filter("_bits <> 0"), "frontier")
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier).groupBy("project_id", "id", "_word").agg(F.bit_or("_bits").alias("_bits")), "seen")
    places = F.expr("transform(filter(sequence(0, 63), b -> (_bits & shiftleft(1L, b)) <> 0), b -> _word * 64 + b)")
    inside = stored(seen.select("project_id", "id", F.explode(places).alias("_n")), "inside")
    name = asked.select("project_id", "_n", "focus", "depth")
    lost = name.join(start.select("project_id", "_n").distinct(), ["project_id", "_n"], "left_anti").drop("_n")
    ends = lambda end: inside.withColumnRenamed("id", end)
    own = edges.join(ends("source_id"), ["project_id", "source_id"]).join(ends("target_id"), ["project_id", "target_id", "_n"], "left_semi")
    found = [(nodes, nodes.join(inside, ["project_id", "id"])), (edges, own)]
    return tuple(part.join(name, ["project_id", "_n"]).select(*df.columns, "focus", "depth").unionByName(df.join(lost, "project_id").select(*df.columns, "focus", "depth")) for df, part in found)


def _focus_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """project_id, id, _n, _word, _bit of the node of each focus that has one. Ends of names are cut to the lengths that foci have."""
    order = F.struct(*[c for c in ("created_at", "id") if c in nodes.columns])
    of = asked.select("project_id", "focus", "_n", "_word", "_bit")
    own = nodes.select("project_id", "id", "name", order.alias("_order"))
    lengths = of.groupBy("project_id").agg(F.collect_set(F.char_length("focus")).alias("_lengths"))
    cut = own.join(lengths, "project_id").withColumn("_length", F.explode("_lengths")).filter(F.char_length("name") >= F.col("_length"))
    by_name = cut.withColumn("focus", F.right("name", F.col("_length"))).select("project_id", "id", "focus", "_order")
    by_id = own.select("project_id", "id", F.col("id").alias("focus"), "_order")
    return by_name.unionByName(by_id).join(of, ["project_id", "focus"]).groupBy("project_id", "_n", "_word", "_bit").agg(F.min_by("id", "_order").alias("id"))


def module_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, edges): modules are the first two path segments of node names; edges between different ones, once a relation."""
    module = F.substring_index(F.col("name"), "/", 2)
    own = nodes.select("project_id", "id", module.alias("module"))
    side = lambda end, name: own.select("project_id", F.col("id").alias(end), F.col("module").alias(name))
    rows = edges.join(side("source_id", "source"), ["project_id", "source_id"]).join(side("target_id", "target"), ["project_id", "target_id"])
    return own.select("project_id", "module").distinct(), rows.filter("source <> target").select("project_id", "source", "target", "relation_type").distinct()


# What an import looks like, with the import in group 1.
RUST_MODULE = r"(?m)^\s*(?:pub\s+)?mod\s+([a-zA-Z0-9_]+)\s*;"
RUST_USE = r"(?m)^\s*(?:pub\s+)?use\s+crate::([a-zA-Z0-9_:]+)[^;]*;"
SCRIPT_IMPORT = r"""(?m)^\s*import\s+.*from\s+['"]([^'"]+)['"]"""
SCRIPT_REQUIRE = r"""(?m)require\(['"]([^'"]+)['"]\)"""
HREF = r"""href=["']([^"'#?]+)"""


def extract_imports(files: DataFrame, extra: str | None = None) -> DataFrame:
    """project_id, path, target: what the files (project_id, path, content) import, by extension; extra is a pattern that
    is looked for in files of any kind."""
    every = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    extension = F.substring_index("path", ".", -1)
    modules = F.flatten(F.transform(every(RUST_MODULE), lambda m: F.array(F.concat(m, F.lit(".rs")), F.concat(m, F.lit("/mod.rs")))))
    uses = F.transform(every(RUST_USE), lambda m: F.concat(F.lit("src/"), F.replace(F.regexp_replace(m, ":+$", ""), F.lit("::"), F.lit("/")), F.lit(".rs")))
    rust = F.concat(modules, uses)
    script = F.concat(every(SCRIPT_IMPORT), every(SCRIPT_REQUIRE))
    found = F.when(extension == "rs", rust).when(extension.isin("js", "ts", "jsx", "tsx"), script).otherwise(F.array().cast("array<string>"))
    if extra:
        found = F.concat(found, every(extra))
    return files.select("project_id", "path", F.explode(F.array_distinct(found)).alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """project_id, source_id, target_id: new depends_on edges from imports to known files (project_id, path).

    A target is taken from the importing file's folder, or from the root if it starts with src/. Where no such file
    exists, a Rust target is shortened segment by segment and tried as .rs, then as mod.rs, down to below src. Files are
    tried once for each different path and not for each import; those that are found are stored, so that Spark knows how
    many there are and need not move the imports if these are few.
    """
    parent = F.when(F.col("path").contains("/"), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))).otherwise("")
    from_root = F.col("target").startswith("src/")
    exact = F.when(from_root, F.col("target")).otherwise(F.concat(parent, "target"))
    parts = F.split(F.regexp_replace("_exact", r"\.rs$", ""), "/")
    shorter = F.when(F.size(parts) > 2, F.flatten(F.transform(F.sequence(F.size(parts) - 1, F.lit(2), F.lit(-1)), lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda end: F.concat(F.array_join(F.slice(parts, 1, n), "/"), end)))))
    walk = F.when(F.col("_rooted") & F.col("_exact").endswith(".rs"), shorter)
    asked = imports.select("project_id", F.col("path").alias("source_id"), exact.alias("_exact"), from_root.alias("_rooted"))
    tries = asked.drop("source_id").distinct().withColumn("_tries", F.concat(F.array("_exact"), F.coalesce(walk, F.array().cast("array<string>"))))
    opened = tries.select("project_id", "_exact", "_rooted", F.posexplode("_tries").alias("_rank", "_file"))
    known = files.select("project_id", F.col("path").alias("_file")).distinct()
    best = opened.join(known, ["project_id", "_file"]).groupBy("project_id", "_exact", "_rooted").agg(F.min_by("_file", "_rank").alias("target_id"))
    met = asked.join(stored(best, "found-files"), ["project_id", "_exact", "_rooted"])
    new = met.select("project_id", "source_id", "target_id").distinct()
    old = existing.filter("relation_type = 'depends_on'").select("project_id", "source_id", "target_id")
    return new.join(old, ["project_id", "source_id", "target_id"], "left_anti")


def changed_edges(checkpoints: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to add: file nodes and changed edges from tasks to the files of their checkpoints."""
    rows = checkpoints.select("project_id", F.col("task_id").alias("source_id"), F.explode("changed_files").alias("target_id"), F.lit("changed").alias("relation_type")).distinct()
    files = rows.select("project_id", F.col("target_id").alias("id")).distinct().join(nodes, ["project_id", "id"], "left_anti")
    return files.select("project_id", "id", F.lit("file").alias("node_type"), F.col("id").alias("name")), rows.join(edges, EDGE, "left_anti")

