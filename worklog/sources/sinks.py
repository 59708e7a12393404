"""Writing reports and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklog.functions.expr import hours_minutes

# The marks that node types have in a Mermaid graph.
NODE_MARKS = {"task": "📋", "file": "📄", "module": "📦", "agent": "🤖"}


def report_rows(stats: DataFrame) -> DataFrame:
    """Agent statistics under the report's column names, longest first."""
    return stats.select(
        "agent_name", F.col("total_sessions").alias("sessions"), "total_seconds", F.col("total_checkpoints").alias("checkpoints"), "tasks_completed", "blockers_reported"
    ).orderBy(F.desc("total_seconds"), "agent_name")


def markdown_rows(stats: DataFrame) -> DataFrame:
    """line: a table row for each agent."""
    rows = report_rows(stats)
    return rows.select(F.format_string("| %s | %d | %s | %d | %d | %d |", "agent_name", "sessions", hours_minutes(F.col("total_seconds")), "checkpoints", "tasks_completed", "blockers_reported").alias("line"))


def write_report(stats: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        report_rows(stats).write.csv(path, header=True)
    elif fmt == "json":
        report_rows(stats).write.json(path)
    elif fmt == "markdown":
        markdown_rows(stats).write.text(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def graph_to_lines(nodes: DataFrame, edges: DataFrame, fmt: str = "mermaid") -> DataFrame:
    """section, key, line: the lines of a graph in Mermaid, DOT or JSON lines, to be sorted by section and key."""
    quoted = F.replace(F.col("name"), F.lit('"'), F.lit('\\"'))
    key = F.concat_ws("\x1f", "source_id", "target_id", "relation_type")
    spark = nodes.sparkSession
    if fmt == "mermaid":
        safe = lambda c: F.concat(F.lit("node_"), F.translate(c, "-./: ", "_____"))
        mark = F.coalesce(F.create_map(*[F.lit(x) for p in NODE_MARKS.items() for x in p])[F.col("node_type")], F.concat("node_type", F.lit(":")))
        node_line = F.concat(F.lit("    "), safe(F.col("id")), F.lit('["'), mark, F.lit(" "), quoted, F.lit('"]'))
        edge_line = F.concat(F.lit("    "), safe(F.col("source_id")), F.lit(" -->|"), "relation_type", F.lit("| "), safe(F.col("target_id")))
        frame = [(0, "", "graph TD")]
    elif fmt == "dot":
        node_line = F.concat(F.lit('    "'), "id", F.lit('" [label="'), "node_type", F.lit(": "), quoted, F.lit('"];'))
        edge_line = F.concat(F.lit('    "'), "source_id", F.lit('" -> "'), "target_id", F.lit('" [label="'), "relation_type", F.lit('"];'))
        style = '    node [shape=box, style="filled,rounded", fillcolor="#f8f9fa", fontname="Helvetica"];'
        frame = [(0, "0", "digraph ContextGraph {"), (0, "1", "    rankdir=LR;"), (0, "2", style), (3, "", "}")]
    elif fmt == "json":
        node_line, edge_line, frame = F.to_json(F.struct("id", "node_type", "name")), F.to_json(F.struct("source_id", "target_id", "relation_type")), []
    else:
        raise ValueError(f"unknown graph format {fmt}")
    rows = nodes.select(F.lit(1).alias("section"), F.col("id").alias("key"), node_line.alias("line")).unionByName(edges.select(F.lit(2).alias("section"), key.alias("key"), edge_line.alias("line")))
    return rows.unionByName(spark.createDataFrame(frame, "section int, key string, line string")) if frame else rows


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "mermaid") -> None:
    graph_to_lines(nodes, edges, fmt).orderBy("section", "key").select("line").write.text(path)
