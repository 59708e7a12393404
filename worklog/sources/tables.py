"""Reading entity tables and stored reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklog.schema import SCHEMAS

EXTENSIONS = ("rs", "ts", "js", "tsx", "jsx")


def read_entity(spark: SparkSession, path: str, name: str, project_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """An entity table under its fixed schema, of all projects or one; the filter reaches the scan."""
    rows = spark.read.schema(SCHEMAS[name]).format(fmt).load(path)
    key = "id" if name == "projects" else "project_id"
    return rows if project_id is None else rows.filter(F.col(key) == project_id)


def read_source_tree(spark: SparkSession, folder: str, exts: Sequence[str] = EXTENSIONS) -> DataFrame:
    """path (below the folder) and content, one row for each file with one of the extensions.

    Spark's readers skip files without a byte, so those have no row.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(exts) + "}").load(folder)
    root = folder.rstrip("/").split("://")[-1]
    below = F.expr("substring(path, instr(path, root) + length(root) + 1)")
    return rows.select("path", "content", F.lit(root).alias("root")).select(below.alias("path"), F.col("content").cast("string").alias("content"))


def parse_change_reports(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Change lists of working-tree reports: id_col, dirty, staged, modified, deleted, untracked, renamed (from, to).

    A line is a two-letter code and a path. Codes other than M, A, D, ?? and R with an arrow are left out.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.length(x) > 2)
    code, path = (lambda x: F.trim(F.left(x, F.lit(2)))), (lambda x: F.trim(F.substr(x, F.lit(3))))

    def of(says: str):
        return F.transform(F.filter("_lines", lambda x: code(x) == says), path)

    arrows = F.filter("_lines", lambda x: code(x).startswith("R") & path(x).contains(" -> "))
    renamed = F.transform(arrows, lambda x: F.struct(F.substring_index(path(x), " -> ", 1).alias("from"), F.substr(path(x), F.instr(path(x), F.lit(" -> ")) + 4).alias("to")))
    return df.withColumn("_lines", lines).select(
        id_col, (F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0).alias("dirty"), of("A").alias("staged"), of("M").alias("modified"), of("D").alias("deleted"), of("??").alias("untracked"), renamed.alias("renamed")
    )


def diff_totals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """files, insertions, deletions of line-diff reports (added, removed, path, parted by tabs); - counts 0.

    Reports without lines have nulls.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.size(F.split(x, "\t")) >= 3)
    number = lambda x, i: F.coalesce(F.split(x, "\t")[i].try_cast("long"), F.lit(0))
    total = lambda i: F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + number(x, i))
    some = F.size("_lines") > 0
    return df.withColumn("_lines", lines).select(
        id_col, F.when(some, F.size("_lines").cast("long")).alias("files"), F.when(some, total(0)).alias("insertions"), F.when(some, total(1)).alias("deletions")
    )


def decode_json_arrays(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """JSON arrays of text as arrays; what is no such array becomes an empty one."""
    return df.withColumns({c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>")) for c in cols})


def changed_files(df: DataFrame, staged: str = "staged", modified: str = "modified", untracked: str = "untracked") -> DataFrame:
    """Add changed_files: the sorted distinct staged, modified and untracked paths."""
    return df.withColumn("changed_files", F.sort_array(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (staged, modified, untracked)]))))


def flatten_lists(df: DataFrame, cols: Sequence[str], name: str = "items") -> DataFrame:
    """Add the lists one after the other; null lists count as empty."""
    return df.withColumn(name, F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in cols]))
