"""Data-quality checks and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from worklog.schema import ENUMS, SCHEMAS


def not_blank(c: str) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0


def one_of(c: str, domain: str) -> Column:
    return F.col(c).isNull() | F.col(c).isin(ENUMS[domain])


def valid_json(c: str) -> Column:
    return F.col(c).isNull() | F.expr(f"try_parse_json(`{c}`)").isNotNull()


def in_range(c: str, low: int, high: int) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def name_pattern(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def prefix_pattern(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[A-Z]{1,10}$"), F.lit(False))


def check_rows(df: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """project_id, id, rule: a row for each rule that a row breaks; all rules are looked at in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select("project_id", F.col(id_col).alias("id"), F.explode(broken).alias("rule"))


def check_foreign_keys(tables: dict[str, DataFrame], fks: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """table_name, column_name, key, rows: values of (table, column) that (parent, key) lacks."""
    out = None
    for child, column, parent, key in fks:
        keys = tables[parent].select(F.col(key).cast("string").alias("key"))
        bad = tables[child].select(F.col(column).cast("string").alias("key")).filter("key IS NOT NULL").join(keys, "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        rows = bad.select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "key", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def check_schema(tables: dict[str, DataFrame], required: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """problem, subject: missing tables and columns, and projects with no, several or badly formed rows."""
    required = required or {name: schema.names for name, schema in SCHEMAS.items()}
    found = [("missing_table", t) for t in required if t not in tables]
    found += [("missing_column", f"{t}.{c}") for t, cols in required.items() if t in tables for c in cols if c not in tables[t].columns]
    any_table = next(iter(tables.values()))
    rows = any_table.sparkSession.createDataFrame(found, "problem string, subject string")
    if "projects" in tables:
        each = tables["projects"].groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(not_blank("name") & prefix_pattern("task_prefix")).alias("ok"))
        rows = rows.unionByName(each.filter("n > 1").select(F.lit("several_project_rows").alias("problem"), F.col("id").alias("subject")))
        rows = rows.unionByName(each.filter("NOT ok").select(F.lit("bad_project_row").alias("problem"), F.col("id").alias("subject")))
        for name, df in tables.items():
            if name != "projects" and "project_id" in df.columns:
                lost = df.select(F.col("project_id").alias("id")).distinct().join(each, "id", "left_anti")
                rows = rows.unionByName(lost.select(F.lit("no_project_row").alias("problem"), F.concat(F.lit(f"{name}:"), F.coalesce("id", F.lit("null"))).alias("subject")))
    return rows


def check_unique(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """The keys that several rows share, with their number; rows outside where do not count."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_team_rules(tasks: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """rule, project_id, id: tasks of a team of another project, and teams whose commander is no member."""
    own = teams.select("project_id", F.col("id").alias("team_id"))
    astray = tasks.filter("team_id IS NOT NULL").join(own, ["project_id", "team_id"], "left_anti").select(F.lit("team_in_other_project").alias("rule"), "project_id", "id")
    inside = members.select("project_id", F.col("team_id").alias("id"), F.col("agent_id").alias("commander_agent_id"))
    lone = teams.filter("commander_agent_id IS NOT NULL").join(inside, ["project_id", "id", "commander_agent_id"], "left_anti").select(F.lit("commander_not_member").alias("rule"), "project_id", "id")
    return astray.unionByName(lone)


def repair_sessions(df: DataFrame) -> DataFrame:
    """Sessions that are over and have no end get their last activity as the end."""
    lost = F.col("state").isin("ended", "abandoned", "stale") & F.col("ended_at").isNull()
    return df.withColumn("ended_at", F.when(lost, F.col("last_activity_at")).otherwise(F.col("ended_at")))


def repair_decisions(df: DataFrame) -> DataFrame:
    return df.withColumn("rationale", F.when(F.trim("rationale") != "", F.col("rationale")))


def repair_tasks(tasks: DataFrame, teams: DataFrame) -> DataFrame:
    """Tasks whose team is not there lose it."""
    own = teams.select("project_id", F.col("id").alias("team_id"), F.lit(True).alias("_there"))
    return tasks.join(own, ["project_id", "team_id"], "left").withColumn("team_id", F.when(F.col("_there"), F.col("team_id"))).select(*tasks.columns)


def health_report(checks: dict[str, tuple[str, DataFrame, Column]], examples: int = 5) -> DataFrame:
    """check_name, status, count, examples: each check has the status it has if it finds rows, its rows, and what names one.

    The last row is overall: healthy unless a check of status warning or error has found rows.
    """
    out = None
    for name, (severity, df, label) in checks.items():
        total = df.agg(F.count(F.lit(1)).alias("count")).withColumn("_k", F.lit(1))
        few = df.select(label.alias("_l")).orderBy("_l").limit(examples).agg(F.sort_array(F.collect_list("_l")).alias("examples")).withColumn("_k", F.lit(1))
        one = total.join(few, "_k")
        one = one.select(F.lit(name).alias("check_name"), F.when(F.col("count") > 0, severity).otherwise("ok").alias("status"), "count", "examples")
        out = one if out is None else out.unionByName(one)
    bad = F.count_if(F.col("status").isin("warning", "error"))
    overall = out.agg(bad.alias("count")).select(F.lit("overall").alias("check_name"), F.when(F.col("count") > 0, "issues_found").otherwise("healthy").alias("status"), "count", F.array().cast("array<string>").alias("examples"))
    return out.unionByName(overall)


def row_health(tables: dict[str, DataFrame], checks: dict[str, tuple[str, str, Column]], examples: int = 5, id_col: str = "id") -> DataFrame:
    """health_report of conditions on rows: checks are (severity, table, condition that a sound row meets).

    Each table is gone through once, however many checks it has: the rows that break any go on, each with its checks, to
    the few examples, and what passes by is counted on the way (DataFrame.observe). What comes to the driver is a number
    and a few identifiers for each check. A condition that is null counts as broken.
    """
    found = {}
    for table in dict.fromkeys(t for _, t, _ in checks.values()):
        rules = {n: ok for n, (_, t, ok) in checks.items() if t == table}
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
        seen = Observation()
        rows = tables[table].select(F.col(id_col).cast("string").alias("id"), broken.alias("_broken"))
        counted = rows.observe(seen, *[F.count_if(F.array_contains("_broken", n)).alias(f"n{i}") for i, n in enumerate(rules)])
        order = Window.partitionBy("check_name").orderBy("id")
        few = counted.select("id", F.explode("_broken").alias("check_name")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= examples).orderBy("check_name", "_r").collect()
        for i, name in enumerate(rules):
            found[name] = (seen.get[f"n{i}"], [r.id for r in few if r.check_name == name])
    out = [(name, severity if found[name][0] else "ok", *found[name]) for name, (severity, _, _) in checks.items()]
    bad = sum(status in ("warning", "error") for _, status, _, _ in out)
    out.append(("overall", "issues_found" if bad else "healthy", bad, []))
    return next(iter(tables.values())).sparkSession.createDataFrame(out, "check_name string, status string, count long, examples array<string>")
