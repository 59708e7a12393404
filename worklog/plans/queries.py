"""A query for each operator over the demo tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklog.functions import expr
from worklog.operators import bundles, deps, graph, latest, listing, quality, resolve, retention, scopes, search, stats, transitions
from worklog.sources import sinks, tables
from worklog.sources.demo import Demo, with_views
from worklog.sources.shared import shared_folder, stored
from worklog.streaming import streams

NOW = datetime(2001, 9, 1)
LOG_NOW = datetime(2024, 2, 1)

_QUERIES: dict[str, Callable[[Demo], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Demo], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Demo(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}


def joined(column: str, sep: str = "|"):
    return F.array_join(F.col(column), sep)


# Sources and sinks


@query("a1_read_entity", "SELECT id, project_id, name, status FROM wl_agents WHERE project_id = 'P2'")
def _(d: Demo) -> DataFrame:
    return listing.project_fields(d.agents, ["id", "project_id", "name", "status", "nothing"]).filter("project_id = 'P2'")


@query("a1_stored_entity", "SELECT id, type, occurred_at, task_id FROM wl_events WHERE project_id = 'P1'")
def _(d: Demo) -> DataFrame:
    path = shared_folder(d.spark, "stored-events")
    d.log.write.partitionBy("type").parquet(path)
    return tables.read_entity(d.spark, path, "events", "P1").select("id", "type", "occurred_at", "task_id")


REPORT = "concat(CASE number % 6 WHEN 0 THEN ' M' WHEN 1 THEN 'A ' WHEN 2 THEN '??' WHEN 3 THEN ' D' WHEN 4 THEN 'R ' ELSE 'MM' END, ' src/', CAST(number AS STRING), CASE WHEN number % 6 = 4 THEN ' -> lib/x' ELSE '' END, chr(10), 'A  docs/', CAST(number % 100 AS STRING), chr(10), ' M docs/', CAST(number % 100 AS STRING))"


def _reports(d: Demo) -> DataFrame:
    return d.tasks.selectExpr("id", f"{REPORT} AS report")


@query(
    "a3_change_reports",
    """SELECT id, concat_ws('|', CASE WHEN number % 6 = 1 THEN concat('src/', CAST(number AS STRING)) END, concat('docs/', CAST(number % 100 AS STRING))) AS staged,
  concat_ws('|', CASE WHEN number % 6 = 0 THEN concat('src/', CAST(number AS STRING)) END, concat('docs/', CAST(number % 100 AS STRING))) AS modified,
  CASE WHEN number % 6 = 3 THEN concat('src/', CAST(number AS STRING)) ELSE '' END AS deleted, CASE WHEN number % 6 = 2 THEN concat('src/', CAST(number AS STRING)) ELSE '' END AS untracked,
  CASE WHEN number % 6 = 4 THEN concat('src/', CAST(number AS STRING), '>', 'lib/x') ELSE '' END AS renamed, true AS dirty FROM wl_tasks""",
)
def _(d: Demo) -> DataFrame:
    lists = tables.parse_change_reports(_reports(d), "id", "report")
    renamed = F.array_join(F.transform("renamed", lambda r: F.concat(r["from"], F.lit(">"), r["to"])), "|")
    return lists.select("id", *[joined(c).alias(c) for c in ("staged", "modified", "deleted", "untracked")], renamed.alias("renamed"), "dirty")


@query("a4_diff_totals", "SELECT id, CASE WHEN number % 5 > 0 THEN 2 ELSE -1 END AS files, CASE WHEN number % 5 > 0 THEN number ELSE -1 END AS insertions, CASE WHEN number % 5 > 0 THEN number % 7 + 3 ELSE -1 END AS deletions FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    text = "CASE WHEN number % 5 = 0 THEN '' ELSE concat(CAST(number AS STRING), chr(9), CAST(number % 7 AS STRING), chr(9), 'a', chr(10), '-', chr(9), '3', chr(9), 'b') END AS report"
    return tables.diff_totals(d.tasks.selectExpr("id", text), "id", "report").fillna(-1)


@query("a5_json_arrays", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING), '|', event_type) END AS items FROM events")
def _(d: Demo) -> DataFrame:
    text = """CASE WHEN event_id % 3 = 0 THEN 'no json' ELSE concat('["u', CAST(user_id AS STRING), '","', event_type, '"]') END AS items"""
    return tables.decode_json_arrays(d["events"].selectExpr("event_id", text), ["items"]).select("event_id", joined("items").alias("items"))


STATS_SQL = """
WITH s AS (SELECT project_id, agent_id, count(*) AS n, CAST(sum(greatest(0, date_diff('second', started_at, coalesce(ended_at, last_activity_at)) - CASE WHEN date_trunc('second', started_at) + (coalesce(ended_at, last_activity_at) - date_trunc('second', coalesce(ended_at, last_activity_at))) < started_at THEN 1 ELSE 0 END)) AS BIGINT) AS sec FROM wl_sessions GROUP BY ALL),
c AS (SELECT project_id, agent_id, count(*) AS n FROM wl_checkpoints GROUP BY ALL),
t AS (SELECT project_id, owner_agent_id AS agent_id, count(*) AS n FROM wl_tasks WHERE status = 'completed' GROUP BY ALL),
b AS (SELECT s.project_id, s.agent_id, count(*) AS n FROM wl_progress_items p JOIN wl_sessions s ON s.id = p.source_session_id AND s.project_id = p.project_id WHERE p.type = 'blocker' GROUP BY ALL)
SELECT a.project_id, a.id AS agent_id, a.name AS agent_name, coalesce(s.n, 0) AS total_sessions, coalesce(s.sec, 0) AS total_seconds, coalesce(c.n, 0) AS total_checkpoints, coalesce(t.n, 0) AS tasks_completed, coalesce(b.n, 0) AS blockers_reported
FROM wl_agents a LEFT JOIN s ON a.id = s.agent_id AND a.project_id = s.project_id LEFT JOIN c ON a.id = c.agent_id AND a.project_id = c.project_id LEFT JOIN t ON a.id = t.agent_id AND a.project_id = t.project_id LEFT JOIN b ON a.id = b.agent_id AND a.project_id = b.project_id
"""


@query("d3_agent_stats", STATS_SQL)
def _agent_stats(d: Demo) -> DataFrame:
    return stats.agent_stats(d.agents, d.sessions, d.checkpoints, d.tasks, d.progress_items)


@query("a6_report_rows", f"SELECT concat('| ', agent_name, ' | ', total_sessions, ' | ', total_seconds // 3600, 'h ', total_seconds % 3600 // 60, 'm | ', total_checkpoints, ' | ', tasks_completed, ' | ', blockers_reported, ' |') AS line FROM ({STATS_SQL})")
def _(d: Demo) -> DataFrame:
    return sinks.markdown_rows(_agent_stats(d))


@query(
    "a7_graph_lines",
    """SELECT 0 AS section, '' AS key, 'graph TD' AS line UNION ALL
SELECT 1, id, concat('    node_', replace(id, '-', '_'), '["', CASE node_type WHEN 'file' THEN '📄' ELSE '🤖' END, ' ', name, '"]') FROM wl_graph_nodes UNION ALL
SELECT 2, concat(source_id, chr(31), target_id, chr(31), relation_type), concat('    node_', replace(source_id, '-', '_'), ' -->|', relation_type, '| node_', replace(target_id, '-', '_')) FROM wl_graph_edges""",
)
def _(d: Demo) -> DataFrame:
    return sinks.graph_to_lines(d.graph_nodes, d.graph_edges)


# Lists


@query("b2_list_tasks", "SELECT id, status, owner_agent_id, created_at FROM wl_tasks WHERE status IN ('planned', 'ready')")
def _(d: Demo) -> DataFrame:
    return listing.list_tasks(d.tasks, ready=True).select("id", "status", "owner_agent_id", "created_at")


@query("b3_list_agents", "SELECT id, name, status FROM wl_agents WHERE status = 'active'")
def _(d: Demo) -> DataFrame:
    return listing.list_agents(d.agents, "active").select("id", "name", "status")


@query("b4_list_handoffs", "SELECT id, state, to_agent_id FROM wl_handoffs WHERE state = 'declined'")
def _(d: Demo) -> DataFrame:
    return listing.list_handoffs(d.handoffs, "Rejected").select("id", "state", "to_agent_id")


@query("b5_list_progress", "SELECT id, task_id, position, status FROM wl_progress_items WHERE status <> 'removed'")
def _(d: Demo) -> DataFrame:
    return listing.list_progress(d.progress_items).select("id", "task_id", "position", "status")


@query("b6_list_checkpoints", "SELECT id, task_id, created_at FROM wl_checkpoints WHERE task_id = 'K0000000007'")
def _(d: Demo) -> DataFrame:
    return listing.list_entity(d.checkpoints, "checkpoints", "K0000000007").select("id", "task_id", "created_at")


@query("b7_active_sessions", "SELECT id, agent_id, last_activity_at FROM wl_sessions WHERE state = 'active' AND worktree_id = 'W3'")
def _(d: Demo) -> DataFrame:
    return listing.active_sessions(d.sessions, worktree="W3").select("id", "agent_id", "last_activity_at")


@query("b8_filter_events", "SELECT id, type, occurred_at FROM wl_events WHERE type IN ('task.completed', 'task.completeed') AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at <= TIMESTAMP '2024-01-20'")
def _(d: Demo) -> DataFrame:
    return listing.filter_events(d.log, event_type="task.completed", since=datetime(2024, 1, 5), until=datetime(2024, 1, 20)).select("id", "type", "occurred_at")


@query("b9_event_types", "SELECT id, CASE type WHEN 'task.completeed' THEN 'task.completed' WHEN 'task.releaseed' THEN 'task.released' WHEN 'task.canceled' THEN 'task.cancelled' ELSE type END AS type FROM wl_events")
def _(d: Demo) -> DataFrame:
    return listing.normalise_event_types(d.log).select("id", "type")


@query("b10_page_events", "SELECT id, occurred_at FROM wl_events WHERE (occurred_at, id) < (TIMESTAMP '2024-01-20', 'E9') ORDER BY occurred_at DESC, id DESC LIMIT 26")
def _(d: Demo) -> DataFrame:
    return listing.page_events(d.log, 25, (datetime(2024, 1, 20), "E9")).select("id", "occurred_at")


DURATION = "CASE number % 5 WHEN 0 THEN concat(CAST(number AS STRING), 'h30m') WHEN 1 THEN concat(CAST(number AS STRING), 'ms') WHEN 2 THEN concat(CAST(number AS STRING), 'q') WHEN 3 THEN '0s' ELSE concat('1w', CAST(number AS STRING), 'd') END"


@query("b11_durations", "SELECT id, CASE number % 5 WHEN 0 THEN number * 3600000 + 1800000 WHEN 1 THEN number WHEN 4 THEN 604800000 + number * 86400000 ELSE -1 END AS ms FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    return d.tasks.selectExpr("id", f"{DURATION} AS text").select("id", F.coalesce(expr.duration_ms(F.col("text")), F.lit(-1)).alias("ms"))


@query("b12_since_bounds", "SELECT id, CASE WHEN number % 2 = 0 THEN TIMESTAMP '2001-01-02 03:04:05' ELSE TIMESTAMP '2001-09-01' - INTERVAL 1 HOUR * (number % 50 + 1) END AS since FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    text = "CASE WHEN number % 2 = 0 THEN '2001-01-02 03:04:05' ELSE concat(CAST(number % 50 + 1 AS STRING), 'h') END AS text"
    return d.tasks.selectExpr("id", text).select("id", expr.since_bound(F.col("text"), F.lit(NOW).cast("timestamp_ntz")).alias("since"))


@query("b13_clip", "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '…') ELSE text END AS title, substr(role, 1, 8) AS short FROM conversations")
def _(d: Demo) -> DataFrame:
    return d["conversations"].select("conv_id", "turn", expr.clip(F.col("text"), 80, "…").alias("title"), expr.short_id(F.col("role")).alias("short"))


@query("b14_clip_json", """SELECT event_id, concat('{"a_long_key":"', substr(event_type, 1, 4), CASE WHEN length(event_type) > 4 THEN '...' ELSE '' END, '","n":{"v":"', CASE WHEN length(CAST(event_id AS STRING)) > 4 THEN concat(substr(CAST(event_id AS STRING), 1, 4), '...') ELSE CAST(event_id AS STRING) END, '"}}') AS payload FROM events""")
def _(d: Demo) -> DataFrame:
    text = """concat('{"a_long_key":"', event_type, '","n":{"v":"', CAST(event_id AS STRING), '"}}') AS payload"""
    return d["events"].selectExpr("event_id", text).withColumn("payload", expr.clip_json_strings(F.col("payload"), 4))


@query("b15_compact_progress", "SELECT id, task_id, type, content, position FROM wl_progress_items WHERE status = 'open'")
def _(d: Demo) -> DataFrame:
    return listing.compact_progress(d.progress_items)


@query("b16_display_ids", "SELECT id, CASE WHEN number < 10000 THEN concat('A-B-', lpad(CAST(number AS STRING), 4, '0')) ELSE concat('A-B-', CAST(number AS STRING)) END AS shown, 'A-B' AS prefix, number FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    rows = d.tasks.select("id", expr.format_display_id(F.lit("A-B"), F.col("number")).alias("shown"))
    return rows.select("id", "shown", expr.display_prefix(F.col("shown")).alias("prefix"), expr.display_number(F.col("shown")).alias("number"))


@query("b17_aliases", "SELECT id, CASE number % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' ELSE priority END AS priority FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    said = F.expr("CASE number % 3 WHEN 0 THEN 'backlog' WHEN 1 THEN 'critical' ELSE priority END")
    return d.tasks.select("id", expr.normalise_enum(said, "task_priority").alias("priority"))


@query("b18_search_decisions", "SELECT id, display_id FROM wl_decisions WHERE lower(title) LIKE '%the%an%' OR lower(decision_body) LIKE '%the%an%' OR lower(rationale) LIKE '%the%an%'")
def _(d: Demo) -> DataFrame:
    return listing.search_decisions(d.decisions, "THE%an").select("id", "display_id")


# References and joins


@query(
    "c1_resolve_refs",
    """WITH r AS (SELECT id AS ref_id, project_id, CASE number % 4 WHEN 0 THEN display_id WHEN 1 THEN id WHEN 2 THEN 'nothing' END AS ref FROM wl_tasks)
SELECT ref_id, coalesce((SELECT min(t.id) FROM wl_tasks t WHERE t.project_id = r.project_id AND t.display_id = r.ref), (SELECT min(t.id) FROM wl_tasks t WHERE t.project_id = r.project_id AND t.id = r.ref)) AS resolved_id FROM r""",
)
def _(d: Demo) -> DataFrame:
    refs = d.tasks.selectExpr("id AS ref_id", "project_id", "CASE number % 4 WHEN 0 THEN display_id WHEN 1 THEN id WHEN 2 THEN 'nothing' END AS ref")
    return resolve.resolve_refs(refs, "ref", d.tasks.select("project_id", "id", "display_id"), ["display_id", "id"]).select("ref_id", "resolved_id")


@query("c1_resolve_roles", "SELECT t.id AS ref_id, a.first_id AS resolved_id FROM wl_tasks t LEFT JOIN (SELECT project_id, role, arg_min(id, (name, id)) AS first_id FROM wl_agents GROUP BY ALL) a ON a.project_id = t.project_id AND a.role = CASE WHEN t.number % 2 = 0 THEN 'BUILDING' ELSE 'none' END")
def _(d: Demo) -> DataFrame:
    refs = d.tasks.selectExpr("id AS ref_id", "project_id", "CASE WHEN number % 2 = 0 THEN 'BUILDING' ELSE 'none' END AS ref")
    return resolve.resolve_refs(refs, "ref", d.agents, ["name", "id", "role"]).select("ref_id", "resolved_id")


CONTEXT = "SELECT id AS ctx_id, project_id, id AS agent_id, CASE WHEN substr(id, 9, 1) IN ('3', '6') THEN concat('/work/', CAST(CAST(substr(id, 2) AS INT) % 40 AS STRING), '/', CAST(CAST(substr(id, 2) AS INT) AS STRING), '/deep') ELSE '/elsewhere' END AS cwd, CASE WHEN substr(id, 9, 1) = '1' THEN 'TSK-12' WHEN substr(id, 9, 1) = '2' THEN 'TSK-x' END AS task_ref, CASE WHEN substr(id, 9, 1) IN ('1', '2') THEN name WHEN substr(id, 9, 1) = '7' THEN 'nobody' END AS agent_ref FROM"


def _contexts(d: Demo) -> DataFrame:
    return d.spark.sql(f"{CONTEXT} {{agents}}", agents=d.agents)


@query(
    "c2_current_task",
    f"""WITH ctx AS ({CONTEXT} wl_agents),
s AS (SELECT project_id, arg_max(task_id, (started_at, id)) AS task FROM wl_sessions WHERE state = 'active' AND task_id IS NOT NULL AND project_id <> 'P1' GROUP BY 1),
w AS (SELECT c.ctx_id, arg_max(w.task_id, (length(w.normalized_path), w.normalized_path)) AS task FROM ctx c JOIN wl_worktrees w ON c.cwd = w.normalized_path OR starts_with(c.cwd, concat(w.normalized_path, '/')) WHERE w.task_id IS NOT NULL GROUP BY 1),
o AS (SELECT project_id, owner_agent_id, min(id) AS task FROM wl_tasks WHERE status = 'in_progress' AND owner_agent_id IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT c.ctx_id, CASE WHEN task_ref IS NOT NULL THEN t.id ELSE coalesce(s.task, w.task, o.task) END AS task_id,
  CASE WHEN task_ref IS NOT NULL THEN CASE WHEN t.id IS NULL THEN 'not_found' ELSE 'explicit' END WHEN s.task IS NOT NULL THEN 'session' WHEN w.task IS NOT NULL THEN 'worktree' WHEN o.task IS NOT NULL THEN 'own' ELSE 'none' END AS source
FROM ctx c LEFT JOIN wl_tasks t ON t.project_id = c.project_id AND t.display_id = c.task_ref LEFT JOIN s ON s.project_id = c.project_id LEFT JOIN w ON w.ctx_id = c.ctx_id LEFT JOIN o ON o.project_id = c.project_id AND o.owner_agent_id = c.agent_id""",
)
def _(d: Demo) -> DataFrame:
    return resolve.resolve_current_task(_contexts(d), d.tasks, d.sessions.filter("project_id <> 'P1'"), d.worktrees).select("ctx_id", "task_id", "source")


@query(
    "c3_current_agent",
    f"""WITH ctx AS ({CONTEXT} wl_agents), a AS (SELECT project_id, count(*) AS n, min(id) AS one FROM wl_agents WHERE status = 'active' GROUP BY 1),
r AS (SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY name, id) AS k FROM wl_agents WHERE status = 'active'), l AS (SELECT project_id, string_agg(name, '|' ORDER BY name) AS names FROM r WHERE k <= 10 GROUP BY 1)
SELECT c.ctx_id, CASE WHEN agent_ref IS NOT NULL THEN (SELECT min(id) FROM wl_agents x WHERE x.project_id = c.project_id AND x.name = c.agent_ref) WHEN a.n = 1 THEN a.one END AS resolved_agent,
  CASE WHEN agent_ref IS NULL AND a.n > 1 THEN l.names END AS candidates FROM ctx c LEFT JOIN a ON a.project_id = c.project_id LEFT JOIN l ON l.project_id = c.project_id""",
)
def _(d: Demo) -> DataFrame:
    return resolve.resolve_current_agent(_contexts(d), d.agents).select("ctx_id", "resolved_agent", joined("candidates").alias("candidates"))


@query(
    "c4_prefix_join",
    """WITH p AS (SELECT concat(split_part(pattern, '/', 1), '/', split_part(pattern, '/', 2)) AS prefix, min(project_id) AS project_id FROM wl_scopes WHERE pattern LIKE '%/%' GROUP BY 1),
u AS (SELECT page_id, split_part(url, '://', 2) AS path FROM pages)
SELECT u.page_id, arg_max(p.project_id, (length(p.prefix), p.prefix)) AS project_id FROM u LEFT JOIN p ON u.path = p.prefix OR starts_with(u.path, concat(p.prefix, '/')) GROUP BY 1""",
)
def _(d: Demo) -> DataFrame:
    prefixes = d.scopes.select(F.substring_index("pattern", "/", 2).alias("path_prefix"), "project_id").groupBy("path_prefix").agg(F.min("project_id").alias("project_id"))
    paths = d["pages"].select("page_id", F.substring_index("url", "://", -1).alias("path"))
    return resolve.prefix_join(paths, prefixes).select("page_id", "project_id")


@query(
    "c5_dependency_summary",
    """SELECT t.project_id, t.id, coalesce((SELECT string_agg(concat(p.id, ':', p.status, ':', d.kind), '|' ORDER BY p.id) FROM wl_task_dependencies d JOIN wl_tasks p ON p.id = d.prerequisite_task_id AND p.project_id = d.project_id WHERE d.task_id = t.id), '') AS depends_on,
  coalesce((SELECT string_agg(concat(p.id, ':', p.status, ':', d.kind), '|' ORDER BY p.id) FROM wl_task_dependencies d JOIN wl_tasks p ON p.id = d.task_id AND p.project_id = d.project_id WHERE d.prerequisite_task_id = t.id), '') AS blocks FROM wl_tasks t""",
)
def _(d: Demo) -> DataFrame:
    rows = deps.dependency_summary(d.tasks, d.task_dependencies)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["status"], x["kind"])), "|").alias(c)
    return rows.select("project_id", "id", text("depends_on"), text("blocks"))


@query("c6_orphaned_tasks", "SELECT id, owner_agent_id FROM wl_tasks WHERE owner_agent_id IS NOT NULL AND owner_agent_id NOT IN (SELECT id FROM wl_agents)")
def _(d: Demo) -> DataFrame:
    return resolve.orphaned_tasks(d.tasks, d.agents).select("id", "owner_agent_id")


OBSERVED = "SELECT project_id, CASE WHEN length(normalized_path) % 3 = 0 THEN concat(normalized_path, '-new') ELSE normalized_path END AS normalized_path, length(id) % 2 = 0 AS detached, id = 'W5' AS is_root FROM"


@query("c7_reconcile", f"WITH o AS ({OBSERVED} wl_worktrees) SELECT project_id, normalized_path, 'candidate' AS verdict FROM o WHERE NOT detached AND NOT is_root AND normalized_path NOT IN (SELECT normalized_path FROM wl_worktrees) UNION ALL SELECT project_id, normalized_path, 'stale' FROM wl_worktrees WHERE normalized_path NOT IN (SELECT normalized_path FROM o)")
def _(d: Demo) -> DataFrame:
    return resolve.reconcile_registry(d.worktrees, d.spark.sql(f"{OBSERVED} {{w}}", w=d.worktrees))


@query(
    "c9_team_scope_conflicts",
    """WITH s AS (SELECT DISTINCT s.project_id, s.task_id, s.pattern FROM wl_scopes s JOIN wl_tasks t ON t.id = s.task_id WHERE t.status NOT IN ('completed', 'cancelled'))
SELECT a.project_id, a.task_id AS task_a, a.pattern AS pattern_a, b.task_id AS task_b, b.pattern AS pattern_b FROM s a JOIN s b ON a.project_id = b.project_id AND a.task_id < b.task_id AND (a.pattern = b.pattern OR a.pattern = '**' OR b.pattern = '**')""",
)
def _(d: Demo) -> DataFrame:
    return scopes.team_scope_conflicts(d.scopes, d.tasks)


@query(
    "c8_scope_conflicts",
    r"""WITH s AS (SELECT DISTINCT s.project_id, s.task_id, s.pattern, split_part(s.pattern, '/', 1) AS f, s.pattern NOT LIKE '%[bad%' AS ok, concat('^', replace(replace(regexp_replace(s.pattern, '\*+', '<any>', 'g'), '.', '\.'), '<any>', '.*'), '$') AS r FROM wl_scopes s JOIN wl_tasks t ON t.id = s.task_id WHERE t.status NOT IN ('completed', 'cancelled')),
p AS (SELECT a.project_id, a.task_id AS task_a, a.pattern AS pattern_a, b.task_id AS task_b, b.pattern AS pattern_b, a.ok AND b.ok AS ok, a.f = b.f AS same, CASE WHEN a.ok AND b.ok THEN regexp_matches(b.pattern, a.r) OR regexp_matches(a.pattern, b.r) ELSE false END AS hit FROM s a JOIN s b ON a.project_id = b.project_id AND a.task_id < b.task_id)
SELECT project_id, task_a, pattern_a, task_b, pattern_b, CASE WHEN hit THEN 'Definite' ELSE 'Possible' END AS kind FROM p WHERE hit OR NOT ok OR same""",
)
def _(d: Demo) -> DataFrame:
    return scopes.scope_conflicts(d.scopes, d.tasks)


@query(
    "c10_resolve_team",
    """WITH m AS (SELECT m.project_id, m.agent_id, arg_min(m.team_id, (t.name, t.id)) AS team FROM wl_team_members m JOIN wl_teams t ON t.id = m.team_id AND t.project_id = m.project_id GROUP BY ALL)
SELECT h.id AS ctx_id, coalesce(t.team_id, m.team) AS team_id FROM wl_handoffs h LEFT JOIN wl_tasks t ON t.id = h.task_id AND h.state = 'accepted' LEFT JOIN m ON m.agent_id = h.from_agent_id AND m.project_id = h.project_id""",
)
def _(d: Demo) -> DataFrame:
    ctx = d.handoffs.selectExpr("id AS ctx_id", "project_id", "CASE WHEN state = 'accepted' THEN task_id END AS task_id", "from_agent_id AS agent_id")
    return resolve.resolve_team(ctx, d.tasks, d.teams, d.team_members).select("ctx_id", "team_id")


# Aggregates


@query("d1_task_counts", "SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status = 'planned') AS planned, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM wl_tasks GROUP BY 1")
def _(d: Demo) -> DataFrame:
    return stats.task_status_counts(d.tasks)


@query("d2_entity_totals", "SELECT p.id AS project_id, (SELECT count(*) FROM wl_graph_nodes x WHERE x.project_id = p.id) AS nodes_total, (SELECT count(*) FROM wl_graph_edges x WHERE x.project_id = p.id) AS edges_total, (SELECT count(*) FROM wl_checkpoints x WHERE x.project_id = p.id) AS checkpoints_total, (SELECT count(*) FROM wl_sessions x WHERE x.project_id = p.id) AS sessions_total FROM wl_projects p")
def _(d: Demo) -> DataFrame:
    return stats.entity_totals({"nodes": d.graph_nodes, "edges": d.graph_edges, "checkpoints": d.checkpoints, "sessions": d.sessions})


@query("d4_session_seconds", "SELECT id, greatest(0, CAST(floor(epoch(coalesce(ended_at, last_activity_at) - started_at)) AS BIGINT)) AS seconds FROM wl_sessions")
def _(d: Demo) -> DataFrame:
    return stats.session_seconds(d.sessions).select("id", "seconds")


@query(
    "d5_team_status",
    """WITH m AS (SELECT project_id, team_id, count(*) AS n FROM wl_team_members GROUP BY ALL), o AS (SELECT project_id, team_id, owner_agent_id, count(*) AS n FROM wl_tasks WHERE status NOT IN ('completed', 'cancelled') GROUP BY ALL),
s AS (SELECT project_id, agent_id, arg_max(id, (started_at, id)) AS sid FROM wl_sessions WHERE state = 'active' GROUP BY ALL)
SELECT t.project_id, t.id AS team_id, coalesce(m.n, 0) AS members, 1 AS commanders, coalesce(m.n, 0) - 1 AS subagents, coalesce((SELECT n FROM o WHERE o.team_id = t.id AND o.project_id = t.project_id AND o.owner_agent_id IS NULL), 0) AS unassigned_open_tasks,
  coalesce((SELECT CAST(sum(o.n) AS BIGINT) FROM o JOIN wl_team_members x ON x.agent_id = o.owner_agent_id AND x.team_id = o.team_id WHERE o.team_id = t.id AND o.project_id = t.project_id), 0) AS open_tasks,
  coalesce((SELECT string_agg(s.sid, '|' ORDER BY x.agent_id) FROM wl_team_members x JOIN s ON s.agent_id = x.agent_id AND s.project_id = x.project_id WHERE x.team_id = t.id), '') AS sessions
FROM wl_teams t LEFT JOIN m ON m.team_id = t.id AND m.project_id = t.project_id""",
)
def _(d: Demo) -> DataFrame:
    rows = stats.team_status(d.teams, d.team_members, d.agents, d.sessions, d.tasks)
    total = F.aggregate("member_list", F.lit(0).cast("long"), lambda s, x: s + x["open_count"])
    now = F.array_join(F.transform("member_list", lambda x: x["session_id"]), "|")
    return rows.select("project_id", "team_id", "members", F.col("commanders").cast("int"), "subagents", "unassigned_open_tasks", F.coalesce(total, F.lit(0)).alias("open_tasks"), F.coalesce(now, F.lit("")).alias("sessions"))


@query(
    "d6_project_overview",
    """WITH l AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM wl_tasks WHERE status IN ('in_progress', 'review', 'blocked'))
SELECT p.id AS project_id, (SELECT count(*) FROM wl_sessions x WHERE x.project_id = p.id AND state = 'active') AS active_sessions, (SELECT count(*) FROM wl_agents x WHERE x.project_id = p.id AND status = 'active') AS active_agents, (SELECT count(*) FROM wl_tasks x WHERE x.project_id = p.id) AS tasks, (SELECT count(*) FROM wl_worktrees x WHERE x.project_id = p.id) AS worktrees,
 coalesce((SELECT string_agg(id, '|' ORDER BY r) FROM l WHERE l.project_id = p.id AND r <= 15), '') AS active_tasks, greatest(0, coalesce((SELECT max(n) FROM l WHERE l.project_id = p.id), 0) - 15) AS more_tasks FROM wl_projects p""",
)
def _(d: Demo) -> DataFrame:
    rows = stats.project_overview(d.projects, d.agents, d.tasks, d.sessions, d.worktrees)
    return rows.withColumn("active_tasks", joined("active_tasks")).drop("name")


FACTS = """SELECT t.project_id, t.id, t.status, t.owner_agent_id IS NOT NULL AS has_owner, coalesce(p.n, 0) AS open_progress, t.id IN (SELECT task_id FROM wl_sessions s WHERE s.state = 'active' AND task_id IS NOT NULL AND s.project_id = t.project_id) AS has_active_session,
  t.id IN (SELECT d.task_id FROM wl_task_dependencies d JOIN wl_tasks q ON q.id = d.prerequisite_task_id AND q.project_id = d.project_id WHERE d.kind = 'strong' AND q.status NOT IN ('completed', 'cancelled')) AS has_incomplete_prerequisite
FROM wl_tasks t LEFT JOIN (SELECT project_id, task_id, count(*) AS n FROM wl_progress_items WHERE status = 'open' GROUP BY ALL) p ON p.task_id = t.id AND p.project_id = t.project_id"""


def _facts(d: Demo) -> DataFrame:
    return stats.task_facts(d.tasks, d.progress_items, d.sessions, d.task_dependencies)


@query("d7_task_facts", FACTS)
def _(d: Demo) -> DataFrame:
    return _facts(d)


@query("d8_busy_agents", "SELECT project_id, owner_agent_id AS agent_id, count(*) AS open_tasks FROM wl_tasks WHERE status NOT IN ('completed', 'cancelled') AND owner_agent_id IS NOT NULL GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    return stats.busy_agents(d.tasks)


# Latest rows and numbering


@query("e1_latest_checkpoints", "SELECT id, task_id, created_at FROM wl_checkpoints QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY created_at DESC, id DESC) = 1")
def _(d: Demo) -> DataFrame:
    return latest.latest_checkpoints(d.checkpoints).select("id", "task_id", "created_at")


@query("e2_recent_events", "SELECT id, task_id, type FROM wl_events QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY occurred_at DESC, id DESC) <= 10")
def _(d: Demo) -> DataFrame:
    return latest.recent_events(d.log).select("id", "task_id", "type")


@query("e3_current_session", "SELECT project_id, agent_id, arg_max(id, (started_at, id)) AS session_id FROM wl_sessions WHERE state = 'active' GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    return latest.current_session(d.sessions)


@query("e4_rebuild_session", "SELECT c.project_id, arg_max(c.session_id, (c.created_at, c.id)) AS session_id FROM wl_checkpoints c JOIN wl_tasks t ON t.id = c.task_id WHERE t.priority = 'high' AND c.session_id IS NOT NULL GROUP BY 1")
def _(d: Demo) -> DataFrame:
    return latest.rebuild_session(d.checkpoints, d.tasks.filter("priority = 'high'"))


@query("e5_positions", "WITH old AS (SELECT task_id, max(position) AS m FROM wl_progress_items WHERE type = 'todo' GROUP BY 1) SELECT p.id, CAST(coalesce(o.m, -1) + row_number() OVER (PARTITION BY p.task_id ORDER BY p.created_at, p.id) AS INT) AS position FROM wl_progress_items p LEFT JOIN old o ON o.task_id = p.task_id WHERE p.type = 'risk'")
def _(d: Demo) -> DataFrame:
    new = d.progress_items.filter("type = 'risk'").select("project_id", "task_id", "id", "created_at")
    return latest.assign_positions(new, d.progress_items.filter("type = 'todo'")).select("id", "position")


@query("e6_display_ids", "SELECT id, concat('TSK-', CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END) AS display_id FROM (SELECT id, row_number() OVER (PARTITION BY project_id, priority ORDER BY id) + CASE WHEN project_id = 'P1' THEN 499 ELSE 0 END AS n FROM wl_tasks)")
def _(d: Demo) -> DataFrame:
    new = d.tasks.select("project_id", F.col("priority").alias("kind"), "id", F.lit("TSK").alias("prefix"))
    kinds = new.select("project_id", "kind").distinct().filter("project_id = 'P1'").withColumn("next_value", F.lit(500))
    return latest.allocate_display_ids(new, kinds).select("id", "display_id")


@query("e7_reorder", "SELECT id, CASE WHEN position % 2 = 0 THEN 100 - position ELSE position END AS position FROM wl_progress_items")
def _(d: Demo) -> DataFrame:
    order = d.progress_items.filter("position % 2 = 0").select("project_id", "task_id", "id", (100 - F.col("position")).alias("new_position"))
    return latest.reorder(d.progress_items, order).select("id", "position")


@query("e8_corrected_checkpoints", "SELECT id, CASE WHEN CAST(substr(id, 11) AS INT) % 3 = 0 THEN 'fixed twice' ELSE role END AS done, CASE WHEN CAST(substr(id, 11) AS INT) % 3 = 0 THEN 'kept' ELSE 'base' END AS notes FROM wl_checkpoints")
def _(d: Demo) -> DataFrame:
    lists = {f: F.array(F.col("role") if f == "done" else F.lit("base")) for f in latest.LIST_FIELDS}
    cp = d.checkpoints.withColumns(lists)
    hit = d.checkpoints.filter("CAST(substr(id, 11) AS INT) % 3 = 0")
    corr = None
    for n, (done, notes) in enumerate([("fixed once", "kept"), ("fixed twice", None)]):
        fields = {f: F.lit(None).cast("array<string>") for f in latest.LIST_FIELDS} | {"done": F.array(F.lit(done))}
        if notes:
            fields["notes"] = F.array(F.lit(notes))
        rows = hit.select(F.concat(F.lit(f"R{n}-"), "id").alias("id"), F.col("id").alias("checkpoint_id"), "project_id", F.lit(datetime(2002, 1, 1 + n)).cast("timestamp_ntz").alias("corrected_at"), *[v.alias(f) for f, v in fields.items()])
        corr = rows if corr is None else corr.unionByName(rows)
    return latest.corrected_checkpoints(cp, corr).select("id", joined("done").alias("done"), joined("notes").alias("notes"))


# Dependencies and graph


@query("f1_would_cycle", "SELECT project_id, prerequisite_task_id AS task_id, task_id AS prerequisite_task_id, 'cycle' AS verdict FROM wl_task_dependencies UNION ALL SELECT project_id, task_id, prerequisite_task_id, 'ok' FROM wl_task_dependencies UNION ALL SELECT project_id, task_id, task_id, 'self_dependency' FROM wl_task_dependencies")
def _(d: Demo) -> DataFrame:
    e = stored(d.task_dependencies.select("project_id", "task_id", "prerequisite_task_id"), "dependencies")
    back = e.select("project_id", F.col("prerequisite_task_id").alias("task_id"), F.col("task_id").alias("prerequisite_task_id"))
    own = e.select("project_id", "task_id", F.col("task_id").alias("prerequisite_task_id"))
    return deps.would_cycle(e, back.unionByName(e.select(*back.columns)).unionByName(own))


#: Each customer's orders are a chain; a third of its links and a link from its first order to its last are asked for, in a mixed order.
CHAINS = "SELECT project_id, id AS task_id, before AS prerequisite_task_id, number, CASE WHEN number % 3 = 0 THEN number * 7919 % 10007 + number / CAST(1000000000 AS DOUBLE) END AS turn FROM (SELECT id, project_id, number, lag(id) OVER (PARTITION BY customer_id ORDER BY created_at, id) AS before FROM"
BACK = "SELECT min(project_id) AS project_id, min_by(id, struct(created_at, id)) AS task_id, max_by(id, struct(created_at, id)) AS prerequisite_task_id, CAST(count(*) * 1009 % 10007 AS DOUBLE) + 0.5 AS turn FROM"


@query(
    "f1_in_order",
    f"""WITH c AS ({CHAINS} wl_tasks) x WHERE before IS NOT NULL), t AS (SELECT id, customer_id FROM wl_tasks),
f AS (SELECT c.*, t.customer_id FROM c JOIN t ON t.id = c.task_id),
b AS (SELECT customer_id, min(project_id) AS project_id, arg_min(id, (created_at, id)) AS task_id, arg_max(id, (created_at, id)) AS prerequisite_task_id, CAST(count(*) * 1009 % 10007 AS DOUBLE) + 0.5 AS turn FROM wl_tasks GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT customer_id, max(turn) AS last FROM f WHERE turn IS NOT NULL GROUP BY 1)
SELECT b.project_id, b.task_id, b.prerequisite_task_id, CASE WHEN coalesce(m.last, 0) < b.turn THEN 'cycle' ELSE 'ok' END AS verdict FROM b LEFT JOIN m USING (customer_id)
UNION ALL SELECT f.project_id, f.task_id, f.prerequisite_task_id, CASE WHEN f.turn = m.last AND b.turn < f.turn THEN 'cycle' ELSE 'ok' END FROM f JOIN b USING (customer_id) JOIN m USING (customer_id) WHERE f.turn IS NOT NULL""",
)
def _(d: Demo) -> DataFrame:
    links = stored(d.spark.sql(f"{CHAINS} {{t}}) x WHERE before IS NOT NULL", t=d.tasks), "order-links")
    back = d.spark.sql(f"{BACK} {{t}} GROUP BY customer_id HAVING count(*) > 1", t=d.tasks)
    columns = ["project_id", "task_id", "prerequisite_task_id"]
    asked = links.filter("turn IS NOT NULL").select(*columns, "turn").unionByName(stored(back, "back-links"))
    return deps.would_cycle_in_order(links.filter("turn IS NULL").select(*columns), asked, "turn").select(*columns, "verdict")


@query("f2_incomplete", "SELECT d.project_id, d.task_id, d.prerequisite_task_id, q.status FROM wl_task_dependencies d JOIN wl_tasks q ON q.id = d.prerequisite_task_id AND q.project_id = d.project_id WHERE d.kind = 'strong' AND q.status NOT IN ('completed', 'cancelled')")
def _(d: Demo) -> DataFrame:
    return deps.incomplete_prerequisites(d.task_dependencies, d.tasks)


@query(
    "f3_propagate_unblocked",
    """WITH now AS (SELECT project_id, id, CASE WHEN status = 'review' THEN 'completed' ELSE status END AS status FROM wl_tasks)
SELECT t.project_id, t.id, 'ready' AS status, max(d.prerequisite_task_id) AS unblocked_by FROM wl_tasks t JOIN wl_task_dependencies d ON d.task_id = t.id AND d.kind = 'strong' JOIN wl_tasks c ON c.id = d.prerequisite_task_id AND c.status = 'review'
WHERE t.status = 'planned' AND t.owner_agent_id IS NULL AND NOT EXISTS (SELECT 1 FROM wl_task_dependencies e JOIN now n ON n.id = e.prerequisite_task_id AND n.project_id = e.project_id WHERE e.task_id = t.id AND e.kind = 'strong' AND n.status NOT IN ('completed', 'cancelled')) GROUP BY ALL""",
)
def _(d: Demo) -> DataFrame:
    return deps.propagate_unblocked(d.tasks, d.task_dependencies, d.tasks.filter("status = 'review'"))


@query("f4_demote", "SELECT t.id, CASE WHEN t.status = 'ready' AND t.owner_agent_id IS NULL AND EXISTS (SELECT 1 FROM wl_task_dependencies d JOIN wl_tasks p ON p.id = d.prerequisite_task_id AND p.project_id = d.project_id WHERE d.task_id = t.id AND d.kind = 'strong' AND p.status <> 'completed') THEN 'planned' ELSE t.status END AS status FROM wl_tasks t")
def _(d: Demo) -> DataFrame:
    return deps.demote_on_new_dependency(d.tasks, d.task_dependencies).select("id", "status")


@query("f5_neighbourhood", "SELECT DISTINCT id, node_type FROM wl_graph_nodes WHERE id IN (SELECT source_id FROM wl_graph_edges WHERE target_id IN ('supplier-3', 'supplier-5') UNION SELECT target_id FROM wl_graph_edges WHERE target_id IN ('supplier-3', 'supplier-5') OR source_id = 'part-7' UNION SELECT source_id FROM wl_graph_edges WHERE source_id = 'part-7')")
def _(d: Demo) -> DataFrame:
    ids = d.graph_nodes.filter(F.col("id").isin("supplier-3", "supplier-5", "part-7"))
    return graph.neighbourhood(d.graph_nodes, d.graph_edges, ids)[0].select("id", "node_type")


@query("f6_filter_graph", "SELECT e.source_id, e.target_id, e.relation_type FROM wl_graph_edges e WHERE e.source_id IN (SELECT id FROM wl_graph_nodes WHERE node_type = 'file') OR e.target_id IN (SELECT id FROM wl_graph_nodes WHERE node_type = 'file')")
def _(d: Demo) -> DataFrame:
    return graph.filter_graph(d.graph_nodes, d.graph_edges, "file")[1].select("source_id", "target_id", "relation_type")


@query(
    "f7_focus_subgraph",
    """WITH u AS (SELECT source_id AS a, target_id AS b FROM wl_graph_edges UNION SELECT target_id, source_id FROM wl_graph_edges), one AS (SELECT 'part-7' AS id UNION SELECT b FROM u WHERE a = 'part-7'), two AS (SELECT id FROM one UNION SELECT u.b FROM u JOIN one ON one.id = u.a)
SELECT source_id, target_id, relation_type FROM wl_graph_edges WHERE source_id IN (SELECT id FROM two) AND target_id IN (SELECT id FROM two)""",
)
def _(d: Demo) -> DataFrame:
    return graph.focus_subgraph(d.graph_nodes, d.graph_edges, "part-7", 2)[1].select("source_id", "target_id", "relation_type")


#: Two projects, one with the dependencies alone.
TWO_GRAPHS = "SELECT source_id, target_id, project_id, relation_type FROM {0} UNION ALL SELECT source_id, target_id, 'P1', relation_type FROM {0} WHERE relation_type = 'depends_on'"
#: By id, by the end of several names, without a node, by name, without steps.
FOCI = "SELECT * FROM VALUES ('P0', 'part-7', 2), ('P0', '/10', 1), ('P0', 'no such node', 1), ('P1', 'no such node', 3), ('P1', 'supplier-3', 1), ('P0', 'supplier-5', 0) AS f(project_id, focus, depth)"


@query(
    "f7_foci",
    f"""WITH n AS (SELECT id, name, project_id FROM wl_graph_nodes UNION ALL SELECT id, name, 'P1' FROM wl_graph_nodes), e AS ({TWO_GRAPHS.format("wl_graph_edges")}),
u AS (SELECT project_id, source_id AS a, target_id AS b FROM e UNION SELECT project_id, target_id, source_id FROM e), f AS ({FOCI.replace("FROM VALUES", "FROM (VALUES").replace(" AS f(", ") AS f(")}),
s AS (SELECT f.project_id, focus, depth, min(id) AS id FROM f JOIN n ON n.project_id = f.project_id AND (n.id = focus OR ends_with(n.name, focus)) GROUP BY ALL),
one AS (SELECT project_id, focus, depth, id FROM s UNION SELECT s.project_id, focus, depth, b FROM s JOIN u ON u.project_id = s.project_id AND u.a = s.id WHERE depth > 0),
two AS (SELECT * FROM one UNION SELECT one.project_id, focus, depth, b FROM one JOIN u ON u.project_id = one.project_id AND u.a = one.id WHERE depth > 1)
SELECT e.project_id, x.focus, x.depth, e.source_id, e.target_id, e.relation_type FROM e JOIN two x ON x.project_id = e.project_id AND x.id = e.source_id JOIN two y ON y.project_id = e.project_id AND y.id = e.target_id AND y.focus = x.focus AND y.depth = x.depth
UNION ALL SELECT e.project_id, f.focus, f.depth, e.source_id, e.target_id, e.relation_type FROM e JOIN f ON f.project_id = e.project_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.project_id = f.project_id AND s.focus = f.focus)""",
)
def _(d: Demo) -> DataFrame:
    nodes = d.graph_nodes.unionByName(d.graph_nodes.withColumn("project_id", F.lit("P1")))
    edges = d.spark.sql(TWO_GRAPHS.format("{e}"), e=d.graph_edges)
    return graph.focus_subgraphs(nodes, edges, d.spark.sql(FOCI))[1].select("project_id", "focus", "depth", "source_id", "target_id", "relation_type")


@query("f8_module_graph", "WITH m AS (SELECT id, concat(split_part(name, '/', 1), '/', split_part(name, '/', 2)) AS module FROM wl_graph_nodes) SELECT DISTINCT s.module AS source, t.module AS target, e.relation_type FROM wl_graph_edges e JOIN m s ON s.id = e.source_id JOIN m t ON t.id = e.target_id WHERE s.module <> t.module")
def _(d: Demo) -> DataFrame:
    return graph.module_graph(d.graph_nodes, d.graph_edges)[1].select("source", "target", "relation_type")


@query("f9_extract_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#?]+)', 1)) AS target FROM pages""")
def _(d: Demo) -> DataFrame:
    files = d["pages"].select(F.lit("P0").alias("project_id"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return graph.extract_imports(files, graph.HREF).select(F.col("path").cast("long").alias("page_id"), "target")


#: A Rust and a script file for each part, with imports that name other parts; chr(39) and chr(34) are quotes.
SOURCES = """SELECT 'P0' AS project_id, concat('src/part', CAST(p_partkey AS STRING), '.rs') AS path,
  concat('pub mod m', CAST(p_size AS STRING), ';', chr(10), '  use crate::a::b', CAST(p_partkey % 7 AS STRING), '::Thing;', chr(10), '// use crate::no', chr(10), 'mod m', CAST(p_size AS STRING), ';', chr(10)) AS content FROM {part}
UNION ALL SELECT 'P0', concat('web/part', CAST(p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.jsx' ELSE '.txt' END),
  concat('import y from ', chr(39), './lib', CAST(p_size AS STRING), '.ts', chr(39), chr(10), 'const z = require(', chr(34), 'util', CAST(p_partkey % 5 AS STRING), chr(34), ')') FROM {part}"""


@query(
    "f9_source_imports",
    """SELECT concat('src/part', p_partkey, '.rs') AS path, unnest([concat('m', p_size, '.rs'), concat('m', p_size, '/mod.rs'), concat('src/a/b', p_partkey % 7, '/Thing.rs')]) AS target FROM part
UNION ALL SELECT concat('web/part', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.ts' ELSE '.jsx' END), unnest([concat('./lib', p_size, '.ts'), concat('util', p_partkey % 5)]) FROM part WHERE p_partkey % 3 < 2""",
)
def _(d: Demo) -> DataFrame:
    return graph.extract_imports(d.spark.sql(SOURCES, part=d["part"])).select("path", "target")


@query(
    "f10_resolve_imports",
    """SELECT DISTINCT concat('src/part/', CAST(l_partkey AS STRING), '.rs') AS source_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('src/supp/', CAST(l_suppkey AS STRING), '.rs') ELSE concat('src/supp/', CAST(l_suppkey AS STRING), '/mod.rs') END AS target_id
FROM lineitem WHERE (l_suppkey % 2 = 0 OR l_suppkey % 3 = 0) AND NOT (l_suppkey % 2 = 0 AND l_partkey % 5 = 0)""",
)
def _(d: Demo) -> DataFrame:
    own, other = "concat('src/part/', CAST(l_partkey AS STRING), '.rs')", "concat('src/supp/', CAST(l_suppkey AS STRING), '.rs')"
    imports = d["lineitem"].selectExpr("'P0' AS project_id", f"{own} AS path", "concat('src/supp/', CAST(l_suppkey AS STRING), '/deep/Thing.rs') AS target").distinct()
    files = d["supplier"].selectExpr("'P0' AS project_id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('src/supp/', CAST(s_suppkey AS STRING), '.rs') WHEN s_suppkey % 3 = 0 THEN concat('src/supp/', CAST(s_suppkey AS STRING), '/mod.rs') END AS path").filter("path IS NOT NULL")
    old = d["lineitem"].filter("l_partkey % 5 = 0").selectExpr("'P0' AS project_id", f"{own} AS source_id", f"{other} AS target_id", "'depends_on' AS relation_type")
    return graph.resolve_imports(imports, files, old).select("source_id", "target_id")


@query("f11_changed_edges", "SELECT DISTINCT task_id AS source_id, replace(content, ' ', '-') AS target_id FROM wl_progress_items")
def _(d: Demo) -> DataFrame:
    files = F.concat(F.lit("part-"), F.substring_index("content", " ", -1))
    cp = d.progress_items.groupBy("project_id", "task_id").agg(F.collect_set(files).alias("changed_files"))
    return graph.changed_edges(cp, d.graph_nodes, d.graph_edges)[1].select("source_id", "target_id")


# State transitions

ASKED = "SELECT project_id, id, CASE number % 9 WHEN 0 THEN 'claim' WHEN 1 THEN 'release' WHEN 2 THEN 'start' WHEN 3 THEN 'block' WHEN 4 THEN 'unblock' WHEN 5 THEN 'review' WHEN 6 THEN 'complete' WHEN 7 THEN 'cancel' ELSE 'reopen' END AS action, 'A00000001' AS actor, CASE WHEN number % 2 = 0 THEN 'because' END AS reason FROM"
VERDICTS = f"""WITH f AS ({FACTS}), r AS ({ASKED} wl_tasks), x AS (SELECT r.*, f.* EXCLUDE (project_id, id), NOT f.has_incomplete_prerequisite AS deps FROM r JOIN f ON f.id = r.id),
y AS (SELECT *, CASE action
  WHEN 'claim' THEN CASE WHEN status = 'ready' AND NOT has_owner AND deps THEN 'in_progress' WHEN has_owner THEN '!TASK_ALREADY_CLAIMED' WHEN NOT deps THEN '!DEPENDENCY_INCOMPLETE' END
  WHEN 'release' THEN CASE WHEN has_active_session THEN '!STATE_CONFLICT' WHEN status IN ('in_progress', 'blocked', 'review') THEN CASE WHEN deps THEN 'ready' ELSE 'planned' END END
  WHEN 'start' THEN CASE WHEN status = 'in_progress' OR status IN ('ready', 'planned') AND deps THEN 'in_progress' WHEN NOT deps THEN '!DEPENDENCY_INCOMPLETE' END
  WHEN 'block' THEN CASE WHEN reason IS NULL THEN '!VALIDATION_FAILED' WHEN status IN ('in_progress', 'ready', 'planned', 'review') THEN 'blocked' END
  WHEN 'unblock' THEN CASE WHEN status IN ('blocked', 'planned') THEN CASE WHEN NOT deps THEN '!DEPENDENCY_INCOMPLETE' WHEN has_owner THEN 'in_progress' ELSE 'ready' END END
  WHEN 'review' THEN CASE WHEN status = 'in_progress' THEN 'review' END
  WHEN 'complete' THEN CASE WHEN status IN ('review', 'in_progress') THEN CASE WHEN open_progress > 0 THEN '!STATE_CONFLICT' ELSE 'completed' END END
  WHEN 'cancel' THEN CASE WHEN status NOT IN ('completed', 'cancelled') THEN CASE WHEN reason IS NULL THEN '!VALIDATION_FAILED' ELSE 'cancelled' END END
  ELSE CASE WHEN status IN ('completed', 'cancelled') THEN CASE WHEN deps THEN 'ready' ELSE 'planned' END END END AS v FROM x)
SELECT project_id, id, action, status AS old_status, CASE WHEN v NOT LIKE '!%' THEN v END AS new_status, CASE WHEN v IS NULL THEN 'INVALID_TASK_TRANSITION' WHEN v LIKE '!%' THEN substr(v, 2) END AS denial,
  CASE WHEN v NOT LIKE '!%' THEN CASE action WHEN 'claim' THEN 'actor' WHEN 'release' THEN 'clear' WHEN 'cancel' THEN 'clear' WHEN 'reopen' THEN 'clear' ELSE 'keep' END END AS owner FROM y"""


def _verdicts(d: Demo) -> DataFrame:
    return transitions.evaluate_transitions(d.spark.sql(f"{ASKED} {{t}}", t=d.tasks), _facts(d), strict=True)


@query("h1_transitions", VERDICTS)
def _(d: Demo) -> DataFrame:
    return _verdicts(d).select("project_id", "id", "action", "old_status", "new_status", "denial", "owner")


@query("h2_initial_status", "SELECT t.id, CASE WHEN NOT held OR t.number % 3 > 0 THEN CASE WHEN held OR t.number % 3 = 1 THEN 'planned' ELSE 'ready' END END AS status, CASE WHEN held AND t.number % 3 = 0 THEN 'DEPENDENCY_INCOMPLETE' END AS denial FROM (SELECT t.*, EXISTS (SELECT 1 FROM wl_task_dependencies d LEFT JOIN wl_tasks p ON p.id = d.prerequisite_task_id AND p.project_id = d.project_id WHERE d.task_id = t.id AND coalesce(p.status, '') <> 'completed') AS held FROM wl_tasks t) t")
def _(d: Demo) -> DataFrame:
    new = d.tasks.selectExpr("project_id", "id", "CASE number % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'planned' END AS requested")
    return transitions.initial_status(new, d.task_dependencies, d.tasks).select("id", "status", "denial")


@query("h3_session_moves", "SELECT id, state AS current, CASE WHEN state = 'active' OR state IN ('paused', 'stale') AND length(id) % 2 = 0 THEN 'allowed' WHEN state = 'paused' THEN 'denied' ELSE 'denied' END AS verdict FROM (SELECT id, state, CASE WHEN length(id) % 2 = 0 THEN 'abandoned' ELSE 'stale' END AS target FROM wl_sessions)")
def _(d: Demo) -> DataFrame:
    asked = d.sessions.selectExpr("project_id", "id", "CASE WHEN length(id) % 2 = 0 THEN 'abandoned' ELSE 'stale' END AS target")
    return transitions.evaluate_session_moves(asked, d.sessions).select("id", "current", "verdict")


@query("h4_progress_moves", "SELECT id, status AS current, CASE WHEN status = 'open' OR status = 'completed' AND position % 2 = 1 THEN 'allowed' ELSE 'denied' END AS verdict FROM wl_progress_items")
def _(d: Demo) -> DataFrame:
    asked = d.progress_items.selectExpr("project_id", "id", "CASE WHEN position % 2 = 0 THEN 'completed' ELSE 'removed' END AS target")
    return transitions.evaluate_progress_moves(asked, d.progress_items).select("id", "current", "verdict")


@query(
    "h5_apply_status",
    f"""WITH v AS ({VERDICTS}) SELECT t.id, coalesce(v.new_status, t.status) AS status, CASE WHEN v.new_status = 'in_progress' THEN coalesce(t.started_at, TIMESTAMP '2001-09-01') ELSE t.started_at END AS started_at,
  CASE WHEN v.new_status IS NULL THEN t.completed_at WHEN v.new_status = 'completed' THEN TIMESTAMP '2001-09-01' END AS completed_at, CASE v.owner WHEN 'actor' THEN 'A00000001' WHEN 'clear' THEN NULL ELSE t.owner_agent_id END AS owner_agent_id FROM wl_tasks t LEFT JOIN v ON v.id = t.id""",
)
def _(d: Demo) -> DataFrame:
    return transitions.apply_task_status(d.tasks, _verdicts(d), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "started_at", "completed_at", "owner_agent_id")


@query("h6_mark_stale", "SELECT id, CASE WHEN state = 'active' AND last_activity_at < TIMESTAMP '2024-01-15' THEN 'stale' ELSE state END AS state, CASE WHEN state = 'active' AND last_activity_at < TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-01-15 02:00:00' ELSE ended_at END AS ended_at FROM wl_sessions")
def _(d: Demo) -> DataFrame:
    return transitions.mark_stale(d.sessions, F.lit(datetime(2024, 1, 15, 2)).cast("timestamp_ntz")).select("id", "state", "ended_at")


@query("h7_supersede_sessions", "SELECT id, CASE WHEN state = 'active' AND n IS NOT NULL THEN 'ended' ELSE state END AS state, CASE WHEN state = 'active' AND n IS NOT NULL THEN a ELSE ended_at END AS ended_at, CASE WHEN state = 'active' THEN n END AS superseded_by FROM (SELECT *, lead(id) OVER w AS n, lead(started_at) OVER w AS a FROM wl_sessions WINDOW w AS (PARTITION BY project_id, agent_id, worktree_id ORDER BY started_at, id))")
def _(d: Demo) -> DataFrame:
    return transitions.supersede_sessions(d.sessions).select("id", "state", "ended_at", "superseded_by")


@query("h8_emit_events", f"""WITH v AS ({VERDICTS}), r AS ({ASKED} wl_tasks) SELECT v.id AS task_id, concat('task.', CASE v.action WHEN 'claim' THEN 'claimed' WHEN 'release' THEN 'released' WHEN 'start' THEN 'started' WHEN 'block' THEN 'blocked' WHEN 'unblock' THEN 'unblocked' WHEN 'review' THEN 'reviewed' WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'reopened' END) AS type, concat('{{"beforeStatus":"', v.old_status, '","afterStatus":"', v.new_status, '"', CASE WHEN r.reason IS NULL THEN '' ELSE ',"reason":"because"' END, '}}') AS payload_json FROM v JOIN r ON r.id = v.id WHERE v.new_status IS NOT NULL""")
def _(d: Demo) -> DataFrame:
    return transitions.emit_events(_verdicts(d), F.lit(NOW).cast("timestamp_ntz")).select("task_id", "type", "payload_json")


ORDERED_ASKED = "SELECT project_id, task_id AS id, CASE number % 9 WHEN 0 THEN 'claim' WHEN 1 THEN 'release' WHEN 2 THEN 'start' WHEN 3 THEN 'block' WHEN 4 THEN 'unblock' WHEN 5 THEN 'review' WHEN 6 THEN 'complete' WHEN 7 THEN 'cancel' ELSE 'reopen' END AS action, concat('A', lpad(CAST(number % 50 AS STRING), 8, '0')) AS actor, CASE WHEN number % 2 = 0 THEN 'because' END AS reason, created_at AS asked_at, id AS request FROM (SELECT *, CAST(split_part(content, ' ', 2) AS BIGINT) AS number FROM"
#: Each request of a task finds what the one before it has left.
ORDERED = f"""WITH RECURSIVE f AS MATERIALIZED ({FACTS}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY asked_at, request) AS k FROM ({ORDERED_ASKED} wl_progress_items) x) y),
w AS (SELECT project_id, id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS old_status, status, has_owner, CAST(NULL AS VARCHAR) AS v FROM f UNION ALL
  SELECT project_id, id, k, status, CASE WHEN v IS NULL OR v LIKE '!%' THEN status ELSE v END, CASE WHEN v IS NULL OR v LIKE '!%' THEN has_owner WHEN action = 'claim' THEN true WHEN action IN ('release', 'cancel', 'reopen') THEN false ELSE has_owner END, v
  FROM (SELECT r.project_id, r.id, r.k, r.action, w.status, w.has_owner, CASE r.action
    WHEN 'claim' THEN CASE WHEN w.status = 'ready' AND NOT w.has_owner AND NOT f.has_incomplete_prerequisite THEN 'in_progress' WHEN w.has_owner THEN '!TASK_ALREADY_CLAIMED' WHEN f.has_incomplete_prerequisite THEN '!DEPENDENCY_INCOMPLETE' END
    WHEN 'release' THEN CASE WHEN f.has_active_session THEN '!STATE_CONFLICT' WHEN w.status IN ('in_progress', 'blocked', 'review') THEN CASE WHEN f.has_incomplete_prerequisite THEN 'planned' ELSE 'ready' END END
    WHEN 'start' THEN CASE WHEN w.status = 'in_progress' OR w.status IN ('ready', 'planned') AND NOT f.has_incomplete_prerequisite THEN 'in_progress' WHEN f.has_incomplete_prerequisite THEN '!DEPENDENCY_INCOMPLETE' END
    WHEN 'block' THEN CASE WHEN r.reason IS NULL THEN '!VALIDATION_FAILED' WHEN w.status IN ('in_progress', 'ready', 'planned', 'review') THEN 'blocked' END
    WHEN 'unblock' THEN CASE WHEN w.status IN ('blocked', 'planned') THEN CASE WHEN f.has_incomplete_prerequisite THEN '!DEPENDENCY_INCOMPLETE' WHEN w.has_owner THEN 'in_progress' ELSE 'ready' END END
    WHEN 'review' THEN CASE WHEN w.status = 'in_progress' THEN 'review' END
    WHEN 'complete' THEN CASE WHEN w.status IN ('review', 'in_progress') THEN 'completed' END
    WHEN 'cancel' THEN CASE WHEN w.status NOT IN ('completed', 'cancelled') THEN CASE WHEN r.reason IS NULL THEN '!VALIDATION_FAILED' ELSE 'cancelled' END END
    ELSE CASE WHEN w.status IN ('completed', 'cancelled') THEN CASE WHEN f.has_incomplete_prerequisite THEN 'planned' ELSE 'ready' END END END AS v
    FROM w JOIN r ON r.project_id = w.project_id AND r.id = w.id AND r.k = w.k + 1 JOIN f ON f.project_id = w.project_id AND f.id = w.id) y),
o AS (SELECT r.*, w.old_status, w.status, CASE WHEN w.v NOT LIKE '!%' THEN w.v END AS new_status, CASE WHEN w.v IS NULL THEN 'INVALID_TASK_TRANSITION' WHEN w.v LIKE '!%' THEN substr(w.v, 2) END AS denial,
  CASE WHEN w.v NOT LIKE '!%' THEN CASE r.action WHEN 'claim' THEN 'actor' WHEN 'release' THEN 'clear' WHEN 'cancel' THEN 'clear' WHEN 'reopen' THEN 'clear' ELSE 'keep' END END AS owner FROM r JOIN w USING (project_id, id, k))"""


def _ordered(d: Demo) -> DataFrame:
    asked = d.spark.sql(f"{ORDERED_ASKED} {{p}}) x", p=d.progress_items).withColumnRenamed("asked_at", "at")
    return transitions.evaluate_in_order(asked, _facts(d))


@query("h1_ordered_transitions", f"{ORDERED} SELECT project_id, id, request, action, old_status, new_status, denial, owner FROM o")
def _(d: Demo) -> DataFrame:
    return _ordered(d).select("project_id", "id", "request", "action", "old_status", "new_status", "denial", "owner")


@query(
    "h5_apply_ordered",
    f"""{ORDERED}, l AS (SELECT project_id, id, max(k) AS last, max(k) FILTER (WHERE owner IN ('actor', 'clear')) AS owning, bool_or(new_status = 'in_progress') AS begun FROM o WHERE new_status IS NOT NULL GROUP BY ALL)
SELECT t.id, coalesce(e.new_status, t.status) AS status, CASE WHEN l.begun THEN coalesce(t.started_at, TIMESTAMP '2001-09-01') ELSE t.started_at END AS started_at, CASE WHEN l.last IS NULL THEN t.completed_at WHEN e.new_status = 'completed' THEN TIMESTAMP '2001-09-01' END AS completed_at,
  CASE WHEN l.owning IS NULL THEN t.owner_agent_id WHEN g.owner = 'actor' THEN g.actor END AS owner_agent_id
FROM wl_tasks t LEFT JOIN l ON l.project_id = t.project_id AND l.id = t.id LEFT JOIN o e ON e.project_id = l.project_id AND e.id = l.id AND e.k = l.last LEFT JOIN o g ON g.project_id = l.project_id AND g.id = l.id AND g.k = l.owning""",
)
def _(d: Demo) -> DataFrame:
    return transitions.apply_task_status(d.tasks, _ordered(d), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "started_at", "completed_at", "owner_agent_id")


@query("h8_ordered_events", f"{ORDERED} SELECT project_id, id AS task_id, count(*) AS events, count(*) AS identifiers, min(concat(action, old_status, new_status)) AS least FROM o WHERE new_status IS NOT NULL GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    events = transitions.emit_events(_ordered(d), F.lit(NOW).cast("timestamp_ntz"))
    actions = F.create_map(*[F.lit(x) for action, event in transitions.ACTION_EVENTS.items() for x in (event, action)])
    said = F.concat(actions[F.col("type")], F.get_json_object("payload_json", "$.beforeStatus"), F.get_json_object("payload_json", "$.afterStatus"))
    return events.groupBy("project_id", "task_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("identifiers"), F.min(said).alias("least"))


REPLAY = """SELECT project_id, task_id, arg_max(CASE WHEN type IN ('task.created', 'task.released', 'task.releaseed') THEN 'ready' WHEN type = 'task.claimed' THEN 'in_progress' WHEN type IN ('task.completed', 'task.completeed') THEN 'completed' ELSE 'cancelled' END, (occurred_at, id)) AS status FROM wl_events GROUP BY ALL"""


@query("h9_replay_status", f"SELECT r.*, (SELECT arg_max(CASE WHEN type = 'task.claimed' THEN actor_agent_id ELSE '' END, (occurred_at, id)) FROM wl_events e WHERE e.task_id = r.task_id AND e.project_id = r.project_id AND type NOT IN ('task.created', 'task.completed', 'task.completeed')) AS owner FROM ({REPLAY}) r")
def _(d: Demo) -> DataFrame:
    rows = transitions.replay_status(d.log)
    touched = listing.normalise_event_types(d.log).filter("type NOT IN ('task.created', 'task.completed')").select("project_id", "task_id").distinct().withColumn("_t", F.lit(""))
    return rows.join(touched, ["project_id", "task_id"], "left").select("project_id", "task_id", "status", F.coalesce("owner", "_t").alias("owner"))


@query("h9_log_drift", f"SELECT coalesce(r.task_id, t.id) AS task_id, coalesce(r.project_id, t.project_id) AS project_id, r.status AS log_status, t.status AS stored_status FROM ({REPLAY}) r FULL JOIN wl_tasks t ON t.id = r.task_id AND t.project_id = r.project_id WHERE r.status IS DISTINCT FROM t.status")
def _(d: Demo) -> DataFrame:
    return transitions.log_drift(d.log, d.tasks)


@query("h10_upsert", "SELECT id, CASE WHEN length(id) = 3 THEN 'moved' ELSE branch END AS branch, bound_at, task_id FROM wl_worktrees UNION ALL SELECT concat('N', id), 'moved', bound_at, task_id FROM wl_worktrees WHERE length(id) = 2")
def _(d: Demo) -> DataFrame:
    base = d.worktrees.select("project_id", "normalized_path", "id", "branch", "bound_at", "task_id")
    late = base.filter("length(id) = 3").withColumn("branch", F.lit("moved"))
    early = late.withColumns({"branch": F.lit("old"), "bound_at": F.col("bound_at") - F.expr("INTERVAL '1' DAY")})
    new = base.filter("length(id) = 2").withColumns({"id": F.concat(F.lit("N"), "id"), "normalized_path": F.concat("normalized_path", F.lit("-n")), "branch": F.lit("moved")})
    merged = transitions.merge_upsert(base, late.unionByName(early).unionByName(new), ["project_id", "normalized_path"], ["branch"], "bound_at")
    return merged.select("id", "branch", "bound_at", "task_id")


@query("h11_supersede_decisions", "SELECT d.id, CASE WHEN n.id IS NOT NULL THEN n.display_id END AS superseded_by FROM wl_decisions d LEFT JOIN wl_decisions n ON n.project_id = d.project_id AND CAST(substr(n.id, 2) AS INT) = CAST(substr(d.id, 2) AS INT) + 1")
def _(d: Demo) -> DataFrame:
    following = F.format_string("DEC-%04d", F.substring("id", 2, 9).cast("int") + 1)
    pairs = d.decisions.select("project_id", F.col("id").alias("old_ref"), following.alias("new_ref"))
    return transitions.supersede_decisions(d.decisions, pairs).select("id", "superseded_by")


@query(
    "h12_handoff_moves",
    f"""WITH f AS ({FACTS}) SELECT h.id, CASE WHEN f.status = 'ready' AND NOT f.has_owner AND NOT f.has_incomplete_prerequisite OR CAST(substr(h.id, 2) AS INT) % 2 = 1 THEN 'accepted' ELSE h.state END AS state,
  CASE WHEN f.status = 'ready' AND NOT f.has_owner AND NOT f.has_incomplete_prerequisite OR CAST(substr(h.id, 2) AS INT) % 2 = 1 THEN TIMESTAMP '2001-09-01' ELSE h.accepted_at END AS accepted_at FROM wl_handoffs h JOIN f ON f.id = h.task_id""",
)
def _(d: Demo) -> DataFrame:
    asked = d.handoffs.selectExpr("project_id", "id", "'accepted' AS target", "'A00000001' AS actor", "CAST(substr(id, 2) AS INT) % 2 = 0 AS claim")
    return transitions.apply_handoff_moves(asked, d.handoffs, _facts(d), F.lit(NOW).cast("timestamp_ntz"))[0].select("id", "state", "accepted_at")


@query(
    "h12_ordered_handoffs",
    f"""WITH f AS ({FACTS}), r AS (SELECT h.project_id, h.id, h.task_id, CAST(k AS BIGINT) AS k, CASE WHEN k = 4 AND CAST(substr(h.id, 2) AS INT) % 2 = 0 THEN 'declined' ELSE 'accepted' END AS target, k < 4 AS claim FROM wl_handoffs h CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) n)
SELECT r.id, r.k, r.target, CASE WHEN r.claim THEN CASE WHEN f.status = 'ready' AND NOT f.has_owner AND NOT f.has_incomplete_prerequisite THEN CASE WHEN r.k > 1 THEN 'TASK_ALREADY_CLAIMED' END WHEN f.has_owner THEN 'TASK_ALREADY_CLAIMED' WHEN f.has_incomplete_prerequisite THEN 'DEPENDENCY_INCOMPLETE' ELSE 'INVALID_TASK_TRANSITION' END END AS denial,
  CASE WHEN CAST(substr(r.id, 2) AS INT) % 2 = 0 THEN 'declined' ELSE 'accepted' END AS state FROM r JOIN f ON f.id = r.task_id AND f.project_id = r.project_id""",
)
def _(d: Demo) -> DataFrame:
    number = F.substring("id", 2, 9).cast("int")
    rows = d.handoffs.select("project_id", "id", number.alias("n"), F.explode(F.array(*[F.lit(k) for k in (4, 2, 3, 1)])).alias("k"))
    asked = rows.select("project_id", "id", F.when((F.col("k") == 4) & (F.col("n") % 2 == 0), "declined").otherwise("accepted").alias("target"), F.concat(F.lit("A"), F.col("k").cast("string")).alias("actor"), (F.col("k") < 4).alias("claim"), F.lit(NOW).cast("timestamp_ntz").alias("at"), F.col("k").cast("long").alias("request"))
    moved, outcomes = transitions.apply_handoff_moves(asked, d.handoffs, _facts(d), F.lit(NOW).cast("timestamp_ntz"))
    return outcomes.join(moved.select("project_id", "id", "state"), ["project_id", "id"]).select("id", F.col("request").alias("k"), "target", "denial", "state")


# Sets


@query("j1_flatten_lists", "SELECT id, concat_ws('|', role, CASE WHEN length(text) % 2 = 0 THEN branch END, worktree_id) AS items FROM wl_checkpoints")
def _(d: Demo) -> DataFrame:
    one = lambda c, ok="true": F.expr(f"CASE WHEN {ok} AND {c} IS NOT NULL THEN array({c}) END")
    rows = d.checkpoints.select("id", one("role").alias("a"), one("branch", "char_length(text) % 2 = 0").alias("b"), one("worktree_id").alias("c"))
    return tables.flatten_lists(rows, ["a", "b", "c"]).select("id", joined("items").alias("items"))


@query("j3_changed_files", "SELECT id, list_aggregate(list_sort(list_distinct([x for x in [CASE WHEN number % 6 IN (0, 1, 2) THEN concat('src/', CAST(number AS STRING)) END, concat('docs/', CAST(number % 100 AS STRING))] if x IS NOT NULL])), 'string_agg', '|') AS changed_files FROM wl_tasks")
def _(d: Demo) -> DataFrame:
    return tables.changed_files(tables.parse_change_reports(_reports(d), "id", "report")).select("id", joined("changed_files").alias("changed_files"))


# Data quality and retention


@query("k1_row_rules", "SELECT id, unnest(['percentage', 'content']) AS rule FROM wl_progress_items WHERE percentage > 100 AND content LIKE 'part 1%' UNION ALL SELECT id, 'percentage' FROM wl_progress_items WHERE percentage > 100 AND content NOT LIKE 'part 1%' UNION ALL SELECT id, 'content' FROM wl_progress_items WHERE percentage <= 100 AND content LIKE 'part 1%' UNION ALL SELECT id, 'json' FROM wl_progress_items WHERE position = 3")
def _(d: Demo) -> DataFrame:
    rows = d.progress_items.withColumns({"content": F.expr("CASE WHEN content LIKE 'part 1%' THEN ' ' ELSE content END"), "payload": F.expr("CASE WHEN position = 3 THEN '{bad' ELSE '{}' END")})
    rules = {"percentage": quality.in_range("percentage", 0, 100), "content": quality.not_blank("content"), "type": quality.one_of("type", "progress_type"), "json": quality.valid_json("payload")}
    return quality.check_rows(rows, rules).select("id", "rule")


@query("k2_foreign_keys", "SELECT 'labels' AS table_name, 'doc_id' AS column_name, CAST(doc_id AS STRING) AS key, count(*) AS rows FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 3 UNION ALL SELECT 'tasks', 'owner_agent_id', owner_agent_id, count(*) FROM wl_tasks WHERE owner_agent_id NOT IN (SELECT id FROM wl_agents) GROUP BY 3 UNION ALL SELECT 'tasks', 'team_id', team_id, count(*) FROM wl_tasks WHERE team_id NOT IN (SELECT id FROM wl_teams) GROUP BY 3")
def _(d: Demo) -> DataFrame:
    named = {"labels": d["labels"], "documents": d["documents"], "tasks": d.tasks, "agents": d.agents, "teams": d.teams}
    return quality.check_foreign_keys(named, [("labels", "doc_id", "documents", "doc_id"), ("tasks", "owner_agent_id", "agents", "id"), ("tasks", "team_id", "teams", "id")])


@query("k3_schema", "SELECT 'missing_table' AS problem, 'scopes' AS subject UNION ALL SELECT 'missing_column', 'agents.provider' UNION ALL SELECT 'bad_project_row', 'P3' UNION ALL SELECT DISTINCT 'no_project_row', concat('tasks:', project_id) FROM wl_tasks WHERE project_id = 'P4'")
def _(d: Demo) -> DataFrame:
    have = {"projects": d.projects.filter("id <> 'P4'"), "agents": d.agents.filter("project_id <> 'P4'"), "tasks": d.tasks}
    return quality.check_schema(have, {"projects": ["id", "name"], "agents": ["id", "provider"], "tasks": ["id"], "scopes": ["id"]})


@query("k4_unique", "SELECT project_id, task_id, count(*) AS rows FROM wl_checkpoints WHERE task_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(d: Demo) -> DataFrame:
    return quality.check_unique(d.checkpoints, ["project_id", "task_id"], F.col("task_id").isNotNull())


@query("k5_team_rules", "SELECT 'team_in_other_project' AS rule, project_id, id FROM wl_tasks WHERE team_id NOT IN (SELECT id FROM wl_teams) UNION ALL SELECT 'commander_not_member', project_id, id FROM wl_teams WHERE commander_agent_id IS NOT NULL AND commander_agent_id NOT IN (SELECT agent_id FROM wl_team_members)")
def _(d: Demo) -> DataFrame:
    return quality.check_team_rules(d.tasks, d.teams, d.team_members)


@query("k6_repairs", "SELECT id, CASE WHEN state = 'stale' THEN last_activity_at ELSE ended_at END AS repaired, 'session' AS what FROM wl_sessions UNION ALL SELECT id, NULL, coalesce(CASE WHEN team_id = 'T77' THEN NULL ELSE team_id END, 'none') FROM wl_tasks UNION ALL SELECT id, NULL, CASE WHEN trim(rationale) = '' OR rationale IS NULL THEN 'none' ELSE 'some' END FROM wl_decisions")
def _(d: Demo) -> DataFrame:
    nothing = F.lit(None).cast("timestamp_ntz").alias("repaired")
    a = quality.repair_sessions(d.sessions).select("id", F.col("ended_at").alias("repaired"), F.lit("session").alias("what"))
    b = quality.repair_tasks(d.tasks, d.teams).select("id", nothing, F.coalesce("team_id", F.lit("none")).alias("what"))
    c = quality.repair_decisions(d.decisions).select("id", nothing, F.when(F.col("rationale").isNull(), "none").otherwise("some").alias("what"))
    return a.unionByName(b).unionByName(c)


@query(
    "k7_health",
    """WITH c AS (SELECT 'orphaned_tasks' AS check_name, 'warning' AS status, id FROM wl_tasks WHERE owner_agent_id NOT IN (SELECT id FROM wl_agents) UNION ALL SELECT 'stale_sessions', 'info', id FROM wl_sessions WHERE state = 'stale' UNION ALL SELECT 'no_such', 'error', id FROM wl_tasks WHERE false),
n AS (SELECT check_name, status, count(*) AS count, array_to_string(list_sort(list(id))[1:5], '|') AS examples FROM c GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT 'no_such', 'ok', 0, '' UNION ALL SELECT 'overall', 'issues_found', 1, ''""",
)
def _(d: Demo) -> DataFrame:
    checks = {
        "orphaned_tasks": ("warning", resolve.orphaned_tasks(d.tasks, d.agents), F.col("id")),
        "stale_sessions": ("info", d.sessions.filter("state = 'stale'"), F.col("id")),
        "no_such": ("error", d.tasks.filter("status = 'no such'"), F.col("id")),
    }
    return quality.health_report(checks).withColumn("examples", joined("examples"))


@query(
    "k7_row_health",
    """WITH c AS (SELECT 'progress_content' AS check_name, 'error' AS status, id FROM wl_progress_items WHERE content LIKE 'part 1%' UNION ALL SELECT 'progress_percentage', 'warning', id FROM wl_progress_items WHERE percentage > 100 UNION ALL SELECT 'progress_source', 'info', id FROM wl_progress_items WHERE source_session_id LIKE '%7-1'
  UNION ALL SELECT 'task_owner', 'info', id FROM wl_tasks WHERE owner_agent_id IS NULL UNION ALL SELECT 'task_times', 'warning', id FROM wl_tasks WHERE status = 'completed' AND completed_at < created_at + INTERVAL '3' DAY UNION ALL SELECT 'session_end', 'error', id FROM wl_sessions WHERE state = 'ended' AND ended_at IS NULL),
n AS (SELECT check_name, status, count(*) AS count, array_to_string(list_sort(list(id))[1:5], '|') AS examples FROM c GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT 'session_end', 'ok', 0, '' UNION ALL SELECT 'overall', 'issues_found', (SELECT count(*) FROM n WHERE status <> 'info'), ''""",
)
def _(d: Demo) -> DataFrame:
    named = {"progress_items": d.progress_items, "tasks": d.tasks, "sessions": d.sessions}
    checks = {
        "progress_content": ("error", "progress_items", ~F.col("content").startswith("part 1")),
        "progress_percentage": ("warning", "progress_items", quality.in_range("percentage", 0, 100)),
        "progress_source": ("info", "progress_items", ~F.col("source_session_id").endswith("7-1")),
        "task_owner": ("info", "tasks", F.col("owner_agent_id").isNotNull()),
        "task_times": ("warning", "tasks", (F.col("status") != "completed") | (F.col("completed_at") >= F.col("created_at") + F.expr("INTERVAL 3 DAY"))),
        "session_end": ("error", "sessions", (F.col("state") != "ended") | F.col("ended_at").isNotNull()),
    }
    return quality.row_health(named, checks).withColumn("examples", joined("examples"))


GONE = "(SELECT id FROM wl_tasks WHERE status = 'completed' AND updated_at < TIMESTAMP '2001-09-01' - INTERVAL 1000 DAY)"


def _archive(d: Demo) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    named = {n: d[f"wl_{n}"] for n in ("tasks", "checkpoints", "progress_items", "scopes", "decisions", "handoffs", "task_dependencies", "sessions", "worktrees")}
    return retention.archive_completed(named, F.lit(NOW).cast("timestamp_ntz"), 1000)


@query("k8_archived", f"SELECT 'tasks' AS t, id FROM wl_tasks WHERE id IN {GONE} UNION ALL SELECT 'checkpoints', id FROM wl_checkpoints WHERE task_id IN {GONE} UNION ALL SELECT 'progress_items', id FROM wl_progress_items WHERE task_id IN {GONE} UNION ALL SELECT 'task_dependencies', id FROM wl_task_dependencies WHERE task_id IN {GONE} OR prerequisite_task_id IN {GONE}")
def _(d: Demo) -> DataFrame:
    _, archived = _archive(d)
    out = None
    for n in ("tasks", "checkpoints", "progress_items", "task_dependencies"):
        rows = archived[n].select(F.lit(n).alias("t"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("k8_kept", f"SELECT 'sessions' AS t, id, CASE WHEN NOT EXISTS (SELECT 1 FROM wl_tasks t WHERE t.id IN {GONE} AND t.id = s.task_id AND t.project_id = s.project_id) THEN task_id END AS task_id FROM wl_sessions s UNION ALL SELECT 'scopes', id, task_id FROM wl_scopes WHERE task_id NOT IN {GONE} UNION ALL SELECT 'task_dependencies', id, task_id FROM wl_task_dependencies WHERE task_id NOT IN {GONE} AND prerequisite_task_id NOT IN {GONE}")
def _(d: Demo) -> DataFrame:
    kept, _ = _archive(d)
    out = None
    for n in ("sessions", "scopes", "task_dependencies"):
        rows = kept[n].select(F.lit(n).alias("t"), "id", "task_id")
        out = rows if out is None else out.unionByName(rows)
    return out


CHILD_TABLES = ("checkpoints", "progress_items", "scopes", "decisions", "handoffs")
RETIRED = (
    f"SELECT 'archived' AS side, 'tasks' AS t, id, parent_task_id AS link FROM wl_tasks WHERE id IN {GONE} UNION ALL SELECT 'archived', 'task_dependencies', id, task_id FROM wl_task_dependencies WHERE task_id IN {GONE} OR prerequisite_task_id IN {GONE}"
    + "".join(f" UNION ALL SELECT 'archived', '{n}', id, task_id FROM wl_{n} WHERE task_id IN {GONE} UNION ALL SELECT 'kept', '{n}', id, task_id FROM wl_{n} WHERE task_id NOT IN {GONE}" for n in CHILD_TABLES)
    + f" UNION ALL SELECT 'kept', 'tasks', id, parent_task_id FROM wl_tasks WHERE id NOT IN {GONE} UNION ALL SELECT 'kept', 'task_dependencies', id, task_id FROM wl_task_dependencies WHERE task_id NOT IN {GONE} AND prerequisite_task_id NOT IN {GONE}"
    + "".join(f" UNION ALL SELECT 'kept', '{n}', id, CASE WHEN NOT EXISTS (SELECT 1 FROM wl_tasks t WHERE t.id IN {GONE} AND t.id = s.task_id AND t.project_id = s.project_id) THEN task_id END FROM wl_{n} s" for n in ("sessions", "worktrees"))
)


@query("a8_retired", RETIRED)
def _(d: Demo) -> DataFrame:
    """All nine tables, written, retired twice under one name, and read back."""
    base, folder = shared_folder(d.spark, "live-tables"), shared_folder(d.spark, "archive")
    names = ("tasks", "task_dependencies", *CHILD_TABLES, "sessions", "worktrees")
    paths = {n: f"{base}/{n}" for n in names}
    d.keep("wl_agents")
    for n, path in paths.items():
        d[f"wl_{n}"].write.parquet(path)
        d.built[f"wl_{n}"] = d.spark.read.parquet(path)  # most other views are joins with the tasks, which come first
    for _ in range(2):
        retention.retire(d.spark, paths, folder, "one", F.lit(NOW).cast("timestamp_ntz"), 1000)
    link = lambda n: F.col("parent_task_id" if n == "tasks" else "task_id").alias("link")
    parts = [d.spark.read.parquet(p).select(F.lit("kept").alias("side"), F.lit(n).alias("t"), "id", link(n)) for n, p in paths.items()]
    parts += [d.spark.read.parquet(f"{folder}/{n}").select(F.lit("archived").alias("side"), F.lit(n).alias("t"), "id", link(n)) for n in names[:-2]]
    return search.union_hits(*parts)


@query("k9_prune", f"WITH o AS ({OBSERVED} wl_worktrees), s AS (SELECT id, normalized_path FROM wl_worktrees WHERE normalized_path NOT IN (SELECT normalized_path FROM o)) SELECT id, CASE WHEN worktree_id NOT IN (SELECT id FROM s) THEN worktree_id END AS worktree_id FROM wl_sessions UNION ALL SELECT concat('prune-', id), normalized_path FROM s")
def _(d: Demo) -> DataFrame:
    observed = d.spark.sql(f"{OBSERVED} {{w}}", w=d.worktrees)
    _, sessions, _, events = retention.prune_registry(d.worktrees, observed, d.sessions, d.checkpoints, F.lit(LOG_NOW).cast("timestamp_ntz"))
    return sessions.select("id", "worktree_id").unionByName(events.select("id", F.get_json_object("payload_json", "$.path").alias("worktree_id")))


# Search

CORPUS = "SELECT 'P0' AS project_id, kind, CAST(id AS STRING) AS doc_id, concat('K', lpad(CAST(id % 400 AS STRING), 10, '0')) AS task_id, body FROM (SELECT 'task' AS kind, doc_id AS id, text AS body FROM {documents} UNION ALL SELECT 'decision', item_id, text FROM {benchmark} UNION ALL SELECT 'checkpoint', conv_id * 100 + turn, text FROM {conversations} UNION ALL SELECT 'progress', page_id, html FROM {pages}) x"
ASK = [(1, "the"), (2, "of the"), (3, '"and attion"'), (4, "and NOT the"), (5, "thand* OR que"), (6, "la-de"), (7, "OR"), (8, '"open'), (9, "and and"), (10, "nothingatallmatches")]


def _search(d: Demo):
    corpus = d.spark.sql(CORPUS, documents=d["documents"], benchmark=d["benchmark"], conversations=d["conversations"], pages=d["pages"])
    index = search.StoredIndex(d.spark, shared_folder(d.spark, "search-index"), 16).write(corpus)
    return corpus, index.postings, index.stats(), d.spark.createDataFrame(ASK, "query_id long, text string")


ACCENTS = "lower(strip_accents(unnest(regexp_extract_all(body, '[\\p{L}\\p{N}\\p{M}]+'))))"
TOKENS = f"c AS ({CORPUS.replace('{', '').replace('}', '')}), k AS (SELECT kind, doc_id, {ACCENTS} AS term, generate_subscripts(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), 1) - 1 AS pos FROM c)"


@query(
    "g1_corpus",
    """SELECT 'task' AS kind, id AS doc_id, title AS body FROM wl_tasks UNION ALL SELECT 'progress', id, content FROM wl_progress_items UNION ALL SELECT 'checkpoint', id, concat(role, ' ', branch) FROM wl_checkpoints
UNION ALL SELECT 'decision', id, concat_ws(' ', title, decision_body, rationale) FROM wl_decisions""",
)
def _(d: Demo) -> DataFrame:
    lists = d.checkpoints.withColumns({"done": F.array("role"), "remaining": F.array("branch"), "notes": F.lit(None).cast("array<string>")})
    return search.search_corpus(d.tasks, d.progress_items, lists, d.decisions).select("kind", "doc_id", "body")


@query(
    "g3_parse_queries",
    """WITH x AS (SELECT c_custkey AS query_id, lower(c_mktsegment) AS w, c_custkey % 5 AS m FROM customer)
SELECT query_id, 0 AS leaf, 0 AS group_no, false AS negated, w AS terms, m = 1 AS is_prefix FROM x WHERE m < 4 UNION ALL SELECT query_id, 2, CASE WHEN m = 2 THEN 1 ELSE 0 END, m = 3, 'other|word', false FROM x WHERE m IN (2, 3) UNION ALL SELECT query_id, 0, 0, false, '', false FROM x WHERE m = 4""",
)
def _(d: Demo) -> DataFrame:
    text = "CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat(c_mktsegment, '*') WHEN 2 THEN concat(c_mktsegment, ' OR other-word') WHEN 3 THEN concat(c_mktsegment, ' NOT \"other word\"') ELSE concat('OR ', c_mktsegment) END AS text"
    return search.parse_queries(d["customer"].selectExpr("c_custkey AS query_id", text)).select("query_id", "leaf", "group_no", "negated", F.array_join("terms", "|").alias("terms"), "is_prefix")


@query("g2_index", f"WITH {TOKENS} SELECT kind, doc_id, term, string_agg(pos, '|' ORDER BY pos) AS positions FROM k GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    _, index, _, _ = _search(d)
    return index.select("kind", "doc_id", "term", F.array_join(F.col("positions").cast("array<string>"), "|").alias("positions"))


@query(
    "g2_refresh",
    f"""WITH {TOKENS}, m AS (SELECT kind, doc_id, CAST(doc_id AS BIGINT) % 10 AS r FROM c)
SELECT k.kind, k.doc_id, term, string_agg(pos, '|' ORDER BY pos) AS positions FROM k JOIN m USING (kind, doc_id) WHERE r > 1 GROUP BY ALL
UNION ALL SELECT kind, doc_id, 'changed', '0' FROM m WHERE r = 1 UNION ALL SELECT kind, doc_id, 'record', '1' FROM m WHERE r = 1""",
)
def _(d: Demo) -> DataFrame:
    corpus = d.spark.sql(CORPUS, documents=d["documents"], benchmark=d["benchmark"], conversations=d["conversations"], pages=d["pages"])
    index = search.StoredIndex(d.spark, shared_folder(d.spark, "search-index"), 16).write(corpus)
    last = F.col("doc_id").cast("long") % 10
    index.refresh(corpus.filter(last < 2).withColumn("body", F.when(last == 1, "Chängéd record")))
    return index.postings.select("kind", "doc_id", "term", F.array_join(F.col("positions").cast("array<string>"), "|").alias("positions"))


RANKED = f"""WITH {TOKENS}, len AS (SELECT c.kind, c.doc_id, (SELECT count(*) FROM k WHERE k.kind = c.kind AND k.doc_id = c.doc_id) AS n FROM c), st AS (SELECT kind, count(*) AS docs, avg(n) AS avglen FROM len GROUP BY 1),
m AS (SELECT 1 AS query_id, 0 AS leaf, 0 AS g, false AS neg, kind, doc_id, count(*) AS f FROM k WHERE term = 'the' GROUP BY ALL
 UNION ALL SELECT 2, 0, 0, false, kind, doc_id, count(*) FROM k WHERE term = 'of' GROUP BY ALL UNION ALL SELECT 2, 1, 0, false, kind, doc_id, count(*) FROM k WHERE term = 'the' GROUP BY ALL
 UNION ALL SELECT 3, 0, 0, false, a.kind, a.doc_id, count(*) FROM k a JOIN k b ON a.kind = b.kind AND a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'and' AND b.term = 'attion' GROUP BY ALL
 UNION ALL SELECT 4, 0, 0, false, kind, doc_id, count(*) FROM k WHERE term = 'and' GROUP BY ALL UNION ALL SELECT 4, 2, 0, true, kind, doc_id, count(*) FROM k WHERE term = 'the' GROUP BY ALL
 UNION ALL SELECT 5, 0, 0, false, kind, doc_id, count(*) FROM k WHERE starts_with(term, 'thand') GROUP BY ALL UNION ALL SELECT 5, 2, 1, false, kind, doc_id, count(*) FROM k WHERE term = 'que' GROUP BY ALL
 UNION ALL SELECT 6, 0, 0, false, a.kind, a.doc_id, count(*) FROM k a JOIN k b ON a.kind = b.kind AND a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'la' AND b.term = 'de' GROUP BY ALL
 UNION ALL SELECT 9, 0, 0, false, kind, doc_id, count(*) FROM k WHERE term = 'and' GROUP BY ALL UNION ALL SELECT 9, 1, 0, false, kind, doc_id, count(*) FROM k WHERE term = 'and' GROUP BY ALL),
df AS (SELECT query_id, leaf, kind, count(*) AS df FROM m GROUP BY ALL), need AS (SELECT query_id, g, count(DISTINCT leaf) AS n FROM m WHERE NOT neg GROUP BY ALL),
ok AS (SELECT m.query_id, m.g, m.kind, m.doc_id FROM m JOIN need USING (query_id, g) GROUP BY ALL HAVING count(*) FILTER (WHERE NOT neg) = max(need.n) AND count(*) FILTER (WHERE neg) = 0)
SELECT m.query_id, m.kind, m.doc_id, round(-sum(CASE WHEN (docs - df + 0.5) / (df + 0.5) > 1 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / avglen))), 6) AS score
FROM m JOIN ok ON ok.query_id = m.query_id AND ok.g = m.g AND ok.kind = m.kind AND ok.doc_id = m.doc_id JOIN df ON df.query_id = m.query_id AND df.leaf = m.leaf AND df.kind = m.kind JOIN st ON st.kind = m.kind JOIN len ON len.kind = m.kind AND len.doc_id = m.doc_id WHERE NOT m.neg GROUP BY ALL"""


@query("g5_rank", RANKED)
def _(d: Demo) -> DataFrame:
    _, index, st, asked = _search(d)
    return search.rank(index, search.parse_queries(asked), st).select("query_id", "kind", "doc_id", (-F.round(-F.col("score"), 6)).alias("score"))


@query("g7_search", f"WITH r AS ({RANKED}), k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score, kind, doc_id) AS n FROM r), k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, kind, doc_id) AS rank FROM k1 WHERE n <= 20) SELECT query_id, rank, score FROM k2 WHERE rank <= 20")
def _(d: Demo) -> DataFrame:
    _, index, st, asked = _search(d)
    return search.search(index, st, asked, d.tasks).select("query_id", F.col("rank").cast("long"), (-F.round(-F.col("score"), 6)).alias("score"))


@query("g6_snippets")
def _(d: Demo) -> DataFrame:
    corpus, index, st, asked = _search(d)
    hits = search.search(index, st, asked, d.tasks, limit=5)
    return search.snippet(hits, corpus, search.parse_queries(asked)).select("query_id", "kind", "doc_id", "snippet")


# Streams: each runs over the files at hand, to a table in the shared folder


EVENT_TYPES = "CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'view' THEN 'task.claimed' WHEN 'click' THEN 'task.releaseed' WHEN 'purchase' THEN 'task.completeed' ELSE 'task.canceled' END"


def _stream(d: Demo) -> DataFrame:
    """The driver's events as a stream with the columns of the event log."""
    source = d["events"]
    rows = d.spark.readStream.schema(source.schema).parquet(f"{d.sf_dir}/events.parquet*")
    return rows.selectExpr(
        "concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id", "concat('P', CAST(user_id % 5 AS STRING)) AS project_id", f"{EVENT_TYPES} AS type", "'task' AS aggregate_type", "CAST(user_id AS STRING) AS aggregate_id",
        "CASE WHEN event_id % 100 = 0 THEN '{bad' ELSE props END AS payload_json", "ts AS occurred_at", "CAST(user_id AS STRING) AS actor_agent_id", "CAST(user_id AS STRING) AS session_id", "CAST(user_id AS STRING) AS task_id",
    )


def _ended(d: Demo, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    out, state = shared_folder(d.spark, name), shared_folder(d.spark, f"{name}-state")
    with streams.keyed_state(d.spark):
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return d.spark.read.schema(df.schema).parquet(out)


@query("i1_ingest", "SELECT concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id, CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'view' THEN 'task.claimed' WHEN 'click' THEN 'task.released' WHEN 'purchase' THEN 'task.completed' ELSE 'task.cancelled' END AS type FROM events WHERE event_id % 100 <> 0")
def _(d: Demo) -> DataFrame:
    out, state = shared_folder(d.spark, "ingested"), shared_folder(d.spark, "ingest-state")
    for q in streams.ingest_events(_stream(d), out, state):
        q.awaitTermination()
    return d.spark.read.parquet(out).select("id", "type")


@query("i2_running_counts", f"SELECT concat('P', CAST(user_id % 5 AS STRING)) AS project_id, {EVENT_TYPES} AS type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS events FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    return _ended(d, streams.running_event_counts(_stream(d)), "counts").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("i1_report", "SELECT count(*) AS source, count(*) FILTER (WHERE event_id % 100 = 0) AS rejected, CAST(0 AS BIGINT) AS duplicate, CAST(0 AS BIGINT) AS late, count(*) FILTER (WHERE event_id % 100 <> 0) AS good FROM events")
def _(d: Demo) -> DataFrame:
    (q,) = streams.ingest_events(_stream(d), shared_folder(d.spark, "ingested"), shared_folder(d.spark, "ingest-state"), shared_folder(d.spark, "rejected"))
    q.awaitTermination()
    return d.spark.createDataFrame([streams.ingest_report(q)], "source long, rejected long, duplicate long, late long, good long")


@query("i2_live_counts", f"SELECT concat('P', CAST(user_id % 5 AS STRING)) AS project_id, {EVENT_TYPES} AS type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS events FROM events GROUP BY ALL")
def _(d: Demo) -> DataFrame:
    out, state = shared_folder(d.spark, "live-counts"), shared_folder(d.spark, "live-counts-state")
    streams.upsert_counts(streams.running_event_counts(_stream(d)), out, state).awaitTermination()
    return d.spark.read.parquet(out).select("project_id", "type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "events")


@query(
    "i3_stale_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT CAST(user_id AS STRING) AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity_at FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""",
)
def _(d: Demo) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _ended(d, streams.detect_stale(_stream(d)), "stale").select("session_id", text("started_at"), text("last_activity_at"))


# A reason on every second event, so that cancels are both allowed and refused.
REASONED = "CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN '{\"reason\":\"r\"}' ELSE payload_json END"


@query(
    "i4_guard",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS STRING) AS task_id, concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'released' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END AS act, event_id % 2 = 0 AS reasoned,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events)),
s AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS act, CAST(NULL AS STRING) AS before, CAST(NULL AS STRING) AS after, false AS owned, CAST(NULL AS STRING) AS verdict FROM e
UNION ALL
SELECT task_id, n, id, act, before, CASE WHEN verdict <> 'allowed' THEN coalesce(before, 'ready') WHEN act IN ('created', 'released') THEN 'ready' WHEN act = 'claimed' THEN 'in_progress' ELSE act END,
  CASE WHEN verdict <> 'allowed' THEN owned WHEN act = 'claimed' THEN true WHEN act IN ('released', 'cancelled') THEN false ELSE owned END, verdict
FROM (SELECT *, CASE act WHEN 'created' THEN CASE WHEN before IS NULL THEN 'allowed' ELSE 'INVALID_TASK_TRANSITION' END
    WHEN 'claimed' THEN CASE WHEN owned THEN 'TASK_ALREADY_CLAIMED' WHEN before = 'ready' THEN 'allowed' ELSE 'INVALID_TASK_TRANSITION' END
    WHEN 'released' THEN CASE WHEN before = 'in_progress' THEN 'allowed' ELSE 'INVALID_TASK_TRANSITION' END
    WHEN 'completed' THEN CASE WHEN before = 'in_progress' THEN 'allowed' ELSE 'INVALID_TASK_TRANSITION' END
    ELSE CASE WHEN before IN ('completed', 'cancelled') THEN 'INVALID_TASK_TRANSITION' WHEN reasoned THEN 'allowed' ELSE 'VALIDATION_FAILED' END END AS verdict
  FROM (SELECT e.task_id, e.n, e.id, e.act, e.reasoned, s.owned, CASE WHEN e.act = 'created' THEN s.after ELSE coalesce(s.after, 'ready') END AS before FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1) x) y)
SELECT task_id, id, concat('task.', act) AS type, before, after, verdict FROM s WHERE n > 0""",
)
def _(d: Demo) -> DataFrame:
    events = _stream(d).withColumn("payload_json", F.expr(REASONED))
    return _ended(d, streams.guard_transitions(events, "1 hour"), "guard").select("task_id", "id", "type", "before", "after", "verdict")


SESSION_TYPES = "CASE {0} WHEN 'signup' THEN 'session.started' WHEN 'view' THEN 'session.paused' WHEN 'click' THEN 'session.resumed' WHEN 'purchase' THEN CASE WHEN {1} % 3 = 0 THEN 'session.ended' ELSE 'session.stale' END ELSE 'note.added' END"


@query(
    "i4_sessions",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS n FROM (
  SELECT CAST(user_id AS STRING) AS session_id, concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id, {SESSION_TYPES.format("event_type", "event_id")} AS type, ts FROM events WHERE event_type <> 'error' AND epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events WHERE event_type <> 'error')) x),
s AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS type, CAST(NULL AS STRING) AS before, CAST(NULL AS STRING) AS after, CAST(NULL AS STRING) AS verdict FROM e
UNION ALL
SELECT session_id, n, id, type, before, CASE WHEN verdict = 'denied' THEN coalesce(before, 'active') WHEN type IN ('session.started', 'session.resumed') THEN 'active' ELSE substr(type, 9) END, verdict
FROM (SELECT *, CASE WHEN type = 'session.started' THEN CASE WHEN before IS NULL THEN 'allowed' ELSE 'denied' END
    WHEN type = 'session.paused' THEN CASE WHEN before = 'active' THEN 'allowed' ELSE 'denied' END
    WHEN type = 'session.resumed' THEN CASE WHEN before IN ('paused', 'stale') THEN 'allowed' ELSE 'denied' END
    WHEN type = 'session.ended' THEN CASE WHEN before IN ('active', 'paused', 'stale') THEN 'allowed' ELSE 'denied' END
    ELSE CASE WHEN before = 'active' THEN 'allowed' ELSE 'denied' END END AS verdict
  FROM (SELECT e.session_id, e.n, e.id, e.type, CASE WHEN e.type = 'session.started' THEN s.after ELSE coalesce(s.after, 'active') END AS before FROM s JOIN e ON e.session_id = s.session_id AND e.n = s.n + 1) x) y)
SELECT session_id, id, type, before, after, verdict FROM s WHERE n > 0""",
)
def _(d: Demo) -> DataFrame:
    source = d.spark.readStream.schema(d["events"].schema).parquet(f"{d.sf_dir}/events.parquet*")
    moves = source.selectExpr(
        "concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id", "'P0' AS project_id", f"{SESSION_TYPES.format('event_type', 'event_id')} AS type", "ts AS occurred_at", "CAST(user_id AS STRING) AS session_id"
    )
    return _ended(d, streams.guard_sessions(moves, "1 hour"), "session-guard").select("session_id", "id", "type", "before", "after", "verdict")


# Bundles


def _tables(d: Demo) -> dict[str, DataFrame]:
    d.keep("wl_tasks")  # most other views are joins with it
    named = ("tasks", "sessions", "worktrees", "progress_items", "decisions", "teams", "team_members", "task_dependencies", "scopes", "handoffs", "graph_nodes", "graph_edges")
    lists = d.checkpoints.withColumns({"done": F.array("role"), "remaining": F.array("branch")})
    return {n: d[f"wl_{n}"] for n in named} | {"checkpoints": lists, "events": d.log}


CONTEXTS = "SELECT h.id AS ctx_id, h.project_id, h.from_agent_id AS agent_id, '/' AS cwd, h.task_id AS task_ref, g.name AS file FROM {h} h LEFT JOIN {g} g ON g.project_id = h.project_id AND g.id = concat('part-', substr(h.id, 2))"
#: The code graph with an edge from each task to the parts that its progress names.
WORK_EDGES = "SELECT project_id, source_id, target_id, relation_type FROM {edges} UNION ALL SELECT DISTINCT project_id, task_id, concat('part-', substr(content, 6)), 'changed' FROM {items}"


def _listed(name: str, *columns: str):
    """A bundle's list as one text: entries in order, columns of an entry parted by colons."""
    return F.array_join(F.transform(name, lambda r: F.concat_ws(":", *[r[c].cast("string") for c in columns])), "|").alias(name)


@query(
    "l1_resume",
    """WITH t AS (SELECT h.id AS ctx_id, h.task_id, h.project_id FROM wl_handoffs h), e AS (SELECT * FROM wl_events QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY occurred_at DESC, id DESC) <= 10)
SELECT t.ctx_id, t.task_id, k.status, (SELECT arg_max(c.id, (c.created_at, c.id)) FROM wl_checkpoints c WHERE c.task_id = t.task_id AND c.project_id = t.project_id) AS checkpoint_id,
 (SELECT string_agg(concat_ws(':', p.position, p.id, p.type, p.content), '|' ORDER BY p.position, p.id) FROM wl_progress_items p WHERE p.task_id = t.task_id AND p.status <> 'removed') AS progress,
 (SELECT string_agg(concat_ws(':', e.id, e.type), '|' ORDER BY e.occurred_at, e.id) FROM e WHERE e.task_id = t.task_id AND e.project_id = t.project_id) AS events FROM t JOIN wl_tasks k ON k.id = t.task_id""",
)
def _(d: Demo) -> DataFrame:
    tables = _tables(d)
    rows = bundles.resume_bundle(d.spark.sql(CONTEXTS, h=d.handoffs, g=d.graph_nodes), tables)
    return rows.select("ctx_id", "task_id", "task.status", F.col("checkpoint.id").alias("checkpoint_id"), _listed("progress", "position", "id", "type", "content"), _listed("events", "id", "type"))


@query(
    "l1_whole_lists",
    """WITH t AS (SELECT id AS ctx_id, task_id, project_id FROM wl_handoffs), e AS (SELECT * FROM wl_events QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY occurred_at DESC, id DESC) <= 10)
SELECT 'progress' AS list, t.ctx_id, p.id, CAST(p.position AS VARCHAR) AS place FROM t JOIN wl_progress_items p ON p.project_id = t.project_id AND p.task_id = t.task_id WHERE p.status <> 'removed'
UNION ALL SELECT 'events', t.ctx_id, e.id, e.type FROM t JOIN e ON e.project_id = t.project_id AND e.task_id = t.task_id
UNION ALL SELECT 'decisions', t.ctx_id, d.display_id, d.title FROM t JOIN wl_decisions d ON d.project_id = t.project_id AND d.task_id = t.task_id""",
)
def _(d: Demo) -> DataFrame:
    tables = _tables(d)
    lists = bundles.bundle_lists(d.handoffs.select("project_id", F.col("id").alias("ctx_id"), "task_id"), tables)
    shown = {"progress": ("id", F.col("position").cast("string")), "events": ("id", F.col("type")), "decisions": ("display_id", F.col("title"))}
    return search.union_hits(*[lists[n].select(F.lit(n).alias("list"), "ctx_id", F.col(i).alias("id"), place.alias("place")) for n, (i, place) in shown.items()])


@query(
    "l2_context",
    f"""WITH t AS (SELECT c.ctx_id, c.task_ref AS task_id, c.project_id, c.file FROM ({CONTEXTS.format(h='wl_handoffs', g='wl_graph_nodes')}) c), e AS (SELECT * FROM wl_events WHERE occurred_at >= TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY occurred_at DESC, id DESC) <= 10),
w AS ({WORK_EDGES.format(edges='wl_graph_edges', items='wl_progress_items')}), own AS (SELECT t.ctx_id, t.project_id, g.id FROM t JOIN wl_graph_nodes g ON g.project_id = t.project_id AND g.name = t.file AND g.node_type = 'file'),
starts AS (SELECT ctx_id, project_id, task_id AS id FROM t UNION SELECT ctx_id, project_id, id FROM own),
near AS (SELECT s.ctx_id, s.project_id, w.source_id, w.target_id, w.relation_type, w.target_id AS there FROM starts s JOIN w ON w.project_id = s.project_id AND w.source_id = s.id UNION SELECT s.ctx_id, s.project_id, w.source_id, w.target_id, w.relation_type, w.source_id FROM starts s JOIN w ON w.project_id = s.project_id AND w.target_id = s.id),
nodes AS (SELECT x.ctx_id, string_agg(concat_ws(':', g.id, g.node_type, g.name), '|' ORDER BY g.id) AS nodes FROM (SELECT ctx_id, project_id, there AS id FROM near UNION SELECT ctx_id, project_id, id FROM own) x JOIN wl_graph_nodes g ON g.project_id = x.project_id AND g.id = x.id GROUP BY 1),
edges AS (SELECT ctx_id, string_agg(concat_ws(':', source_id, target_id, relation_type), '|' ORDER BY source_id, target_id, relation_type) AS edges FROM (SELECT DISTINCT ctx_id, source_id, target_id, relation_type FROM near) x GROUP BY 1)
SELECT t.ctx_id, (SELECT string_agg(concat_ws(':', p.position, p.id, p.type, p.content), '|' ORDER BY p.position, p.id) FROM wl_progress_items p WHERE p.task_id = t.task_id AND p.status = 'open') AS progress,
 (SELECT string_agg(concat_ws(':', e.id, e.type, e.payload_json), '|' ORDER BY e.occurred_at, e.id) FROM e WHERE e.task_id = t.task_id AND e.project_id = t.project_id) AS events,
 (SELECT string_agg(concat_ws(':', x.display_id, x.title), '|' ORDER BY x.display_id) FROM wl_decisions x WHERE x.task_id = t.task_id AND x.project_id = t.project_id) AS decisions, nodes, edges FROM t LEFT JOIN nodes USING (ctx_id) LEFT JOIN edges USING (ctx_id)""",
)
def _(d: Demo) -> DataFrame:
    tables = _tables(d)
    tables["graph_edges"] = d.spark.sql(WORK_EDGES, edges=d.graph_edges, items=d.progress_items)
    rows = bundles.context_bundle(d.spark.sql(CONTEXTS, h=d.handoffs, g=d.graph_nodes), tables, now=F.lit(LOG_NOW).cast("timestamp_ntz"))
    lists = {"progress": ("position", "id", "type", "content"), "events": ("id", "type", "payload_json"), "decisions": ("display_id", "title"), "nodes": ("id", "node_type", "name"), "edges": ("source_id", "target_id", "relation_type")}
    return rows.select("ctx_id", *[_listed(name, *columns) for name, columns in lists.items()])


TEAM_LISTS = {
    "tasks": ("t", "t.created_at, t.id, t.status, t.owner_agent_id", "t"),
    "dependencies": ("t", "x.task_id, x.prerequisite_task_id, x.kind", "wl_task_dependencies x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id JOIN t b ON b.id = x.prerequisite_task_id AND b.team_id = t.team_id AND b.key = t.key AND b.project_id = t.project_id"),
    "scopes": ("t", "x.task_id, x.pattern", "wl_scopes x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "conflicts": ("a", "a.task_id, a.pattern, b.task_id, b.pattern", "s a JOIN s b ON a.project_id = b.project_id AND a.team_id = b.team_id AND a.key = b.key AND a.task_id < b.task_id AND (a.pattern = b.pattern OR a.pattern = '**' OR b.pattern = '**')"),
    "blockers": ("t", "x.created_at, x.id, x.task_id, x.content", "(SELECT * FROM wl_progress_items WHERE type = 'blocker' AND status = 'open') x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "progress": ("t", "x.task_id, x.position, x.id, x.type, x.status, x.content", "wl_progress_items x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "checkpoints": ("t", "x.task_id, x.id, x.created_at", "(SELECT * FROM wl_checkpoints QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY created_at DESC, id DESC) = 1) x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "decisions": ("t", "x.created_at, x.id, x.task_id, x.display_id, x.title", "wl_decisions x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "handoffs": ("t", "x.created_at, x.id, x.task_id, x.state, x.from_agent_id, x.to_agent_id", "wl_handoffs x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id"),
    "events": ("x", "x.occurred_at, x.id, x.type, x.task_id, x.actor_agent_id", "(SELECT t.team_id, t.key, x.* FROM wl_events x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id QUALIFY row_number() OVER (PARTITION BY t.project_id, t.team_id, t.key ORDER BY x.occurred_at DESC, x.id DESC) <= 50) x"),
    "rebuild": ("x", "x.session_id", "(SELECT t.team_id, t.key, arg_max(c.session_id, (c.created_at, c.id)) AS session_id FROM wl_checkpoints c JOIN t ON t.id = c.task_id AND t.project_id = c.project_id WHERE c.session_id IS NOT NULL GROUP BY 1, 2) x"),
}


def _team_sql(view: str) -> str:
    key = {"commander": "team_id", "member": "owner_agent_id", "task": "id"}[view]
    people = {"commander": "wl_team_members m", "member": "(SELECT *, agent_id AS key FROM wl_team_members) m", "task": "wl_team_members m JOIN t ON t.project_id = m.project_id AND t.team_id = m.team_id AND t.owner_agent_id = m.agent_id"}[view]
    of_member = {"commander": "m.team_id", "member": "m.key", "task": "t.key"}[view]
    parts = [f"SELECT m.team_id, {of_member} AS key, 'members' AS list, concat_ws('|', m.agent_id, m.role) AS item FROM {people}"]
    for name, (own, columns, rows) in TEAM_LISTS.items():
        parts.append(f"SELECT {own}.team_id, {own}.key, '{name}', concat_ws('|', {columns}) FROM {rows}")
    with_tasks = f"WITH t AS (SELECT *, {key} AS key FROM wl_tasks WHERE team_id IN (SELECT id FROM wl_teams) AND {key} IS NOT NULL), s AS (SELECT DISTINCT t.project_id, t.team_id, t.key, x.task_id, x.pattern FROM wl_scopes x JOIN t ON t.id = x.task_id AND t.project_id = x.project_id)"
    return f"{with_tasks} {' UNION ALL '.join(parts)}"


def _team_items(d: Demo, view: str) -> DataFrame:
    """All entries of all lists of all slices of a view, each as a text."""
    lists = []
    for name, df in bundles.team_lists(_tables(d), view).items():
        columns = [F.col(c).cast("string") for c in df.columns if c not in bundles.SLICE]
        lists.append(df.select("team_id", "key", F.lit(name).alias("list"), F.concat_ws("|", *columns).alias("item")))
    return search.union_hits(*lists)


@query("l3_team_context", _team_sql("commander"))
def _(d: Demo) -> DataFrame:
    return _team_items(d, "commander")


@query("l3_member_context", _team_sql("member"))
def _(d: Demo) -> DataFrame:
    return _team_items(d, "member")


@query("l3_task_context", _team_sql("task"))
def _(d: Demo) -> DataFrame:
    return _team_items(d, "task")
