"""Work-log tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from worklog.sources.shared import distinct_rows, stored

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: Each view may use driver's tables and views above it, in braces.
VIEWS: dict[str, str] = {
    "wl_projects": "SELECT concat('P', CAST(r_regionkey AS STRING)) AS id, r_name AS name, CASE WHEN r_regionkey = 3 THEN lower(substr(r_name, 1, 3)) ELSE substr(r_name, 1, 3) END AS task_prefix FROM {region}",
    "wl_agents": """
SELECT concat('A', lpad(CAST(c_custkey AS STRING), 8, '0')) AS id, concat('P', CAST(n_regionkey AS STRING)) AS project_id,
  concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS team_id, c_name AS name, c_mktsegment AS role,
  CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) THEN 'commander' ELSE 'subagent' END AS kind,
  CASE WHEN c_custkey % 5 = 0 THEN 'inactive' WHEN c_custkey % 5 = 1 THEN 'deactivated' ELSE 'active' END AS status
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "wl_teams": """
SELECT concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS id, concat('P', CAST(n_regionkey AS STRING)) AS project_id, n_name AS name, c.id AS commander_agent_id
FROM {nation} LEFT JOIN (SELECT team_id, id FROM {wl_agents} WHERE kind = 'commander') c ON c.team_id = concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0'))""",
    "wl_team_members": "SELECT project_id, team_id, id AS agent_id, role FROM {wl_agents} WHERE NOT (kind = 'commander' AND team_id > 'T20')",
    "wl_tasks": """
SELECT concat('K', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS id, a.project_id AS project_id, concat('TSK-', CAST(o_orderkey AS STRING)) AS display_id,
  concat('Order ', o_orderpriority) AS title, CAST(NULL AS STRING) AS description,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'completed' END
    WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'blocked' ELSE 'review' END
    WHEN o_orderkey % 3 = 0 THEN 'planned' WHEN o_orderkey % 3 = 1 THEN 'ready' ELSE 'in_progress' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'normal' END AS priority,
  CASE WHEN o_orderkey % 101 = 0 THEN 'A99999999' WHEN o_orderkey % 7 = 0 THEN NULL ELSE a.id END AS owner_agent_id, CAST(NULL AS STRING) AS parent_task_id,
  o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 30 AS INT) AS updated_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS started_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 30 AS INT) END AS completed_at,
  CASE WHEN o_orderkey % 211 = 0 THEN 'T77' ELSE a.team_id END AS team_id, a.id AS customer_id, o_orderkey AS number
FROM {orders} JOIN {wl_agents} a ON a.id = concat('A', lpad(CAST(o_custkey AS STRING), 8, '0'))""",
    "wl_task_dependencies": """
SELECT concat('D-', id) AS id, project_id, id AS task_id, before AS prerequisite_task_id, CASE WHEN number % 4 = 0 THEN 'informational' ELSE 'strong' END AS kind
FROM (SELECT id, project_id, number, lag(id) OVER (PARTITION BY customer_id ORDER BY created_at, id) AS before FROM {wl_tasks}) x WHERE before IS NOT NULL""",
    "wl_progress_items": """
SELECT concat('I', lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id, t.project_id AS project_id, t.id AS task_id,
  concat('S', lpad(CAST(l_orderkey % 150 AS STRING), 8, '0'), '-1') AS source_session_id, CASE l_returnflag WHEN 'N' THEN 'todo' WHEN 'R' THEN 'blocker' ELSE 'risk' END AS type,
  CASE WHEN l_linenumber % 7 = 0 THEN 'removed' WHEN l_linestatus = 'O' THEN 'open' ELSE 'completed' END AS status, concat('part ', CAST(l_partkey AS STRING)) AS content,
  CAST(l_linenumber - 1 AS INT) AS position, CAST(l_linenumber * 20 AS INT) AS percentage, l_shipdate AS created_at
FROM {lineitem} JOIN {wl_tasks} t ON t.number = l_orderkey""",
    "wl_sessions": """
SELECT concat('S', lpad(CAST(user_id AS STRING), 8, '0'), '-', CAST(n AS STRING)) AS id, a.project_id AS project_id, a.id AS agent_id,
  CASE WHEN n % 3 = 0 THEN NULL ELSE concat('K', lpad(CAST(user_id * 10 + n AS STRING), 10, '0')) END AS task_id, CASE WHEN n % 2 = 0 THEN concat('W', CAST(user_id AS STRING)) END AS worktree_id,
  CASE WHEN n % 5 = 0 THEN 'ended' WHEN n % 5 = 1 THEN 'paused' WHEN n % 5 = 2 THEN 'stale' ELSE 'active' END AS state, started_at, last_activity_at,
  CASE WHEN n % 5 = 0 THEN last_activity_at + INTERVAL '5' MINUTE END AS ended_at
FROM (SELECT user_id, n, min(ts) AS started_at, max(ts) AS last_activity_at FROM (
    SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM (
      SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2' HOUR THEN 0 ELSE 1 END AS fresh FROM {events}) x) y GROUP BY user_id, n) z
JOIN {wl_agents} a ON a.id = concat('A', lpad(CAST(user_id + 1 AS STRING), 8, '0'))""",
    "wl_worktrees": """
SELECT concat('W', CAST(user_id AS STRING)) AS id, a.project_id AS project_id, CASE WHEN user_id % 2 = 0 THEN concat('K', lpad(CAST(user_id + 1 AS STRING), 10, '0')) END AS task_id,
  concat('/work/', CAST(user_id % 40 AS STRING), '/', CAST(user_id AS STRING)) AS normalized_path, concat('branch-', CAST(user_id AS STRING)) AS branch, min_ts AS bound_at
FROM (SELECT user_id, min(ts) AS min_ts FROM {events} GROUP BY user_id) x JOIN {wl_agents} a ON a.id = concat('A', lpad(CAST(user_id + 1 AS STRING), 8, '0'))""",
    "wl_events": """
SELECT concat('E', lpad(CAST(event_id AS STRING), 10, '0')) AS id, a.project_id AS project_id,
  CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'view' THEN 'task.claimed' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'task.releaseed' ELSE 'task.released' END
    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'task.completeed' ELSE 'task.completed' END ELSE 'task.canceled' END AS type,
  'task' AS aggregate_type, concat('K', lpad(CAST(event_id % 500 + 1 AS STRING), 10, '0')) AS aggregate_id,
  CASE event_type WHEN 'signup' THEN '{"status":"ready"}' WHEN 'view' THEN '{"note":"taken"}' WHEN 'click' THEN '{"afterStatus":"ready"}' WHEN 'purchase' THEN '{"afterStatus":"completed"}' ELSE '{"afterStatus":"cancelled"}' END AS payload_json,
  ts AS occurred_at, a.id AS actor_agent_id, CAST(NULL AS STRING) AS session_id, concat('K', lpad(CAST(event_id % 500 + 1 AS STRING), 10, '0')) AS task_id
FROM {events} JOIN {wl_agents} a ON a.id = concat('A', lpad(CAST(user_id + 1 AS STRING), 8, '0'))""",
    "wl_checkpoints": """
SELECT concat('C', lpad(CAST(conv_id AS STRING), 8, '0'), '-', CAST(turn AS STRING)) AS id, t.project_id AS project_id, t.id AS task_id,
  CASE WHEN role = 'assistant' THEN concat('S', lpad(CAST(conv_id % 150 AS STRING), 8, '0'), '-1') END AS session_id, CASE WHEN role <> 'system' THEN t.customer_id END AS agent_id,
  CASE WHEN turn % 2 = 0 THEN concat('W', CAST(conv_id % 50 AS STRING)) END AS worktree_id, concat('b', CAST(turn AS STRING)) AS branch, role, text,
  t.created_at + INTERVAL '1' MINUTE * CAST(turn AS INT) AS created_at
FROM {conversations} JOIN {wl_tasks} t ON t.number = conv_id % 400 + 1""",
    "wl_scopes": """
SELECT concat('X', CAST(page_id AS STRING)) AS id, t.project_id AS project_id, t.id AS task_id,
  CASE WHEN page_id % 50 = 0 THEN '**' WHEN page_id % 41 = 0 THEN '*.example.com/en/**' WHEN page_id % 37 = 0 THEN 'm.[bad/x' ELSE concat(split_part(url, '/', 3), '/', split_part(url, '/', 4), CASE WHEN page_id % 3 = 0 THEN '/**' ELSE '/x.html' END) END AS pattern, 'include' AS kind
FROM {pages} JOIN {wl_tasks} t ON t.number = page_id % 200 + 1""",
    "wl_decisions": """
SELECT concat('Z', CAST(item_id AS STRING)) AS id, t.project_id AS project_id, t.id AS task_id, concat('DEC-', lpad(CAST(item_id AS STRING), 4, '0')) AS display_id, substr(text, 1, 40) AS title,
  CASE WHEN item_id % 3 = 0 THEN ' ' ELSE substr(text, 41, 100) END AS rationale, CAST(NULL AS STRING) AS context, text AS decision_body, CAST(NULL AS STRING) AS consequences, CAST(NULL AS STRING) AS superseded_by, t.created_at AS created_at
FROM {benchmark} JOIN {wl_tasks} t ON t.number = item_id + 1""",
    "wl_handoffs": """
SELECT concat('H', CAST(number AS STRING)) AS id, project_id, id AS task_id, customer_id AS from_agent_id, owner_agent_id AS to_agent_id,
  CASE number % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'declined' ELSE 'pending' END AS state, concat('HND-', CAST(number AS STRING)) AS display_id, created_at, updated_at,
  CASE WHEN number % 4 = 0 THEN updated_at END AS accepted_at, CASE WHEN number % 4 = 1 THEN updated_at END AS declined_at
FROM {wl_tasks} WHERE number % 9 = 0""",
    "wl_graph_nodes": """
SELECT concat('part-', CAST(p_partkey AS STRING)) AS id, 'P0' AS project_id, 'file' AS node_type, concat(p_brand, '/', substr(p_type, 1, 3), '/', CAST(p_partkey AS STRING)) AS name FROM {part}
UNION ALL SELECT concat('supplier-', CAST(s_suppkey AS STRING)) AS id, 'P0' AS project_id, 'agent' AS node_type, concat('suppliers/', CAST(s_nationkey AS STRING), '/', s_name) AS name FROM {supplier}""",
    "wl_graph_edges": "SELECT DISTINCT concat('part-', CAST(l_partkey AS STRING)) AS source_id, concat('supplier-', CAST(l_suppkey AS STRING)) AS target_id, 'P0' AS project_id, CASE l_returnflag WHEN 'R' THEN 'depends_on' ELSE 'changed' END AS relation_type FROM {lineitem}",
}

def _graph_edges(lines: DataFrame) -> DataFrame:
    """The rows of wl_graph_edges; lines are told apart by numbers and not by the texts made of them."""
    ends = lines.selectExpr("l_partkey", "l_suppkey", "coalesce(l_returnflag = 'R', false) AS needed")
    return distinct_rows(ends, lines.count()).selectExpr(
        "concat('part-', CAST(l_partkey AS STRING)) AS source_id", "concat('supplier-', CAST(l_suppkey AS STRING)) AS target_id", "'P0' AS project_id", "CASE WHEN needed THEN 'depends_on' ELSE 'changed' END AS relation_type"
    )


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Demo:
    """The views over one folder of driver's tables; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.built = spark, sf_dir, {}

    @property
    def log(self) -> DataFrame:
        """The event log; the plain name is the driver's own table."""
        return self["wl_events"]

    def keep(self, name: str) -> None:
        """Write a view now; it and the views built on it later read the table."""
        self.built[name] = stored(self[name], name)

    def __getattr__(self, name: str) -> DataFrame:
        return self[f"wl_{name}"]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            if name == "wl_graph_edges":
                self.built[name] = _graph_edges(self["lineitem"])
            elif name in VIEWS:
                sql = VIEWS[name]
                text = re.sub(r"'(\{\"[^']*)'", lambda m: "'" + m[1].replace("{", "{{").replace("}", "}}") + "'", sql)
                self.built[name] = self.spark.sql(text, **{n: self[n] for n in _needs(sql)})
            else:
                self.built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.built[name]


def with_views(query: str) -> str:
    """A DuckDB query with the views that it names in front of it."""
    wanted: list[str] = []

    def add(sql: str) -> None:
        for name in re.findall(r"\bwl_\w+", sql):
            if name not in wanted:
                add(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    add(query)
    parts = [f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in wanted]
    body = query.strip()
    if not parts:
        return body
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    return f"WITH {recursive}" + ",\n".join(parts) + (",\n" + body[5 + len(recursive) :] if body.upper().startswith("WITH ") else "\n" + body)
