"""Retention at size: a table moves once for each key that it is judged by, whichever side is asked for."""

from datetime import datetime

from pyspark.sql import functions as F

from worklog.operators import retention

TASKS = [("t1", "completed", "t2"), ("t2", "completed", None), ("t3", "ready", "t1"), ("t4", "ready", "t3"), ("t5", "ready", None)]


def test_a_table_is_joined_once_for_each_key(spark, tmp_path):
    tasks = spark.createDataFrame([("p", *t, datetime(2024, 1, 1)) for t in TASKS], "project_id string, id string, status string, parent_task_id string, updated_at timestamp_ntz")
    deps = spark.createDataFrame([("p", a + (b or ""), a, b) for a, b in (("t1", "t3"), ("t3", "t2"), ("t1", "t2"), ("t3", "t4"), ("t5", None))], "project_id string, id string, task_id string, prerequisite_task_id string")
    now = F.lit(datetime(2024, 5, 1)).cast("timestamp_ntz")
    kept, archived = retention.archive_completed({"tasks": tasks, "task_dependencies": deps}, now, 30)
    for side in (kept, archived):
        assert side["task_dependencies"]._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    paths = {"tasks": f"{tmp_path}/tasks", "task_dependencies": f"{tmp_path}/deps"}
    for name, df in (("tasks", tasks), ("task_dependencies", deps)):
        df.write.parquet(paths[name])
    retention.retire(spark, paths, f"{tmp_path}/archive", "r", now, 30)
    stored = [{n: spark.read.parquet(p) for n, p in paths.items()}, {n: spark.read.parquet(f"{tmp_path}/archive/{n}/run=r") for n in paths}]
    for stays, leaves in ((kept, archived), stored):
        assert {(r.id, r.parent_task_id) for r in stays["tasks"].collect()} == {("t3", None), ("t4", "t3"), ("t5", None)}
        assert {(r.id, r.parent_task_id) for r in leaves["tasks"].collect()} == {("t1", "t2"), ("t2", None)}
        assert {r.id for r in stays["task_dependencies"].collect()} == {"t3t4", "t5"}
        assert {r.id for r in leaves["task_dependencies"].collect()} == {"t1t3", "t3t2", "t1t2"}
