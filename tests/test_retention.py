"""Archives that can be broken off anywhere, and health in one pass a table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worklog.operators import quality, retention



def late():
    return F.lit(datetime(2024, 5, 1)).cast("timestamp_ntz")


def written(spark, base):
    tasks = spark.createDataFrame([(p, f"t{n}", "completed" if n % 2 else "ready", datetime(2024, 1, 1), f"t{n - 1}") for p in "pq" for n in range(6)], "project_id string, id string, status string, updated_at timestamp_ntz, parent_task_id string")
    scopes = spark.createDataFrame([(p, f"t{n}", f"s{n}") for p in "pq" for n in range(6)], "project_id string, task_id string, id string")
    paths = {"tasks": f"{base}/tasks", "scopes": f"{base}/scopes"}
    for name, df in (("tasks", tasks), ("scopes", scopes)):
        df.write.parquet(paths[name])
    return paths


def contents(spark, paths, folder):
    kept = {n: sorted(spark.read.parquet(p).selectExpr("project_id || id").toPandas().iloc[:, 0]) for n, p in paths.items()}
    archived = {n: sorted(spark.read.parquet(f"{folder}/{n}").selectExpr("project_id || id").toPandas().iloc[:, 0]) for n in paths}
    return kept, archived


@pytest.mark.parametrize("kill_at", range(7))
def test_a_killed_run_is_finished_by_the_same_call(spark, tmp_path, monkeypatch, kill_at):
    paths, folder, steps = written(spark, tmp_path / "live"), str(tmp_path / "archive"), [0]

    def killing(f):
        def step(*args):
            steps[0] += 1
            if steps[0] == kill_at + 1:
                raise KeyboardInterrupt
            return f(*args)

        return step

    with monkeypatch.context() as m:
        for name in ("move", "_mark", "archive_completed"):
            m.setattr(retention, name, killing(getattr(retention, name)))
        with pytest.raises(KeyboardInterrupt):
            retention.retire(spark, paths, folder, "r1", late(), 30)
    for _ in range(2):
        retention.retire(spark, paths, folder, "r1", late(), 30)
        kept, archived = contents(spark, paths, folder)
        assert kept == {"tasks": [f"{p}t{n}" for p in "pq" for n in (0, 2, 4)], "scopes": [f"{p}s{n}" for p in "pq" for n in (0, 2, 4)]}
        assert archived == {"tasks": [f"{p}t{n}" for p in "pq" for n in (1, 3, 5)], "scopes": [f"{p}s{n}" for p in "pq" for n in (1, 3, 5)]}


def test_a_named_run_of_the_sink_takes_its_own_place(spark, tmp_path):
    rows = {"tasks": spark.createDataFrame([("p", "t1")], "project_id string, id string")}
    for run in ("a", "a", "b"):
        retention.write_archive(rows, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/tasks").count() == 2


def test_health_goes_through_a_table_once(spark):
    rows = spark.createDataFrame([(f"r{n:02d}", n) for n in range(40)], "id string, n int")
    looks = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda n: looks.add(1) or n, "int").asNondeterministic()
    checks = {"small": ("warning", "rows", F.col("n") < 30), "even": ("info", "rows", F.col("n") % 2 == 0), "any": ("error", "rows", F.col("n") >= 0)}
    report = quality.row_health({"rows": rows.withColumn("n", seen("n"))}, checks)
    got = [tuple(r) for r in report.collect()]
    assert got == [("small", "warning", 10, ["r30", "r31", "r32", "r33", "r34"]), ("even", "info", 20, ["r01", "r03", "r05", "r07", "r09"]), ("any", "ok", 0, []), ("overall", "issues_found", 1, [])]
    assert looks.value == 40
    with_null = quality.row_health({"rows": rows.withColumn("n", F.lit(None).cast("int"))}, {"small": checks["small"]})
    assert with_null.filter("check_name = 'small'").first()["count"] == 40
