"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: The scopes that the running thread is in; others have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("_scopes", default=())


def shared_folder(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local sessions without the setting, one that goes with the process.

    Within scratch it goes at the scope's end, or with outlive at the end of the scope around that, if there is one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "base" not in _own:
            _own["base"] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own["base"], True)
        base = f"file://{_own['base']}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if len(scopes) > outlive:
        scopes[-1 - outlive].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the folders that shared_folder gives within; results that read them have to be written before."""
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            remove(spark, path)


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    """A path and the file system that it is in, whatever store that is."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; none that is not there is no fault."""
    own, files = _at(spark, path)
    files.delete(own, True)


def exists(spark: SparkSession, path: str) -> bool:
    own, files = _at(spark, path)
    return files.exists(own)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another place in the same store, where nothing is yet."""
    (own, files), (target, _) = _at(spark, path), _at(spark, to)
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(own, target):
        raise OSError(f"{path} can't be moved to {to}")


def stored(df: DataFrame, name: str, partition_by: str | None = None, outlive: bool = False) -> DataFrame:
    """Write a table and read it back: this cuts the lineage and outlives executors."""
    path = shared_folder(df.sparkSession, name, outlive)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that distinct_rows gives to a task.
ROWS = 2_000_000


def distinct_rows(df: DataFrame, rows: int) -> DataFrame:
    """distinct() of about so many rows that nearly all differ: they move to tasks of a fixed number of rows first, because
    a task that groups what it reads takes memory for all of that."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))
    return df.repartition(tasks, *df.columns).distinct()
