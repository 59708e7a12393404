"""What the operators share: ordered blocks of identifiers, white space and letters; and the shared-folder tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklog.sources.shared import scratch, shared_folder, stored

#: The characters that part words, as in ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes in hand at once; a longer text comes alone.
SLICE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["documents", "lower_ascii", "n_words", "scratch", "shared_folder", "shuffle_partitions", "slices", "splitters", "stored", "with_block"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitters(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 distinct values of a number column that part its rows into nearly equal ordered blocks."""
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * n)).alias("cuts")).first() if shares else None
    return sorted(set(row.cuts)) if row and row.cuts else []


def with_block(df: DataFrame, key: str, cuts: list[int], name: str) -> DataFrame:
    """Add the ordered block of each row: the number of cuts at or below its key; rows without a key are in block 0."""
    edges = sorted({float(c) for c in cuts})
    filled = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    if not edges:
        return filled.withColumn(name, F.lit(0)).drop("_key")
    split = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_key", outputCol="_bucket")
    return split.transform(filled).withColumn(name, F.col("_bucket").cast("int")).drop("_key", "_bucket")


def lower_ascii(column: Column) -> Column:
    """A to Z in lower case, other letters as they are."""
    return F.translate(column, UPPER, LOWER)


def n_words(column: Column) -> Column:
    """The number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, cut so that no piece has more bytes in its text column than the limit, or one row alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, held + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
