"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters deal the rows into ranges of normalised content, each range is sorted outside memory so that equal
texts are neighbours, and neighbours are compared in full; the row with the smallest identifier stays.

Splitters stay small: they are a short head of the text, a 64-bit hash and a salt, so a sample never carries whole texts.
The salt is 0, and all copies of a text are neighbours in one range, unless the text has more copies than a range should
hold. Copies of such a text are dealt to several ranges by their identifier; each range compares its own in full, and the
smallest identifier and the number of all copies come from one sum for each of these few texts, told apart by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Code points of the text that a splitter has; copies that a range takes in any case, and the part of its rows beyond that.
HEAD, COPIES, PART = 48, 64, 4


def most_copies(docs: DataFrame) -> int:
    """Copies of one text that a range takes. So at most PART texts for each shuffle partition have more."""
    return max(COPIES, docs.count() // (PART * common.shuffle_partitions(docs.sparkSession)))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), common.SPACE_CLASS, " ")


def _sha(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _hot(docs: DataFrame, id_col: str, text_col: str, copies: int) -> tuple[DataFrame, DataFrame] | None:
    """(hashes and the ranges that their rows are dealt to, texts with the smallest identifier and the number of rows) of
    hashes with more rows than a range takes; None if there are none."""
    own = docs.select(F.col(id_col).alias("_id"), _normal(F.col(text_col)).alias("_norm")).withColumn("_hash", F.xxhash64("_norm"))
    held = own.groupBy("_hash").agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") > copies)
    hashes = common.stored(held.select("_hash", F.ceil(F.col("_held") / copies).alias("_ranges")), "hot-hashes")
    if hashes.isEmpty():
        return None
    texts = own.join(F.broadcast(hashes), "_hash").groupBy("_hash", _sha(F.col("_norm")).alias("_sha")).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_all"))
    return hashes, common.stored(texts, "hot-texts")


def _placed(docs: DataFrame, id_col: str, text_col: str, copies: int, row: bool) -> DataFrame:
    """_id, _sha, keep_id, group_size and kept of each row; _row if asked."""
    kept = F.struct(*docs.columns) if row else F.struct(F.col(text_col).cast("string").alias(text_col))
    norm = _normal(F.col(f"_row.{text_col}"))
    own = docs.select(F.col(id_col).alias("_id"), kept.alias("_row")).withColumns({"_head": F.substring(norm, 1, HEAD), "_hash": F.xxhash64(norm)})
    hot, place = _hot(docs, id_col, text_col, copies), ["_head", "_hash"]
    if hot:  # as many hashes as PART for each shuffle partition at most
        dealt = F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_ranges"))
        own = own.join(F.broadcast(hot[0]), "_hash", "left").withColumn("_salt", F.coalesce(dealt, F.lit(0)).cast("int")).drop("_ranges")
        place.append("_salt")
    ranged = own.repartitionByRange(*place)
    near = Window.partitionBy(*place, "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.withColumn("_norm", norm).select(
        "_id", *["_row"] * row, "_hash", _sha(F.col("_norm")).alias("_sha"),
        F.row_number().over(near).alias("_rank"), F.min("_id").over(whole).alias("_least"), F.count(F.lit(1)).over(whole).alias("_rows"),
    )
    if hot:
        found = found.join(hot[1], ["_hash", "_sha"], "left")
        keep, rows = F.when(F.col("_all").isNull(), F.col("_least")).otherwise(F.col("_keep")), F.coalesce("_all", "_rows")
    else:
        keep, rows = F.col("_least"), F.col("_rows")
    # Rows of one identifier are in one range.
    return found.select("_id", *["_row"] * row, "_sha", keep.alias("keep_id"), rows.alias("group_size"), ((F.col("_rank") == 1) & F.col("_least").eqNullSafe(keep)).alias("kept"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int | None = None) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal; white space runs count as one space. Of rows that share both the text and the
    smallest identifier exactly one is kept; rows without an identifier are kept only where no copy has one. An empty
    table gives an empty result; columns other than these two are not read.
    """
    placed = _placed(docs, id_col, text_col, copies or most_copies(docs), row=False)
    return placed.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int | None = None) -> DataFrame:
    """The kept rows of docs with all their columns; the rules are those of duplicate_groups."""
    return _placed(docs, id_col, text_col, copies or most_copies(docs), row=True).filter("kept").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(common.documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
