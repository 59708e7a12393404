"""The corpus pipeline: documents that are good, distinct, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again as the next stage's docs.
All stages take an empty table and give an empty one; null texts count as empty, whole texts are read however long, and
all but the last pass every other column on, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklog.llm import common
from worklog.llm.exact_dedup import drop_duplicates
from worklog.llm.mixing import mix
from worklog.llm.near_dedup import drop_near_duplicates
from worklog.llm.quality import keep_good
from worklog.llm.sentencepiece_codec import encode_and_decode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps.

    Null and empty texts are scored as texts without words. Rows that repeat an identifier are each judged by their own
    text; those without one never train. Where labels lack a class, all rows stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest identifier.

    Null and empty texts are equal. Of rows that share text and smallest identifier one stays; a row without an
    identifier stays only where no copy has one.
    """
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest identifier.

    Texts without words and rows without an identifier are linked with nothing and stay. Rows that share identifier and
    text stay or go together.
    """
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each copy that it takes.

    Null is a source of its own, the last. Texts without words are never taken. Rows that share an identifier are taken
    each for itself.
    """
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each copy.

    Null and empty texts have no ids. Repeated rows and identifiers give as many rows; other columns are left out.
    """
    return encode_and_decode(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources", mixed), ("SentencePiece encoding", encoded)]

#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows. What a stage writes for itself goes when its result is written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"), outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
