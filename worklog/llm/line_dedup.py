"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents of its batch that hold each
line and the document that keeps it. A new batch is counted and merge-anti-joined with the runs (same buckets and order,
so the runs neither move nor are sorted); what no run has is added as a run of level 0. For lines that some run has, the
batch's counts go to a second set of tables, which is levelled alike. As soon as a level has ``fanout`` tables they are
compacted into one of the next level. Batches come in descending order of identifier, so the first batch with a line
holds its largest identifier, and runs have no hash in common.

Every batch reads all earlier runs once, so there are few batches, growing with the logarithm of the number of documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS, FANOUT = 40, 5, 2
#: Batches at least, and documents for which these are enough; one more for each doubling beyond.
BATCHES, BATCH_DOCS = 4, 1 << 18
KEY = ["h1", "h2"]


def _keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None where the key is too short to count."""
    spaces, digest, out = common.SPACES.encode(), xxhash.xxh3_128_digest, []
    for line in lines:
        key = line.strip(spaces)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(digest(key.lower()) if long else None)  # bytes.lower() changes A to Z alone
    return out


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, id_col: each long enough line key once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in _keys(_lines(text), min_chars) if k}
                found += own
                ids += [i] * len(own)
            halves = [pa.array([int.from_bytes(k[a : a + 8], "little", signed=True) for k in found], pa.int64()) for a in (0, 8)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array(ids, pa.int64())], ["h1", "h2", id_col])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"h1 long, h2 long, `{id_col}` long")


@contextmanager
def _in_bucket_order(spark: SparkSession) -> Iterator[None]:
    """Let Spark rely on the order within buckets that are one file each, as those of runs are."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The runs and the counts of known lines, level by level; each is a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or common.shuffle_partitions(spark)
        self.runs: list[list[DataFrame]] = []
        self.counts: list[list[DataFrame]] = []
        self.names: list[str] = []

    def _write(self, entries: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        with _in_bucket_order(self.spark):
            writer.option("path", common.shared_folder(self.spark, "line-run")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def unknown(self, counted: DataFrame) -> DataFrame:
        """The lines of a batch that no run has."""
        for run in (run for level in self.runs for run in level):
            counted = counted.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return counted

    def add(self, keys: DataFrame, id_col: str) -> None:
        """Add a batch of (h1, h2, id_col), each line once a document; batches come in descending order of id_col."""
        counted = self._write(keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max(id_col).alias("keep_doc")))
        if self.runs:
            new = self._write(self.unknown(counted))
            known = counted.drop("keep_doc").join(new.select(*KEY).hint("merge"), KEY, "left_anti")
            self._place(self.counts, self._write(known))
            counted = new
        self._place(self.runs, counted)

    def _place(self, levels: list[list[DataFrame]], table: DataFrame, level: int = 0) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(table)
        if len(levels[level]) >= self.fanout:
            merged, levels[level] = self._write(self.merged(levels[level])), []
            self._place(levels, merged, level + 1)

    @staticmethod
    def merged(tables: list[DataFrame]) -> DataFrame:
        """Sort-merge: the buckets agree, so a full outer join of two tables moves no rows. Counts are added."""
        rows = tables[0]
        for k, table in enumerate(tables[1:]):
            other = table.select(*KEY, *[F.col(c).alias(f"_{c}{k}") for c in table.columns if c not in KEY])
            keep = [F.coalesce("keep_doc", f"_keep_doc{k}").alias("keep_doc")] if "keep_doc" in table.columns else []
            rows = rows.join(other, KEY, "full_outer").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce(f"_n_docs{k}", F.lit(0))).alias("n_docs"), *keep)
        return rows

    def forget(self) -> None:
        """Take the runs out of the session's catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, keep_doc over all runs; each is joined with the counts of known lines where it is."""
        parts = []
        for run in (run for level in self.runs for run in level):
            rows, n = run, F.col("n_docs")
            for k, table in enumerate(table for level in self.counts for table in level):
                rows = rows.join(table.select(*KEY, F.col("n_docs").alias(f"_more{k}")).hint("merge"), KEY, "left")
                n = n + F.coalesce(f"_more{k}", F.lit(0))
            parts.append(rows.select(*KEY, n.alias("n_docs"), "keep_doc"))
        return reduce(DataFrame.unionByName, parts)


def n_batches(n_docs: int) -> int:
    return BATCHES + max(0, math.ceil(math.log2(max(1, n_docs) / BATCH_DOCS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of docs: id_col, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least min_chars code
    points that at least min_docs rows hold lose all their lines but in the largest identifier holding them. Null and
    empty texts have one empty line, which is never dropped. Rows that share an identifier count as documents of their
    own, and all rows with the largest identifier keep the line; rows without an identifier count as lower than any
    other, and where only they hold a line, they all keep it. An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    cuts = common.splitters(docs.select(id_col), id_col, batches or n_batches(docs.count()))
    lines = common.stored(common.with_block(line_keys(docs, id_col, text_col, min_chars), id_col, cuts, "batch"), "line-keys", "batch")
    runs = LineRuns(spark, fanout)
    for b in range(len(cuts), -1, -1):
        runs.add(lines.filter(F.col("batch") == b).select(*KEY, id_col), id_col)
    with _in_bucket_order(spark):
        common_lines = common.stored(runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "keep_doc"), "common-lines")
    runs.forget()
    lost = lines.join(common_lines, KEY).filter(~F.col(id_col).eqNullSafe(F.col("keep_doc")))
    packed = lost.groupBy(F.col(id_col).alias("_of")).agg(F.collect_set(F.struct(*KEY)).alias("_lost"))
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    joined = own.join(packed, own[id_col].eqNullSafe(packed["_of"]), "left").select(id_col, "_text", F.col("_lost.h1").alias("_h1"), F.col("_lost.h2").alias("_h2"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(rows, 1):
            total, gone, kept = [], [], []
            for text, h1, h2 in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                parts = _lines(text)
                total.append(len(parts))
                if h1:
                    drop = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(h1, h2, strict=True)}
                    parts = [p for p, k in zip(parts, _keys(parts, min_chars), strict=True) if k not in drop]
                gone.append(total[-1] - len(parts))
                kept.append(b"\n".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, f"`{id_col}` long, n_lines long, n_dropped long, kept_text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT key, max(doc_id) AS keep_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keep_doc AS dropped FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
