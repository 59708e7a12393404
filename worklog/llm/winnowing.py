"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; in every window of ``w`` neighbouring hashes the least is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share a run of at least ``w + k - 1`` code points
share a chosen hash, and no run shorter than ``k`` can make a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A shared run of 19 code points is found, so a text of 38 or more keeps likeness to itself when half of it changes.
K, W = 12, 8
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


class Winnower:
    def __init__(self, k: int = K, w: int = W):
        self.k, self.w = k, w
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(4096, 2 * n)
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))

    def hashes(self, text: str) -> np.ndarray:
        """A 32-bit hash of each run of k code points; of a shorter text the hash of the whole."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        k = min(self.k, len(codes))
        if not k:
            return np.empty(0, np.uint64)
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        rolled = (sums[k:] - sums[:-k]) * self.inverse[: len(codes) - k + 1]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        return rolled >> np.uint64(32)

    def choose(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The chosen hashes and their positions in order; no two windows choose the same position twice."""
        hashes = self.hashes(text)
        n = len(hashes)
        if not n:
            return hashes, hashes
        # Hash above, complement of the position below: the least is the least hash, of equal ones the rightmost.
        least = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        w, span = min(self.w, n), 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return chosen >> np.uint64(32), np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes of all distinct hashes; two empty fingerprints are alike."""
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def as_text(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join([f"{h:08x}:{p}" for h, p in zip(chosen[0].tolist(), chosen[1].tolist(), strict=True)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row for each row of docs: id_col, n_chars, fingerprint ("hash:position" in order, parted by spaces).

    Null counts as empty, and an empty text has an empty fingerprint; a text shorter than k has one hash. An empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Winnower(k, w)
        for batch in common.slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(own.choose(t)) for t in texts], pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_chars long, fingerprint string")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text, of the text with its second half overwritten by the next one, and their likeness.

    The next document is the one with the next smaller identifier; after the smallest comes the largest. The last
    n_chars // 2 code points give way to the first as many (or all) of the next text. Returns id_col, n_chars,
    edited_text, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs. Rows with one
    identifier follow each other by text; rows without one come last; a single row is its own next. An empty table
    gives an empty result; other columns are not read.

    Blocks of neighbouring identifiers, one a partition, are sorted and streamed; each has a copy of the first row of
    the block after it. So there are as many such copies, collected as identifiers, as partitions.
    """
    spark = docs.sparkSession
    n = common.shuffle_partitions(spark)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    cuts = common.splitters(ids, "_id", n)
    heads = {r["_block"]: r["head"] for r in common.with_block(ids, "_id", cuts, "_block").groupBy("_block").agg(F.max("_id").alias("head")).collect()}
    order = sorted(heads)
    after = [(heads[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    halo = spark.createDataFrame(after, "_head long, _to int")
    placed = common.with_block(own, "_id", cuts, "_block").withColumn("_halo", F.lit(False))
    copies = placed.join(F.broadcast(halo), F.col("_id").eqNullSafe(F.col("_head"))).select("_id", "_text", F.col("_to").alias("_block"), F.lit(True).alias("_halo"))
    dealt = placed.unionByName(copies).repartitionById(n, "_block").sortWithinPartitions("_block", "_halo", F.col("_id").desc_nulls_last(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Winnower(k, w)
        held, rows, chars = None, [], 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in common.slices(batches, 1):
            for i, text, block, is_halo in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                text = text or ""
                chosen = own.choose(text)
                if held and held[2] == block:
                    last, mine = held[1], held[3]
                    half = len(last) // 2
                    edited = last[: len(last) - half] + text[:half]
                    other = own.choose(edited)
                    rows.append((held[0], len(last), edited, as_text(mine), as_text(other), likeness(mine[0], other[0]), likeness(mine[0], chosen[0])))
                    chars += 2 * len(last)
                    if len(rows) >= 500 or chars >= common.SLICE_BYTES:
                        yield packed()
                        rows, chars = [], 0
                held = None if is_halo else (i, text, block, chosen)
                if is_halo:
                    block = None
        yield packed()

    return dealt.select("_id", "_text", "_block", "_halo").mapInArrow(run, f"`{id_col}` long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_likeness(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
