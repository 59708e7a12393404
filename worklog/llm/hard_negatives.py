"""Hard negatives by coordinate pruning over length buckets.

1. Rows with a usable vector are sorted by label and length and cut into buckets. A bucket keeps its vectors, and for each
   coordinate its rows in the order of that coordinate of the normalised vector. Buckets are the index, written as a table.
2. Anchors travel in blocks. Buckets are dealt to parts, of which a task holds one; each block goes to each part and meets
   its buckets in the order of falling length. For an anchor with a score still to beat, the bucket's longest vector gives
   the cosine that is needed, and with it, for the anchor's largest coordinates (the focus), the range in which a row's
   coordinate has to lie. Rows that are in all ranges are candidates, whose integer scores are computed; a bucket that
   cannot reach the cosine is passed over.
3. Positives first: the score to beat is an anchor's least positive so far. Then negatives: each positive sets the range of
   scores, and the score to beat is the lowest that any positive of the anchor can still use.

Each task gives its best of each anchor, a few rows, and a window takes the best of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket, anchors of a block, focus coordinates, and the largest component that is told apart.
ROWS, ANCHORS, FOCUS, MOST = 2048, 512, 3, 1 << 24
#: Components that the buckets of a part have about at most, and parts for each core, where there are so many buckets.
HELD, FOR_CORE = 1 << 22, 3
#: A range is taken so much wider, for rounding; ranges that hold a larger part of a bucket are not worth gathering.
WIDER, WORTH = 1e-6, 0.5
#: Sums of products below this are whole numbers in a double.
EXACT = float(1 << 53)

BLOCK = "longest double, n int, width int, ids binary, labels binary, vectors binary, orders binary"


def _usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """_id, _label and _v, the whole components, of rows that take part."""
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("_x", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(256 * x))).cast("int"))
    own = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.col(vector_col).cast("array<double>").alias("_x"))
    return own.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_x").isNotNull()).filter(finite).select("_id", "_label", whole.alias("_v"))


def _blocks(rows: DataFrame, size: int, length: Column, orders: bool) -> DataFrame:
    """Rows sorted by label and falling length, as one row for each block; parts follow sampled splitters.

    A random last key lets a label or length that very many rows share be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    def packed(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("_v").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        width = int(sizes.max())
        vectors = np.zeros((len(sizes), width), np.int32)  # a shorter vector goes on with zeros
        vectors[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        labels = table.column("_label").to_numpy()
        order = np.argsort(_normal(vectors, lengths), axis=0, kind="stable").astype(np.uint16).T if orders else np.empty(0, np.uint16)
        small = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
        parts = [table.column("_id").to_numpy(), labels, small, np.ascontiguousarray(order)]
        values = [lengths.max(initial=0), len(sizes), width, *(p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts)]
        types = [pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    n = max(1, min(common.shuffle_partitions(rows.sparkSession), -(-rows.count() // size)))
    keyed = rows.withColumns({"_long": length, "_any": F.xxhash64("_id", "_v", F.monotonically_increasing_id())})
    dealt = keyed.repartitionByRange(n, "_label", F.col("_long").desc(), "_any").sortWithinPartitions("_label", F.col("_long").desc())
    return dealt.select("_id", "_label", "_v").coalesce(n).mapInArrow(run, BLOCK)


def _normal(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(lengths, 1.0)[:, None]


class Vectors:
    """A block as read back."""

    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, vectors: bytes, orders: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.v = np.frombuffer(vectors, "<i2" if len(vectors) == 2 * n * width else "<i4").reshape(n, width)
        self.lengths = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        self.longest = self.lengths.max(initial=0)
        self.orders = np.frombuffer(orders, "<u2").reshape(-1, n) if orders else None
        self._sorted: dict[int, np.ndarray] = {}

    def normal(self, rows: np.ndarray, f: int) -> np.ndarray:
        """A coordinate of the normalised rows."""
        return self.v[rows, f] / np.maximum(self.lengths[rows], 1.0)

    def sorted(self, f: int) -> np.ndarray:
        """A coordinate of the normalised rows in order."""
        if f not in self._sorted:
            self._sorted[f] = self.normal(self.orders[f], f)
        return self._sorted[f]

    def may_have(self, block: Vectors, same: bool) -> bool:
        """Whether there may be rows of the same or of another label for anchors of the block."""
        low, high, other_low, other_high = self.labels.min(), self.labels.max(), block.labels.min(), block.labels.max()
        return low <= other_high and other_low <= high if same else not low == high == other_low == other_high

    def scores(self, rows: np.ndarray | slice, anchors: np.ndarray) -> np.ndarray:
        """Whole scores (anchors, rows)."""
        width = min(self.v.shape[1], anchors.shape[1])
        own, other = self.v[rows][:, :width].astype(np.float64), anchors[:, :width]
        if self.longest * np.sqrt((other**2).sum(1).max(initial=0)) >= EXACT:
            return other.astype(np.int64) @ own.astype(np.int64).T
        return (other @ own.T).astype(np.int64)


def feasible(own: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of a coordinate of unit vectors that have at least this cosine with one whose coordinate is given."""
    wide = np.sqrt(np.maximum(0, 1 - own**2) * np.maximum(0, 1 - cosine**2))
    low = np.where(-own >= cosine, -1.0, own * cosine - wide)
    high = np.where(own >= cosine, 1.0, own * cosine + wide)
    return low - WIDER, high + WIDER


def candidates(bucket: Vectors, anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """(anchors, rows of the bucket) that hold every pair with a score of at least the anchor's least one.

    Anchors whose ranges leave much of the bucket come together with all its rows.
    """
    n, width = len(bucket.ids), min(anchors.shape[1], bucket.v.shape[1])
    cosine = np.where(least > 0, np.maximum(least, 0) / np.maximum(lengths * bucket.longest, 1e-9), 0.0)
    own = np.flatnonzero(cosine <= 1 + WIDER)
    cosine = np.minimum(cosine, 1.0)
    unit = anchors[own] / np.maximum(lengths[own], 1.0)[:, None]
    focus = np.argsort(-np.abs(unit[:, :width]), axis=1)[:, :FOCUS]
    whole = []
    for k, a in enumerate(own):
        if not cosine[a] or not focus.shape[1]:
            whole.append(a)
            continue
        low, high = feasible(unit[k, focus[k]], np.full(focus.shape[1], cosine[a]))
        spans = [(np.searchsorted(bucket.sorted(f), x, "left"), np.searchsorted(bucket.sorted(f), y, "right")) for f, x, y in zip(focus[k], low, high, strict=True)]
        sizes = [b - a for a, b in spans]
        best = int(np.argmin(sizes))
        if sizes[best] > WORTH * n:
            whole.append(a)
            continue
        rows = bucket.orders[focus[k][best]][slice(*spans[best])].astype(np.int64)
        for f, x, y in zip(focus[k], low, high, strict=True):
            rows = rows[((own_f := bucket.normal(rows, f)) >= x) & (own_f <= y)]
        if len(rows):
            yield np.array([a]), rows
    if whole:
        yield np.array(whole), slice(0, n)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by identifier."""
    if len(scores) > k:
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[rows], ids[rows]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _met(anchors: DataFrame, buckets: DataFrame, parts: int) -> DataFrame:
    """The buckets of each part in order of falling length, and after them every anchor block.

    Parts follow each other within a task. Buckets are dealt to parts, and each block goes to each part as a row of its own:
    blocks are neither joined with buckets nor sent to all tasks at once, which would take the driver's memory.
    """
    sent = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = buckets.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int")).drop("bucket")
    met = sent.unionByName(dealt, allowMissingColumns=True).repartitionById(parts, "part")
    return met.sortWithinPartitions("part", F.col("block").asc_nulls_first(), F.col("longest").desc()).select(*MET)


MET = ["part", "block", "n", "width", "ids", "labels", "vectors", "orders", "wanted"]


def _streamed(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[dict, Vectors, list[Vectors]]]:
    """Each anchor block of each part, and the part's buckets that may have rows of the same or of another label."""
    part, buckets = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if row["part"] != part:
                part, buckets = row["part"], []
            vectors = Vectors(row["n"], row["width"], row["ids"], row["labels"], row["vectors"], row["orders"] or b"")
            if row["block"] is None:
                buckets.append(vectors)
            else:
                yield row, vectors, [b for b in buckets if b.may_have(vectors, same)]


def _parts(buckets: DataFrame) -> int:
    """So many that the cores have work, and more where a part would hold too much."""
    found = buckets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n").cast("long") * F.col("width")).alias("held")).first()
    return max(1, min(found.n, max(FOR_CORE * buckets.sparkSession.sparkContext.defaultParallelism, -(-(found.held or 0) // HELD))))


def _positives(met: DataFrame, k: int) -> DataFrame:
    """block, place (of the anchor), id and score of each task's k + 1 best rows of the anchor's label, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, buckets in _streamed(batches, True):
            of_anchors = block.v.astype(np.float64)
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(block.ids)
            for bucket in buckets:
                shared = np.isin(block.labels, bucket.labels)
                least = np.array([s[-1] if len(s) > k else -np.inf for s, _ in best], np.float64)
                least[~shared] = np.inf
                for anchors, rows in candidates(bucket, of_anchors, block.lengths, least):
                    scores, ids, labels = bucket.scores(rows, of_anchors[anchors]), bucket.ids[rows], bucket.labels[rows]
                    for a, own in zip(anchors, scores, strict=True):
                        good = (labels == block.labels[a]) & (own >= least[a])
                        if good.any():
                            s, i = _best(own[good], ids[good], k + 1)
                            best[a] = _best(np.concatenate([best[a][0], s]), np.concatenate([best[a][1], i]), k + 1)
            yield _flat(row["block"], best)

    return met.mapInArrow(run, "block long, place int, number int, id long, score long")


def _flat(block: int, best: list, number: list[int] | None = None, names: str = "id") -> pa.RecordBatch:
    """The best of each entry as rows; an entry is an anchor, or one of its positives."""
    sizes = [len(s) for s, _ in best]
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(sum(sizes), block, np.int64)),
            pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32) if number is None else np.repeat(np.array(number, np.int64)[:, 0], sizes).astype(np.int32) if best else empty.astype(np.int32)),
            pa.array(np.zeros(sum(sizes), np.int32) if number is None else np.repeat(np.array(number, np.int64)[:, 1], sizes).astype(np.int32) if best else empty.astype(np.int32)),
            pa.array(np.concatenate([empty, *[i for _, i in best]])),
            pa.array(np.concatenate([empty, *[s for s, _ in best]])),
        ],
        ["block", "place", "number", names, "score"],
    )


def _negatives(met: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """block, place, number (of the positive), id and score of each task's k best rows of other labels for each positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, buckets in _streamed(batches, False):
            of_anchors = block.v.astype(np.float64)
            asked = [(w["place"], w["number"]) for w in row["wanted"]]
            positive = np.array([w["score"] for w in row["wanted"]], np.int64)
            floor, ceiling = -(-low * positive // 100), high * positive // 100  # a negative score at these percentages has an empty range
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
            of = [[] for _ in block.ids]
            for w, (place, _) in enumerate(asked):
                if floor[w] <= ceiling[w]:
                    of[place].append(w)
            need = floor.copy()
            for bucket in buckets:
                least = np.array([min((need[w] for w in own), default=np.inf) for own in of], np.float64)
                for anchors, rows in candidates(bucket, of_anchors, block.lengths, least):
                    scores, ids, labels = bucket.scores(rows, of_anchors[anchors]), bucket.ids[rows], bucket.labels[rows]
                    for a, own in zip(anchors, scores, strict=True):
                        good = np.flatnonzero((labels != block.labels[a]) & (own >= least[a]))
                        if not len(good):
                            continue
                        s, i = own[good], ids[good]
                        for w in of[a]:
                            fits = (s <= ceiling[w]) & (s >= need[w])
                            if fits.any():
                                more = _best(s[fits], i[fits], k)
                                best[w] = _best(np.concatenate([best[w][0], more[0]]), np.concatenate([best[w][1], more[1]]), k)
                                if len(best[w][0]) == k:
                                    need[w] = best[w][0][-1]
            yield _flat(row["block"], best, asked)

    return met.mapInArrow(run, "block long, place int, number int, id long, score long")


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x), kept within 2 ** 24 on either side, and scores whole inner products; of vectors of different width
    the shorter one goes on with zeros. Each row for which the condition ``anchors`` holds is an anchor. Its positives are
    the ``positives`` other rows of its label with the highest scores, equal scores by identifier; for each, the
    ``negatives`` highest rows of other labels with a score from low to high percent of the positive's are returned. Rows
    with a null identifier, label, vector or component, or one that is not finite, take no part. Rows that repeat an
    identifier count each for itself, as anchors too; a copy of the anchor is another row. An empty table, one label
    alone, empty vectors and anchors without positives or negatives give no rows. Other columns are not read.
    """
    usable = common.stored(_usable(rows, id_col, vector_col, label_col), "usable-vectors")
    asked = common.stored(_usable(rows.filter(anchors), id_col, vector_col, label_col), "anchors")
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    number = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    buckets = common.stored(number(_blocks(usable, ROWS, square, orders=True), "bucket"), "length-buckets")
    blocks = common.stored(number(_blocks(asked, ANCHORS, square, orders=False).select("n", "width", "ids", "labels", "vectors"), "block"), "anchor-blocks")
    parts = _parts(buckets)
    nothing = blocks.withColumn("wanted", F.array().cast("array<struct<place:int,number:int,score:long>>"))
    near = _positives(_met(nothing, buckets, parts), positives)
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "id")
    first = common.stored(near.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= positives + 1), "best-rows")
    chosen = common.stored(_without_anchor(first, _anchor_rows(blocks), positives), "positives")
    wanted = chosen.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "number", F.col("positive_score").alias("score")))).alias("wanted"))
    found = _negatives(_met(blocks.join(wanted.hint("merge"), "block"), buckets, parts), negatives, low, high)
    order = Window.partitionBy("block", "place", "number").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen.hint("merge"), ["block", "place", "number"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _anchor_rows(blocks: DataFrame) -> DataFrame:
    """block, place, anchor_id and own_score, the anchor's score with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                own = Vectors(row["n"], row["width"], row["ids"], row["labels"], row["vectors"], b"")
                whole = own.v.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.ids), row["block"])), pa.array(np.arange(len(own.ids), dtype=np.int32)), pa.array(own.ids), pa.array((whole * whole).sum(1))], ["block", "place", "anchor_id", "own_score"]
                )

    return blocks.select("block", "n", "width", "ids", "labels", "vectors").mapInArrow(run, "block long, place int, anchor_id long, own_score long")


def _without_anchor(best: DataFrame, anchors: DataFrame, positives: int) -> DataFrame:
    """The positives: the anchor's own row, one of those with its identifier and score, is left out where it is among the best."""
    rows = best.join(anchors.hint("merge"), ["block", "place"])
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own_score"))
    of = Window.partitionBy("block", "place")
    place = F.min(F.when(itself, F.col("number"))).over(of)
    left = rows.withColumn("_own", place).filter(~F.col("number").eqNullSafe(F.col("_own")))
    numbered = left.withColumn("number", F.row_number().over(of.orderBy("number"))).filter(F.col("number") <= positives)
    return numbered.select("block", "place", "number", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
