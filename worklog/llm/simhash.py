"""SimHash near-duplicates by bit-sliced comparison.

1. Each text gives a fingerprint of 64 bits: a bit is set if it is set in over half of its shingles' hashes. Equal
   fingerprints form a class and go on as one.
2. The 64 bits are cut in more parts than the radius, so fingerprints within the radius agree in some set of parts. A
   class is in one bucket for each such set; there are as many parts as leave the buckets of random fingerprints small.
3. A bucket's fingerprints are stored as vertical bit planes, 64 to a word. A member is compared with a word of others
   plane by plane: carry-save adders count the differing bits of all 64 at once, and a word is abandoned as soon as all
   its counters exceed the radius.
4. A bucket of more than ``BLOCK`` classes is dealt to blocks. First each block is compared with itself; then, as far as
   the links so far leave several components in such a bucket, blocks of different components with each other. So a
   large group of near copies costs about its size, and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .near_dedup import _across_blocks, _spanning, _with_end

BITS, SEED, LANES = 64, 42, 64
#: Classes in a block, bits that a bucket's random fingerprints may leave open, planes between two looks at the counters, words compared at once.
BLOCK, OPEN_BITS, PLANES, WORDS = 2048, 10, 8, 1 << 14
#: What the counters of a word can hold.
MOST_RADIUS = 7


def fingerprint(text: str | None, k: int) -> int:
    """Of the text's k-word shingles, repeats included; of fewer words the whole sequence; zero of none."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A to Z alone
    if not words:
        return 0
    width = min(k, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
    held = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        held += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * held > len(hashes), bitorder="little").view("<u8")[0])


def n_parts(classes: int, radius: int) -> int:
    """Parts of the bits, so that about 2 ** OPEN_BITS random fingerprints at most share a bucket."""
    for parts in range(radius + 1, 2 * (radius + 1)):
        if BITS * (parts - radius) // parts >= log2(max(classes, 1)) - OPEN_BITS:
            return parts
    return 2 * (radius + 1)


def part_masks(parts: int, radius: int) -> list[int]:
    """The bits of each set of parts in which near fingerprints may agree."""
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(own, parts - radius)]


def planes_of(values: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Vertical bit planes (bits, words) of values put at these places, 64 to a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((words * LANES, BITS), np.uint8)
    lanes[places] = bits
    return np.ascontiguousarray(np.packbits(lanes.T, axis=1, bitorder="little")).view("<u8").reshape(BITS, words)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three bits in each place."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def near_lanes(planes: np.ndarray, ones: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a query and a word the lanes within the radius, as bits.

    ones has the queries' bits (bits, queries), each as a word of zeros or ones; valid the lanes that count.
    """
    near = np.zeros(len(query), np.uint64)
    rows, dead = np.arange(len(query)), ~valid
    one, two, four = (np.zeros(len(query), np.uint64) for _ in range(3))
    for at in range(0, len(planes), PLANES):
        d = [planes[p][word] ^ ones[p][query] for p in range(at, min(at + PLANES, len(planes)))]
        d += [np.zeros_like(one)] * (PLANES - len(d))
        fours = []
        for i in (0, 4):
            one, x = _add(one, d[i], d[i + 1])
            one, y = _add(one, d[i + 2], d[i + 3])
            two, z = _add(two, x, y)
            fours.append(z)
        four, eight = _add(four, *fours)
        dead = dead | eight | _over(one, two, four, radius)
        alive = dead != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not alive.all():  # these words are abandoned
            rows, query, word, dead, one, two, four = (x[alive] for x in (rows, query, word, dead, one, two, four))
        if not len(rows):
            break
    near[rows] = ~dead
    return near


def _over(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """The lanes whose counter of three bits is above the radius."""
    over = same = None
    for counter, bit in ((four, 4), (two, 2), (one, 1)):
        if radius & bit:
            same = counter if same is None else same & counter
        else:
            above = counter if same is None else same & counter
            over = above if over is None else over | above
            same = ~counter if same is None else same & ~counter
    return np.zeros_like(one) if over is None else over


def _used_planes(mask: int) -> np.ndarray:
    """The bits outside the mask: a bucket's fingerprints agree in the others."""
    return np.array([b for b in range(BITS) if not mask >> b & 1], np.int64)


def _spread(bits: np.ndarray) -> np.ndarray:
    return np.uint64(0) - bits.astype(np.uint64)


def pairs_in_runs(values: np.ndarray, begin: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x < y of values within the radius, in each run of at most 64 (begin has the runs' ends too)."""
    size = np.diff(begin)
    first, run = np.repeat(begin[:-1], size), np.repeat(np.arange(len(size)), size)
    lane = np.arange(len(values)) - first
    bits = _used_planes(mask)
    planes = planes_of(values, run * LANES + lane, len(size))[bits]
    later = np.arange(len(values))[lane < size[run] - 1]  # a row is compared with those after it
    found = []
    for at in range(0, len(later), WORDS):
        q = later[at : at + WORDS]
        ones = _spread((values[q] >> bits[:, None].astype(np.uint64)) & np.uint64(1))
        full = np.where(size[run[q]] == LANES, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (size[run[q]] % LANES).astype(np.uint64)) - np.uint64(1))
        after = full & (np.uint64(0xFFFFFFFFFFFFFFFE) << lane[q].astype(np.uint64))
        near = near_lanes(planes, ones, np.arange(len(q)), run[q], after, radius)
        hit = np.flatnonzero(near)
        row, bit = np.nonzero(np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        x = q[hit[row]]
        found.append((x, first[x] + bit))
    return (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def near_matrix(values: np.ndarray, mask: int, radius: int) -> np.ndarray:
    """Which of the values are within the radius of each other, for a block of more than a word."""
    n = len(values)
    words, bits = -(-n // LANES), _used_planes(mask)
    planes = planes_of(values, np.arange(n), words)[bits]
    valid = np.full(words, 0xFFFFFFFFFFFFFFFF, np.uint64)
    valid[-1] >>= np.uint64(words * LANES - n)
    good, step = np.zeros((n, n), bool), max(1, WORDS // words)
    for at in range(0, n, step):
        q = np.arange(at, min(at + step, n))
        ones = _spread((values[q] >> bits[:, None].astype(np.uint64)) & np.uint64(1))
        near = near_lanes(planes, ones, np.repeat(np.arange(len(q)), words), np.tile(np.arange(words), len(q)), np.tile(valid, len(q)), radius)
        good[q] = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")[:, :n]
    good[np.arange(n), np.arange(n)] = False
    return good


def _edges(tasks: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """a, b: links that connect the rows of each task (bucket, i, j, set, fp, component, side) as all links would.

    The rows of a task come together and are at most two blocks. Rows of one component, and in tasks of two blocks those of
    one side, are not compared.
    """

    def linked(values: np.ndarray, begin: np.ndarray, chosen: np.ndarray, component: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.diff(begin)
        two_sided = np.repeat(np.logical_or.reduceat(side > 0, begin[:-1]), size)
        for s, mask in enumerate(masks):
            runs = np.flatnonzero((chosen[begin[:-1]] == s) & (size > 1))
            small = runs[size[runs] <= LANES]
            if len(small):
                rows = np.repeat(begin[small] - np.cumsum(size[small]) + size[small], size[small]) + np.arange(size[small].sum())
                x, y = pairs_in_runs(values[rows], np.concatenate([[0], np.cumsum(size[small])]), mask, radius)
                x, y = rows[x], rows[y]
                across = (component[x] != component[y]) & ((side[x] != side[y]) | ~two_sided[x])
                yield x[across], y[across]
            for r in runs[size[runs] > LANES]:
                own = slice(begin[r], begin[r + 1])
                good = near_matrix(values[own], mask, radius) & (component[own][:, None] != component[own][None, :])
                if side[own].any():
                    good &= side[own][:, None] != side[own][None, :]
                x, y = _spanning(None, good)
                yield x + begin[r], y + begin[r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for last, batch in _with_end(batches):
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks()
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("bucket", "set", "i", "j")]
            begin = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1, [table.num_rows]])
            done = table.num_rows if last else begin[-2]
            rest = None if last else pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.slice(done).columns], schema=table.schema)
            begin = begin[begin <= done]
            if len(begin) < 2:
                continue
            values, chosen, component, side = (table.column(c).to_numpy()[:done] for c in ("fp", "set", "component", "side"))
            for x, y in linked(values.view(np.uint64), begin, chosen, component, side):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(values[x], values[y])), pa.array(np.maximum(values[x], values[y]))], ["a", "b"])

    dealt = tasks.select("bucket", "set", "i", "j", "side", "fp", "component").repartition("bucket", "set", "i", "j").sortWithinPartitions("set", "bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_fingerprints(classes: DataFrame, radius: int) -> DataFrame:
    """fp and component, the least fingerprint that links reach, of each of the distinct fingerprints that has a link."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the radius is from 0 to {MOST_RADIUS}")
    masks = part_masks(n_parts(classes.count(), radius), radius)
    opened = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> 63 else m)) for m in masks])).alias("set", "bucket")
    members = classes.select("fp", opened)
    large = common.stored(members.groupBy("set", "bucket").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > BLOCK), "large-buckets")
    block = F.coalesce(F.pmod(F.xxhash64("fp", "set"), F.ceil(F.col("held") / BLOCK)), F.lit(0)).alias("i")
    within = members.join(large, ["set", "bucket"], "left").select("bucket", "set", block, block.alias("j"), F.lit(0).alias("side"), "fp", F.col("fp").alias("component"))
    links = common.stored(_edges(within, masks, radius), "fingerprint-links")
    if large.isEmpty():
        return components(links).withColumnRenamed("node", "fp")
    labels = common.stored(components(links), "fingerprint-labels")
    known = members.join(large, ["set", "bucket"]).join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    rows = known.select(F.struct("set", "bucket").alias("group"), F.col("fp").alias("class"), F.lit(0).alias("n"), F.coalesce("component", "fp").alias("component"))
    across = _across_blocks(rows, "group", BLOCK)
    more = _edges(across.select("group.bucket", "group.set", "i", "j", "side", F.col("class").alias("fp"), "component"), masks, radius)
    return components(links.unionByName(common.stored(more, "fingerprint-links"))).withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hexadecimal digits), component_id.

    Documents are linked where their fingerprints differ in at most so many bits; component_id is the least identifier
    that links reach. Null and empty texts and those of white space have the fingerprint zero and are linked like any
    other. Rows that share an identifier or a text each have their row. Rows without an identifier have a fingerprint,
    are linked with nothing and have no component_id. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            values = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    prints = common.stored(own.mapInArrow(run, "_id long, fp long"), "fingerprints")
    with common.scratch(docs.sparkSession):
        classes = common.stored(prints.filter("_id IS NOT NULL").groupBy("fp").agg(F.min("_id").alias("least")), "fingerprint-classes")
        found = classes.join(near_fingerprints(classes.select("fp"), radius), "fp")
        groups = found.groupBy("component").agg(F.min("least").alias("_component"))
        # Only fingerprints of a link or with copies need a row: the others are their own components.
        known = common.stored(found.select("fp", "component").join(groups, "component").select("fp", "_component"), "fingerprint-groups", outlive=True)
        known = common.stored(classes.join(known, "fp", "left").select("fp", F.coalesce("_component", "least").alias("_component")), "fingerprint-groups", outlive=True)
    return prints.join(known, "fp", "left").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("_component")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.documents(spark, sf_dir))
