"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation on full shingle sets.

1. Each text gives a set of shingle hashes, MinHash samples grouped in bands, and an odd sketch: each sample, with its
   number, flips one bit of a bitmap. Texts with one set form a class and go on as one.
2. Classes with a band in common are a bucket. Buckets are compared in tasks of bounded size that move sketches alone,
   64 bytes a class: the XOR of two odd sketches tells how many samples differ, and with that how alike the sets are.
3. Nearest first: each bucket is dealt to blocks, each class picks its likeliest few partners, and for these pairs alone
   the sets are fetched and intersected. Linked classes become one component, which covers most of a large group.
4. The rest: the sketches of different components in a bucket are compared again, over all blocks. Classes with a partner
   that could still be a link are clusters; as long as a cluster has several components, its sets are intersected in
   tasks of two blocks, passing over what is one component already. No link between different components is missed.

No step makes a row for each pair of a group. A component of any size against a few other rows costs its size; only sets
that sketches cannot tell from links without being links are compared all with all, blockwise.

Bands are as many as needed for a chance below ``MISS`` to have none in common at the similarity asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .rolling import mixed, word_hashes

ROWS, MISS, SKETCH_BITS, SLACK = 5, 1e-7, 512, 6.5
#: Classes and shingles in a block, and the likeliest partners that a class picks.
BLOCK_ROWS, BLOCK_SHINGLES, NEAREST = 256, 1 << 20, 3
#: Classes that are few enough to go to every task, a few megabytes, so that the texts stay where they are.
FEW = 1 << 17
SEED = 20


def n_bands(percent: int, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles; of fewer words the sequence as one; none of no words."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A to Z alone
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)[:, 0]
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - width + 1 + i])
    return np.unique(out)


class Sketcher:
    """Bands and odd sketch of a set."""

    def __init__(self, bands: int, rows: int = ROWS, bits: int = SKETCH_BITS):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows, self.bits, self.n = bands, rows, bits, bands * rows
        self.a = rng.integers(0, 1 << 63, self.n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.n, np.uint64)
        self.place = np.arange(self.n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 512):
            np.minimum(least, (shingles[k : k + 512, None] * self.a + self.b).min(0), out=least)
        return least

    def digest(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        samples = mixed(self.samples(shingles) + self.place)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in samples.reshape(self.bands, self.rows).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
        odd = np.bincount((samples >> np.uint64(20)).astype(np.int64) % self.bits, minlength=self.bits) & 1
        return key.view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()

    def most_flips(self, percent: int) -> int:
        """XOR bits that a pair of at least this similarity exceeds by chance once in some 10^10 cases: each of its
        differing samples flips two bits at most, and their number is binomial."""
        p = 1 - percent / 100
        return math.ceil(2 * (self.n * p + SLACK * math.sqrt(self.n * p * (1 - p))))


def _digests(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, marked: bool = False) -> DataFrame:
    """A row for each row of docs; marked adds a hash of its text, which with the identifier tells its rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketcher(n_bands(percent))
        for batch in common.slices(batches, 1):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text, k)
                bands, odd = own.digest(found) if len(found) else (None, None)
                rows.append((i, len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None, bands, odd))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            names = ["_id", "n", "class", "bands", "odd"]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], *batch.columns[2:]], [*names, "_mark"] if marked else names)

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *[_mark(F.col(text_col)).alias("_mark")] * marked)
    return own.mapInArrow(run, "_id long, n long, class binary, bands array<long>, odd binary" + ", _mark long" * marked)


def _mark(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int, few: bool = False) -> DataFrame:
    """class and shingles, its set, of wanted classes (class, least), from the text of each one's least document.

    Their number grows with the documents, so the texts come by a merge join at every size, unless they are known to be few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0):
            sets = [shingle_set(t, k) for t in batch.column(0).to_pylist()]
            keep = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == c for s, c in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "shingles"]).filter(keep)

    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(wanted) if few else wanted.hint("merge"), "least")
    # Where rows repeat an identifier, a class may be met twice, with the same set.
    return texts.select("_text", "class").mapInArrow(run, "class binary, shingles binary").dropDuplicates(["class"])


def _possible(flips: np.ndarray, n: np.ndarray, m: np.ndarray, component: np.ndarray, other: np.ndarray, percent: int, most_flips: int) -> np.ndarray:
    """Whether two sets of these sizes, of different components, may be a link."""
    return (flips <= most_flips) & (component != other) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _candidates(odd: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int, most_flips: int) -> tuple[np.ndarray, np.ndarray]:
    """The XOR of the sketches of all rows of a task, and whether two rows may be a link; rows of two sides only across."""
    flips = np.bitwise_count(odd[:, None, :] ^ odd[None, :, :]).sum(2, dtype=np.int64)
    good = _possible(flips, n[:, None], n[None, :], component[:, None], component[None, :], percent, most_flips)
    return flips, good & (side[:, None] != side[None, :]) if side.any() else good


def _nearest(flips: np.ndarray, good: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row with its likeliest partners."""
    k = min(nearest, len(flips))
    y = np.argpartition(np.where(good, flips, np.iinfo(np.int64).max), k - 1, axis=1)[:, :k].ravel()
    x = np.repeat(np.arange(len(flips)), k)
    return x[good[x, y]], y[good[x, y]]


def _spanning(flips: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the good pairs connect, less than one a row."""
    root = np.full(len(good), -1)
    for x in np.flatnonzero(good.any(1)):
        if root[x] < 0:
            root[x], ahead = x, np.array([x])
            while len(ahead):
                ahead = np.flatnonzero(good[ahead].any(0) & (root < 0))
                root[ahead] = x
    y = np.flatnonzero((root >= 0) & (root != np.arange(len(root))))
    return root[y], y


def _pairs(tasks: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """a, b: pairs of classes that may be links, of the rows of tasks (band, i, j, side, class, odd, n, component).

    The rows of a task come together and are at most two blocks. Of each class at most the nearest so many partners over
    all its tasks stay; it is ranked by its own choices alone, so a class that very many choose is no hot key. Without
    nearest, of each task just edges that connect the same rows as all its pairs.
    """
    most_flips = Sketcher(n_bands(percent)).most_flips(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for last, batch in _with_end(batches):
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks()
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
            begin = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1, [table.num_rows]])
            done = table.num_rows if last else begin[-2]
            rest = None if last else pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.slice(done).columns], schema=table.schema)
            own = table.slice(0, done)
            classes = own.column("class").combine_chunks()
            odd = np.frombuffer(b"".join(own.column("odd").to_pylist()), np.uint64).reshape(done, -1)
            side, n = own.column("side").to_numpy(), own.column("n").to_numpy()
            component = own.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
            found = []
            begin = begin[begin <= done]
            size = np.diff(begin)
            two = begin[:-1][size == 2]  # by far the most
            flips = np.bitwise_count(odd[two] ^ odd[two + 1]).sum(1, dtype=np.int64)
            good = _possible(flips, n[two], n[two + 1], component[two], component[two + 1], percent, most_flips)
            found.append((two[good], two[good] + 1, flips[good]))
            for start, end in zip(begin[:-1][size > 2], begin[1:][size > 2], strict=True):
                rows = slice(start, end)
                far, near = _candidates(odd[rows], n[rows], component[rows], side[rows], percent, most_flips)
                x, y = _nearest(far, near, nearest) if nearest else _spanning(far, near)
                found.append((x + start, y + start, far[x, y]))
            x, y, flips = (np.concatenate(part) for part in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([classes.take(pa.array(x)), classes.take(pa.array(y)), pa.array(flips.astype(np.int32))], ["x", "y", "flips"])

    dealt = tasks.select("band", "i", "j", "side", "class", "odd", "n", "component").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    found = dealt.mapInArrow(run, "x binary, y binary, flips int")
    if nearest:
        chosen = found.groupBy("x").agg(F.collect_set(F.struct("flips", "y")).alias("_all"))
        found = chosen.select("x", F.explode(F.slice(F.array_sort("_all"), 1, nearest)["y"]).alias("y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch, and whether it is the last one."""
    held = next(batches, None)
    for batch in batches:
        yield False, held
        held = batch
    if held is not None:
        yield True, held


def _within_blocks(members: DataFrame) -> DataFrame:
    """Each bucket dealt to blocks, every block a task; each bucket deals its classes in another way."""
    block = F.pmod(F.xxhash64("class", "band"), F.ceil(F.col("held") / BLOCK_ROWS))
    return members.select("band", block.alias("i"), block.alias("j"), F.lit(0).alias("side"), "class", "component")


def _across_blocks(rows: DataFrame, group: str, block_rows: int | None = None) -> DataFrame:
    """The pairs of different components in each group of rows (group, class, n, component) as tasks of two blocks: blocks of
    the rows outside the group's largest component are compared with each other and with those of that component. Groups
    of one component are left out."""
    size = block_rows or BLOCK_ROWS
    parts = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"))
    sizes = parts.groupBy(group).agg(
        F.max_by(F.struct("component", "held", "shingles"), F.struct("held", "component")).alias("main"), F.sum("held").alias("held"), F.sum("shingles").alias("shingles")
    ).filter("main.held < held")
    blocks = lambda held, shingles: F.greatest(F.ceil(held / size), F.ceil(shingles / BLOCK_SHINGLES))
    sizes = sizes.select(
        group, F.col("main.component").alias("main"), blocks(F.col("main.held"), F.col("main.shingles")).alias("many"),
        blocks(F.col("held") - F.col("main.held"), F.col("shingles") - F.col("main.shingles")).alias("others"),
    )
    met = rows.join(common.stored(sizes, "group-sizes"), group)
    main = F.col("component") == F.col("main")
    own = F.when(main, -1 - F.pmod(F.xxhash64("class"), F.col("many"))).otherwise(F.pmod(F.xxhash64("class"), F.col("others")))
    outside, inside = F.sequence(F.lit(0).cast("long"), F.col("others") - 1), F.sequence(-F.col("many"), F.lit(-1).cast("long"))
    opened = met.withColumn("_own", own).withColumn("_other", F.explode(F.when(main, outside).otherwise(F.concat(inside, outside))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return opened.select(group, low.alias("i"), high.alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "class", "component")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a binary, b binary")


def _intersected(flips: np.ndarray, good: np.ndarray, sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the good pairs that join the rows as all links would, likeliest first."""
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([0, *map(len, sets)])
    group, mask, links = component.copy(), np.zeros(len(flat), bool), []
    for x in range(len(sets)):
        near = np.flatnonzero(good[x, :x] & (group[:x] != group[x]))
        if not len(near):
            continue
        mine = ids[ends[x] : ends[x + 1]]
        mask[mine] = True
        for y in near[np.argsort(flips[x, near])]:
            if group[y] != group[x]:
                both = int(np.count_nonzero(mask[ids[ends[y] : ends[y + 1]]]))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    links.append((x, y))
                    group[group == group[y]] = group[x]
        mask[mine] = False
    return links


def _links_of_tasks(tasks: DataFrame, percent: int) -> DataFrame:
    """a, b: links of the rows of tasks (cluster, i, j, side, class, odd, component, shingles)."""
    most_flips = Sketcher(n_bands(percent)).most_flips(percent)

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.int64) for s in table.column("shingles").to_pylist()]
        odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(len(sets), -1)
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        flips, good = _candidates(odd, np.array([*map(len, sets)]), component, table.column("side").to_numpy(), percent, most_flips)
        links = _intersected(flips, good, sets, component, percent) if len(sets) else []
        classes = table.column("class").to_pylist()
        return pa.table({"a": pa.array([classes[x] for x, _ in links], pa.binary()), "b": pa.array([classes[y] for _, y in links], pa.binary())})

    return tasks.select("cluster", "i", "j", "side", "class", "odd", "component", "shingles").groupBy("cluster", "i", "j").applyInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked where 100 * shared >= percent * all distinct k-word shingles; component_id is the least
    identifier that links reach, and kept tells the document that has it. Texts without words have no shingles and are
    linked with nothing. Rows that share an identifier and a set are kept or dropped together. Rows without an
    identifier are linked with nothing: their component_id is null and they are kept. An empty table gives an empty
    result; other columns are not read.
    """
    return _groups(docs, id_col, text_col, k, percent)


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, marked: bool = False) -> DataFrame:
    """near_groups, and if marked the mark of each row."""
    digests = common.stored(_digests(docs, id_col, text_col, k, percent, marked), "digests")
    with common.scratch(docs.sparkSession):
        known = common.stored(_class_groups(docs, digests, id_col, text_col, k, percent), "class-groups", outlive=True)
    found = digests.select("_id", "n", "class", *["_mark"] * marked).join(known, "class", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"), *["_mark"] * marked)


def _class_groups(docs: DataFrame, digests: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """class and _component, the least identifier that links reach, of each class."""
    with_id = digests.filter("_id IS NOT NULL AND n > 0")
    classes = common.stored(with_id.groupBy("class").agg(F.min("_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    banded = common.stored(classes.select("class", F.explode("bands").alias("band")), "bands")
    buckets = common.stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "buckets")
    members = common.stored(banded.join(buckets, "band"), "members")

    sketches = classes.select("class", "n", "odd")
    first = _within_blocks(members.withColumn("component", F.col("class")))
    pairs = common.stored(_pairs(first.join(sketches, "class"), percent, NEAREST), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "least"), "class")
    sets = common.stored(_sets(docs, common.stored(paired, "wanted"), id_col, text_col, k), "sets")
    links = common.stored(_links(pairs, sets, percent), "links")
    labels = common.stored(components(links), "labels")

    component = F.coalesce("component", "class").alias("component")
    labelled = members.join(labels.withColumnRenamed("node", "class"), "class", "left").join(classes.select("class", "n"), "class").select("band", "class", "n", component)
    left = _pairs(_across_blocks(labelled, "band").join(sketches, "class"), percent, None)
    clusters = common.stored(components(left).select(F.col("node").alias("class"), F.col("component").alias("cluster")), "clusters")
    if not clusters.isEmpty():
        rows = clusters.join(labels.withColumnRenamed("node", "class"), "class", "left").join(classes.select("class", "n"), "class").select("cluster", "class", "n", component)
        tasks = _across_blocks(rows, "cluster").join(sketches.select("class", "odd"), "class")
        lacking = common.stored(clusters.join(sets, "class", "left_anti").join(classes.select("class", "least"), "class"), "wanted")
        n = lacking.count()
        if n:  # classes that met their partners in other blocks only
            sets = sets.unionByName(common.stored(_sets(docs, lacking, id_col, text_col, k, few=n <= FEW), "sets"))
        more = common.stored(_links_of_tasks(tasks.join(sets, "class"), percent), "links")
        labels = common.stored(components(links.unionByName(more)), "labels")

    joined = classes.select("class", "least").join(labels.withColumnRenamed("node", "class"), "class")
    groups = joined.groupBy("component").agg(F.min("least").alias("_component"))
    grouped = common.stored(joined.select("class", "component").join(groups, "component").select("class", "_component"), "groups")
    return classes.select("class", "least").join(grouped, "class", "left").select("class", F.coalesce("_component", "least").alias("_component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The kept rows of docs with all their columns; the rules are those of near_groups.

    A row is told by its identifier and its text, so that rows of one identifier are kept or dropped each for its own set.
    """
    dropped = _groups(docs, id_col, text_col, k, percent, marked=True).filter("NOT kept").select(F.col(id_col).alias("_dropped"), "_mark").distinct()
    return docs.join(dropped, (docs[id_col] == dropped["_dropped"]) & (_mark(docs[text_col]) == dropped["_mark"]), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir), k=3, percent=85)
