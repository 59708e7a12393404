"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash, in an order that does not depend on the number of partitions. A document's virtual finish time is the sum of its source's words up to
and with it, divided by the source's target, so all sources advance at the pace of their targets; a second pass over a
source continues its count. The copies are sorted by finish time over all sources and cut where the total budget ends.

Both running sums are taken in two steps, since one source may hold a third of all rows: sums of small buckets first,
then sums within a bucket. Between equal steps of virtual time lie about as many words of the mix, so
equal steps serve as splitters of the global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, TOTAL, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2
BUCKETS_A_PARTITION = 8


def _before(order: list) -> Window:
    return Window.orderBy(*order)


def _weighted(sizes: DataFrame, weights: Sequence[float], epochs: int) -> DataFrame:
    """Add _weight and _cap. Sources are ranked in ranges of their own, and each range starts where those before end."""
    order = F.col("source").asc_nulls_last()
    ranged = common.stored(sizes.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged-sources")
    held = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))  # a row for each partition
    starts = held.select("_range", F.coalesce(F.sum("_held").over(_before(["_range"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    turn = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(cycle, F.pmod(F.col("_turn"), F.lit(len(weights))).cast("int"))
    return ranged.join(starts, "_range").withColumn("_turn", turn).select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * float(epochs)).alias("_cap"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of a table with one row for each source.

    Sources in code point order, null last, get the weights in turn. The budget, total times all sizes, is shared by
    weight; no target is above epochs times its source's size, and what is above is shared again by weight. So a target
    is a common level times the weight, cut at the cap. Each round sums the caps below the level and the weights above
    it, which gives the next level; it ends when no further source is at its cap. Three numbers a round reach the driver.
    An empty table gives an empty result.
    """
    own = common.stored(_weighted(sizes, weights, epochs), "weighted-sources")
    level, full = 0.0, -1
    while True:
        at_cap = F.col("_cap") <= F.lit(level) * F.col("_weight")
        row = own.agg(
            (F.sum("source_size") * float(total)).alias("budget"), F.count_if(at_cap).alias("full"), F.coalesce(F.sum(F.when(at_cap, F.col("_cap"))), F.lit(0.0)).alias("caps"), F.sum(F.when(~at_cap, F.col("_weight"))).alias("open")
        ).first()
        if row.full == full or not row.open:
            level = level if row.open else float("inf")
            break
        level, full = (row.budget - row.caps) / row.open, row.full
    target = F.col("_cap") if level == float("inf") else F.least("_cap", F.lit(level) * F.col("_weight"))
    return own.select("source", "source_size", target.alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[Column], size: str) -> DataFrame:
    """Add _sum: the sizes of a group's rows before and with each row, in order of bucket, then order."""
    sums = df.groupBy(*group, bucket).agg(F.sum(size).alias("_held"))
    past = (Window.partitionBy(*group) if group else Window).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, bucket])], F.coalesce(F.sum("_held").over(past), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [df[c].eqNullSafe(starts[f"_g{i}"]) for i, c in enumerate([*group, bucket])]
    return df.join(starts, on).withColumn("_sum", F.col("_start") + F.sum(size).over(within)).drop(*[f"_g{i}" for i in range(len(group) + 1)], "_start")


def _sized(row: Column, doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [row.alias("_row"), doc_id.alias("_id"), source.alias("source"), common.n_words(text.cast("string")).alias("size"), F.xxhash64(doc_id, F.lit(20)).alias("_u")]


def _queued(sized: DataFrame, weights: Sequence[float], total: float, epochs: int) -> tuple[DataFrame, DataFrame]:
    """The sized rows with their targets, and the copies that the mix takes; _row tells rows apart in both."""
    spark = sized.sparkSession
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    aims = common.stored(
        targets(by_source.select("source", "source_size"), weights, total, epochs)
        .join(by_source.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets",
    ).withColumnRenamed("source", "_s")
    row = aims.agg(F.sum("_docs").alias("docs"), F.sum("target").alias("budget")).first()
    n_docs, budget = row.docs or 0, float(row.budget or 0)
    many = BUCKETS_A_PARTITION * common.shuffle_partitions(spark)
    # Targets are a row for each source; Spark broadcasts them where they are below its limit and merges otherwise.
    aimed = sized.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    place = F.pmod(F.col("_u"), F.lit(1 << 30))
    share = place / float(1 << 30)
    queues = aimed.filter("size > 0 AND target > 0").withColumn("_bucket", F.floor(share * F.ceil(F.col("_docs") / max(1.0, n_docs / many))))
    shuffled = _running(queues, ["source"], "_bucket", [place, F.col("_u"), F.col("_id").asc_nulls_last(), F.col("_row")], "size")
    copies = shuffled.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("virtual_time", (F.col("source_size") * F.col("epoch") + F.col("_sum")) / F.col("target"))
    timed = common.stored(
        copies.withColumn("_range", F.least(F.floor(F.col("virtual_time") * many), F.lit(4 * many))).drop("_sum", "_bucket", "_docs"), "virtual-times"
    )
    # Whole ranges beyond the budget are cut first, so that only what may be taken is sorted.
    before = F.sum("_held").over(_before(["_range"]).rowsBetween(Window.unboundedPreceding, -1))
    ranges = timed.groupBy("_range").agg(F.sum("size").alias("_held")).withColumn("_start", F.coalesce(before, F.lit(0)))
    last = ranges.filter(F.col("_start") <= budget).agg(F.max("_range").alias("last")).first().last
    order = [F.col("virtual_time"), F.col("source").asc_nulls_last(), F.col("_u"), F.col("_id").asc_nulls_last(), F.col("_row"), F.col("epoch")]
    taken = _running(timed.filter(F.col("_range") <= F.lit(last)), [], "_range", order, "size").filter(F.col("_sum") <= budget)
    return aimed, taken


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """What the mix takes of each row: id_col, size, source_size, target, taken (words, copies counted).

    Size is the number of words; null and empty texts have none and are never taken. Null is a source of its own, the
    last. Rows that share an identifier are rows of their own. Other columns are not read; an empty table gives an
    empty result.
    """
    own = docs.select(*_sized(F.monotonically_increasing_id(), F.col(id_col), F.col(source_col), F.col(text_col)))
    aimed, taken = _queued(common.stored(own, "sized"), weights, total, epochs)
    counts = taken.groupBy("_row").agg(F.sum("size").alias("_taken"))
    return aimed.join(counts, "_row", "left").select(
        F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix with all columns of docs, a row for each copy that is taken; the rules are those of mix_plan.

    The rows are written once with a number of their own, so that rows sharing an identifier are taken each for itself.
    """
    rows = common.stored(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    of = lambda name: F.col("_doc").getField(name)
    sized = common.stored(rows.select(*_sized(F.col("_row"), of(id_col), of(source_col), of(text_col))), "sized")
    _, taken = _queued(sized, weights, total, epochs)
    times = taken.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    return rows.join(times, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_doc.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.documents(spark, sf_dir))
