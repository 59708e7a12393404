"""Ranked lexical search by per-term geometric blocking.

1. Texts are counted: of each document its terms that any query has, with their number, and its length.
2. Documents are dealt to shards. In a shard each term has a posting list; a long list is clustered by the likeness of its
   documents (the nearest of some of its own documents in a random projection of their weighted terms), and each block of
   the list keeps, for each term that is not rarer, the largest impact of any of its documents. Shards are the index,
   written as a table.
3. A query goes through its lists from the rarest term on. A document is met first in the list of its rarest term, so the
   maxima of the terms that are not rarer bound its score: a block is skipped only when that sum is below the score that
   is needed for the best k so far, the rest of the lists when the sum of the shard's maxima is. Of the other blocks the
   whole scores are computed.

Scores are whole numbers and bounds never too low, so the results are those of scoring all documents. Each task gives
its best of each query, and a window takes the best of all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Query terms (repeats over queries included) that are searched for in one go: they go to every task.
GROUP_TERMS = 1 << 18
#: Documents and postings of a shard, shards of a file, documents of a block on average, terms from which a document is scored in any case.
SHARD_DOCS, SHARD_POSTINGS, FILE_SHARDS, BLOCK_DOCS, HEAVY = 2048, 1 << 18, 4, 32, 1024
#: Dimensions of the projection, and the unit in which maxima are kept, rounded up.
DIMENSIONS, UNIT, SEED = 16, 16, 13
#: What stands for a missing identifier: it comes last among equal scores.
NO_ID = (1 << 63) - 1

# What parts terms, and the same with A-Z to lower case, for each byte of UTF-8.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SHARD = "docs binary, ends binary, terms binary, impacts binary, lists binary, postings binary, list_blocks binary, block_ends binary, summary_ends binary, summary_terms binary, summary_most binary"
#: Types of a shard's arrays; term is the smallest that holds all terms of the group.
TYPES = {"docs": "<i8", "ends": "<i8", "terms": "term", "impacts": "<i4", "lists": "<i8", "postings": "<u2", "list_blocks": "<i8", "block_ends": "<i4", "summary_ends": "<i8", "summary_terms": "term", "summary_most": "<u2"}


def types_of(n_terms: int) -> dict[str, str]:
    return {c: ("<u2" if n_terms <= 1 << 16 else "<i4") if t == "term" else t for c, t in TYPES.items()}


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from begin to end, one span after the other."""
    sizes = end - begin
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes) if total else np.empty(0, np.int64)


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """_id, n (terms of the text, repeats included), terms (places in the vocabulary) and their counts, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in common.slices(batches, 1):
            lengths, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                all_terms = terms_of(text)
                found = Counter(filter(place.__contains__, all_terms))
                lengths.append(len(all_terms))
                terms += map(place.__getitem__, found)
                counts += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["_id", "n", "terms", "counts"])

    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(run, "_id long, n long, terms array<int>, counts array<long>")


def build_shards(counted: DataFrame, documents: int, total: int, rank: np.ndarray, weight: np.ndarray, shard_docs: int, shard_postings: int) -> DataFrame:
    """The index: a row for each shard. rank orders the terms from the rarest on, weight is by rank."""
    norm = F.expr(f"50 + (CAST(n AS DECIMAL(18,0)) * CAST('{50 * documents}' AS DECIMAL(20,0))) div {max(total, 1)}")
    own = counted.filter("size(terms) > 0").select("_id", norm.cast("long").alias("norm"), "terms", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = np.random.default_rng(SEED).standard_normal((len(rank), DIMENSIONS), np.float32)
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            ids, norms, sizes, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = make_shard(ids, norms, sizes, rank[terms], counts, weight, project)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard[c].astype(t).tobytes()], pa.binary()) for c, t in types_of(len(rank)).items()], list(TYPES))

        for batch in batches:
            at = 0
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                rows, postings = sum(len(x[0]) for x in held), sum(len(x[3]) for x in held)
                before = ends[at - 1] if at else 0
                end = min(batch.num_rows, at + shard_docs - rows, max(at + (not held), int(np.searchsorted(ends, before + shard_postings - postings, "right"))))
                if end > at:
                    part = batch.slice(at, end - at)
                    held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), sizes[at:end], part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                    at = end
                if at < batch.num_rows:
                    yield packed()
        if held:
            yield packed()

    return own.mapInArrow(run, SHARD)


def _clusters(sketch: np.ndarray) -> np.ndarray:
    """The number of the block of each document: that of the likest of some of the documents, numbered without gaps."""
    n = -(-len(sketch) // BLOCK_DOCS)
    centres = sketch[np.arange(n) * len(sketch) // n]
    return np.unique(np.argmax(sketch @ centres.T, axis=1), return_inverse=True)[1]


def _maxima(block: np.ndarray, term: np.ndarray, impact: np.ndarray, blocks: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block, term and largest impact of each term of each block, in this order."""
    if blocks * width <= 8 * len(block):
        most = np.zeros((blocks, width), np.int32)
        np.maximum.at(most, (block, term), impact)
        row, column = np.nonzero(most)
        return row, column, most[row, column]
    key = block * width + term
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    key = key[order[begin]]
    return key // width, key % width, np.maximum.reduceat(impact[order], begin)


def make_shard(ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, project: np.ndarray) -> dict[str, np.ndarray]:
    """Documents with their terms from the rarest on, posting lists in blocks, and the blocks' summaries."""
    docs = np.repeat(np.arange(len(ids)), sizes)
    order = np.lexsort((terms, docs))
    terms, counts = terms[order].astype(np.int64), counts[order].astype(np.int64)
    impacts = (1_000_000_000 * counts // (1000 * counts + 20 * norms[docs])).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    value = weight[terms] * impacts.astype(np.float64)
    sketch = np.stack([np.bincount(docs, value * project[terms, d], len(ids)) for d in range(project.shape[1])], 1)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1), 1e-9)[:, None]

    n_terms = len(weight)
    entries = np.flatnonzero(sizes[docs] <= HEAVY)
    entries = entries[np.argsort(terms[entries], kind="stable")]  # of each posting the place of its term in the document
    lists = np.searchsorted(terms[entries], np.arange(n_terms + 1))
    block_ends, blocks_of = [0], np.zeros(n_terms, np.int64)
    parts, sizes_of = [(np.empty(0, np.int64), np.empty(0, np.int32))], [np.zeros(1, np.int64)]
    for t in np.flatnonzero(np.diff(lists) > BLOCK_DOCS):
        own = entries[lists[t] : lists[t + 1]]
        label = _clusters(sketch[docs[own]])
        order = np.argsort(label, kind="stable")
        entries[lists[t] : lists[t + 1]] = own = own[order]
        held = np.bincount(label)
        # Of each document the terms from this one on: it has been met in the lists of those that are rarer.
        last = ends[docs[own] + 1]
        span = _spans(own, last)
        row, column, most = _maxima(np.repeat(label[order], last - own), terms[span] - t, impacts[span], len(held), n_terms - t)
        parts.append((column + t, -(-most // UNIT)))
        sizes_of.append(np.bincount(row, minlength=len(held)))
        block_ends += (lists[t] + np.cumsum(held)).tolist()
        blocks_of[t] = len(held)
    return {
        "docs": ids, "ends": ends, "terms": terms, "impacts": impacts, "lists": lists, "postings": docs[entries], "list_blocks": np.concatenate([[0], np.cumsum(blocks_of)]),
        "block_ends": np.array(block_ends), "summary_ends": np.cumsum(np.concatenate(sizes_of)), "summary_terms": np.concatenate([p[0] for p in parts]), "summary_most": np.concatenate([p[1] for p in parts]),
    }


class Shard:
    """A shard as read back."""

    def __init__(self, arrays: dict[str, np.ndarray], n_terms: int):
        self.__dict__ |= arrays
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.terms, self.impacts)
        self.heavy = np.flatnonzero(np.diff(self.ends) > HEAVY)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        begin, end = self.ends[docs], self.ends[docs + 1]
        span = _spans(begin, end)
        return np.add.reduceat(weight[self.terms[span]] * self.impacts[span], np.cumsum(end - begin) - (end - begin))

    def survivors(self, term: int, weight: np.ndarray, need: int) -> np.ndarray:
        """The documents of a term's list, but for the blocks whose bound is below the score that is needed."""
        low, high = self.lists[term], self.lists[term + 1]
        first, last = self.list_blocks[term], self.list_blocks[term + 1]
        if first == last:
            return self.postings[low:high].astype(np.int64)
        at = self.summary_ends[first]
        span = slice(at, self.summary_ends[last])
        bound = np.add.reduceat(weight[self.summary_terms[span]] * (self.summary_most[span].astype(np.int64) * UNIT), self.summary_ends[first:last] - at)
        kept = np.flatnonzero(bound >= need)
        ends = self.block_ends[first + 1 : last + 1].astype(np.int64)
        begin = np.concatenate([[low], ends[:-1]])
        return self.postings[_spans(begin[kept], ends[kept])].astype(np.int64)

    def search(self, terms: np.ndarray, own: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, identifiers) with this shard's documents. weight has own at the terms, else zeros."""
        seen = np.zeros(len(self.docs), bool)
        there = self.most[terms] > 0
        terms, own = terms[there], own[there]
        rest = np.cumsum((own * self.most[terms])[::-1])[::-1]
        for i, t in enumerate([None, *terms]):
            need = max(1, int(best[0][-1])) if len(best[0]) == k else 1
            if t is not None and rest[i - 1] < need:
                break
            docs = self.heavy if t is None else self.survivors(t, weight, need)
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                scores = self.scores(docs, weight)
                good = scores >= need
                best = _best(np.concatenate([best[0], scores[good]]), np.concatenate([best[1], self.docs[docs[good]]]), k)
        return best


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def best_of_shards(shards: DataFrame, queries: list[tuple[int, np.ndarray]], weight: np.ndarray, k: int) -> DataFrame:
    """query, _id and score: each task's k best documents of each query (number, terms by rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        own = np.zeros(len(weight), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in types_of(len(weight)).items()}, len(weight))
                for q, (_, terms) in enumerate(queries):
                    own[terms] = weight[terms]
                    best[q] = shard.search(terms, weight[terms], own, best[q], k)
                    own[terms] = 0
        numbers = np.repeat(np.array([n for n, _ in queries], np.int64), [len(s) for s, _ in best])
        empty = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([empty, *[i for _, i in best]])), pa.array(np.concatenate([empty, *[s for s, _ in best]]))], ["query", "_id", "score"])

    return shards.select(*TYPES).mapInArrow(run, "query long, _id long, score long")


def _asked_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(common.lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", group_terms: int | None = None
) -> DataFrame:
    """query_id, rank, doc_id and score: of each query the k documents with the highest scores above 0, equal ones by identifier.

    Terms are runs of ASCII letters and digits and of other characters outside ASCII, A-Z in lower case; a query's terms
    count once. Scores and statistics are those of the contract: all documents with a term count, also those that no
    query finds. Null and empty texts have no terms, and a query without terms has no rows. Rows that repeat an identifier
    are ranked each for itself, documents as well as queries; documents without an identifier come last among equal
    scores. Without documents or queries there are no rows; other columns are not read.

    Queries go to the tasks in groups of about ``group_terms`` terms, and each group reads the documents once.
    """
    asked = queries.select(F.col(query_id).alias("_item"), _asked_terms(F.col(query_text).cast("string")).alias("_terms")).filter("size(_terms) > 0")
    asked = common.stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    held = asked.agg(F.sum(F.size("_terms")).alias("n")).first().n or 0
    groups = -(-held // (group_terms or GROUP_TERMS))
    found = None
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).select("query", "_terms").collect()
        part = _search_group(docs, [(r.query, [t.encode() for t in r["_terms"]]) for r in own], k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query long, _id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col)
    return ranked.join(asked.select("query", "_item"), "query").select(F.col("_item").alias(query_id), "rank", named, "score")


def _search_group(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary = sorted({t for _, terms in queries for t in terms})
    counted = common.stored(count_terms(docs, id_col, text_col, vocabulary), "counted-terms")
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the group at most
        held[r["term"]] = r["count"]
    order = np.argsort(held, kind="stable")
    rank = np.empty(len(vocabulary), np.int64)
    rank[order] = np.arange(len(vocabulary))
    weight = np.floor(1000 * np.log((2 * totals.documents + 2) / (2 * held[order] + 1))).astype(np.int64)
    built, path = build_shards(counted, totals.documents, totals.total, rank, weight, SHARD_DOCS, SHARD_POSTINGS), common.shared_folder(docs.sparkSession, "index-shards")
    built.write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)  # so that no task has to take many shards at once
    shards = docs.sparkSession.read.schema(built.schema).parquet(path)
    place = {t: rank[i] for i, t in enumerate(vocabulary)}
    return best_of_shards(shards, [(n, np.sort(np.array([place[t] for t in terms], np.int64))) for n, terms in queries], weight, k)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{TERM}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS c FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL HAVING sum(c) > 0),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
