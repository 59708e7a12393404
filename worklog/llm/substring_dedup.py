"""Removal of repeated passages by Rabin-Karp hashes of every window of words.

A window is removed where an equal one starts in a document with a smaller identifier. Sending a row for every window
would move many times the input, so windows travel in runs. In each window the 8-word run with the least hash is its
anchor; neighbouring windows with the same anchor form a run of windows, which is sent as one row: the anchor's hash, the
hash of all words that the run covers, and where it is. Equal windows have equal anchors, hence:

1. Anchors found under one identifier alone cannot be in repeated windows; their runs end here.
2. A run of windows that as a whole is found under a smaller identifier is removed as a whole.
3. Where an anchor has runs that differ, the windows of each such run in its first document are hashed and counted one by
   one. The other documents with that run were settled in step 2.

No window is lost: each is settled with its run or counted alone. Removed windows merge into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .rolling import Rolling, mixed, word_hashes

LENGTH, GRAM = 50, 8
#: Windows of one text that are taken in hand at once; a run of windows ends there.
SEGMENT = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Rows without an identifier count as larger than any other.
NO_ID = (1 << 63) - 1


class Windows:
    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.one, self.two = (Rolling(b) for b in BASES)

    def runs(self, words: list[bytes], segment: int | None = None) -> tuple[np.ndarray, ...]:
        """anchor, covered words, first window and number of windows of each run."""
        segment, none = segment or SEGMENT, np.empty(0, np.uint64)
        parts = [(none, none, none.view(np.int64), none.view(np.int64))]
        for at in range(0, len(words) - self.length + 1, segment):
            anchor, covered, start, count = self._runs(words[at : at + segment + self.length - 1])
            parts.append((anchor, covered, start + at, count))
        return tuple(np.concatenate(part) for part in zip(*parts, strict=True))

    def _runs(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        hashes = word_hashes(words)
        grams = self.one.windows(self.one.sums(hashes[:, 0]), self.gram)
        # 36 bits of the hash above 28 of the position, which a segment's stay below: the least hash, of equal ones the leftmost.
        least = grams >> np.uint64(28) << np.uint64(28) | np.arange(len(grams), dtype=np.uint64)
        w, span = self.length - self.gram + 1, 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(start, len(place)))
        covered = self.two.spans(self.two.sums(hashes[:, 1]), start, start + count + self.length - 1)
        return grams[place[start]], mixed(covered + count.astype(np.uint64)), start, count

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Both hashes of each window."""
        both = word_hashes(words)
        return np.stack([r.windows(r.sums(both[:, k]), self.length) for k, r in enumerate((self.one, self.two))], 1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes part at exactly [\x20\x09-\x0D]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_doc orders rows, and with _content tells rows with one identifier apart unless they are equal."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_content"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))


def _all_runs(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(length)
        for batch in common.slices(batches, 2):
            found = [own.runs(_words(t)) for t in batch.column(2).to_pylist()]
            sizes = [len(f[0]) for f in found]
            ids = [np.repeat(batch.column(c).to_numpy(), sizes) for c in (0, 1)]
            parts = [np.concatenate([f[c] for f in found]) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), *[pa.array(p.astype(np.uint64).view(np.int64)) for p in parts[:2]], *[pa.array(p.astype(np.int32)) for p in parts[2:]]], ["_doc", "_content", "anchor", "covered", "first", "windows"])

    return rows.select("_doc", "_content", "_text").mapInArrow(run, "_doc long, _content long, anchor long, covered long, first int, windows int")


def _single_windows(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(length)
        for batch in common.slices(batches, 2):
            for doc, content, text, spans in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                at = np.concatenate([np.arange(s["first"], s["first"] + s["windows"]) for s in spans])
                hashes = own.hashes(_words(text))[at]
                columns = [np.full(len(at), doc, np.int64), np.full(len(at), content, np.int64), hashes[:, 0].copy().view(np.int64), hashes[:, 1].copy().view(np.int64), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_doc", "_content", "w1", "w2", "first"])

    return rows.select("_doc", "_content", "_text", "spans").mapInArrow(run, "_doc long, _content long, w1 long, w2 long, first int")


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """_doc, _content, first, windows: the runs of windows that also start under a smaller identifier."""
    runs = common.stored(_all_runs(rows, length), "window-runs")
    anchors = runs.groupBy("anchor").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most"), F.min("covered").alias("c0"), F.max("covered").alias("c1"))
    shared = common.stored(anchors.filter("least <> most").select("anchor", "least", (F.col("c0") != F.col("c1")).alias("mixed")), "shared-anchors")
    candidates = common.stored(runs.join(shared, "anchor"), "shared-runs")
    where = ["_doc", "_content", "first", "windows"]
    same = candidates.filter("NOT mixed AND _doc > least").select(*where)

    mixed_runs = candidates.filter("mixed")
    firsts = common.stored(mixed_runs.groupBy("anchor", "covered").agg(F.min("_doc").alias("holder")), "first-runs")
    settled = mixed_runs.drop("least").join(firsts, ["anchor", "covered"])
    whole = settled.filter("_doc > holder").select(*where)

    open_runs = settled.filter("_doc = holder").groupBy("_doc", "_content").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    single = common.stored(_single_windows(rows.join(open_runs, ["_doc", "_content"]), length), "windows")
    counted = single.groupBy("w1", "w2").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most")).filter("least <> most")
    repeated = common.stored(counted.select("w1", "w2", "least"), "repeated-windows")
    alone = single.join(repeated, ["w1", "w2"]).filter("_doc > least").select("_doc", "_content", "first", F.lit(1).alias("windows"))
    return same.unionByName(whole).unionByName(alone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: id_col, n_words, removed (intervals of words: start, length), kept_text.

    Words are runs of anything but [\\x20\\x09-\\x0D]; null and empty texts have none. Of each window of so many words whose
    sequence also starts under a smaller identifier all words go; the kept ones are joined by one space. Windows within
    one identifier do not remove each other, also if several rows share it. Texts may have up to 2^31 words, as many as
    Spark's strings can hold. Rows without an identifier count as larger
    than all others. An empty table gives an empty result; other columns are not read.
    """
    rows = _keyed(docs, id_col, text_col)
    found = repeated_windows(rows, length).groupBy("_doc", "_content").agg(F.collect_list(F.struct("first", "windows")).alias("_spans"))
    joined = rows.join(found, ["_doc", "_content"], "left").select("_id", "_text", F.col("_spans.first").alias("_first"), F.col("_spans.windows").alias("_windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            total, removed, kept = [], [], []
            for text, first, windows in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True):
                words = _words(text)
                total.append(len(words))
                cut: list[dict] = []
                if first:
                    for start, n in sorted(zip(first, windows, strict=True)):
                        end = start + n + length - 1
                        if cut and start <= cut[-1]["start"] + cut[-1]["length"]:
                            cut[-1]["length"] = max(cut[-1]["length"], end - cut[-1]["start"])
                        else:
                            cut.append({"start": start, "length": end - start})
                    for c in reversed(cut):
                        del words[c["start"] : c["start"] + c["length"]]
                removed.append(cut)
                kept.append(b" ".join(words).decode())
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), spans, pa.array(kept, pa.string())], [id_col, "n_words", "removed", "kept_text"])

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, removed array<struct<start:int,length:int>>, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["length"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)
),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, list(p) AS ps FROM windows JOIN firsts USING (h) WHERE doc_id > least GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM hits)) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL) AS text, count(g.p) AS n_removed
  FROM words LEFT JOIN (SELECT doc_id, unnest(qs) AS p FROM gone) g ON words.doc_id = g.doc_id AND words.p = g.p GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
