"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a Gaussian of the statistics, its covariance shrunk to the common one and to the identity. The score is
the difference of the log densities, from Mahalanobis distances by Cholesky factors that are inverted once, made a
probability by a logistic fit on the training rows. All that leaves the executors for a fit are sums over the labelled
rows: as many numbers as there are pairs of statistics, and a histogram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAMES = ["chars", "words", "word_length", "capitals", "digits", "symbols", "marks", "stops", "beyond_ascii", "entropy", "distinct_words", "distinct_pairs", "repeated_lines", "top_word"]
TO_COMMON, TO_IDENTITY, BINS, REACH = 0.1, 0.02, 400, 40.0
THRESHOLD = 0.3


def _byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


CAPITALS, LETTERS = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS, MARKS, STOPS, SYMBOLS = _byte_class("0123456789"), _byte_class("!?"), _byte_class(".,;:"), _byte_class("#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, all finite; null counts as empty."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, counts.sum())
    words = raw.split()
    n_words = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x]
    p = counts[counts > 0] / n
    share = lambda part, of: math.log((part + 0.5) / (of + 20.0))
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p((n - counts[32] - counts[10]) / n_words),
        share(counts[CAPITALS].sum(), counts[LETTERS].sum()),
        share(counts[DIGITS].sum(), n),
        share(counts[SYMBOLS].sum(), n),
        share(counts[MARKS].sum(), n),
        share(counts[STOPS].sum(), n),
        share(counts[128:].sum(), n),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        math.log(max(1, len(seen)) / n_words) / math.log(n_words + 2),
        math.log(max(1, len(set(zip(words, words[1:])))) / pairs),  # noqa: B905
        math.log((len(set(lines)) + 1) / (len(lines) + 1)),
        share(max(seen.values(), default=0), n_words),
    ]


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor and log normaliser; then the logistic fit. None: both classes are needed."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [off - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, off in zip(self.means, self.whiten, self.offsets, strict=True)]
        return np.clip(density[1] - density[0], -REACH, REACH)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.log_ratio(x) + self.shift)))


def _arrays(texts: pa.Array) -> pa.Array:
    """The statistics of each text."""
    pieces = common.slices(iter([pa.record_batch([texts], ["text"])]), 0)
    values = [np.array([statistics(t) for t in p.column(0).to_pylist()]).ravel() for p in pieces]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)), pa.array(np.concatenate([np.empty(0), *values])))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and x, the array of statistics, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(batch.column(1))], [id_col, "x"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, x array<double>")


def _logistic(at: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on a histogram, with a weak pull to slope 1 and shift 0."""
    w, prior, strength = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1.0
    x = np.stack([at, np.ones_like(at)], 1)
    total = positive + negative
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (positive - total * p) - strength * (w - prior)
        step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + strength * np.eye(2), gradient)
        w = w + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(labelled: DataFrame) -> Model | None:
    """A model of rows (x, label 0 or 1); None where a class is missing. All rows count, and other labels are left out."""
    d = len(NAMES)
    rows = labelled.filter("label IN (0, 1)")
    x = [F.element_at("x", i + 1) for i in range(d)]
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    if not first[0]:
        return None
    centre, scale = np.array(first[1 : d + 1], float), np.maximum(np.array(first[d + 1 :], float), 1e-6)
    z = rows.select("label", *[((c - float(m)) / float(s)).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(x, centre, scale, strict=True))])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = {r[0]: r for r in z.groupBy("label").agg(F.count(F.lit(1)), *[F.avg(f"z{i}") for i in range(d)], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).collect()}
    if set(sums) != {0, 1}:
        return None
    counts = np.array([sums[c][1] for c in (0, 1)], float)
    means = np.array([sums[c][2 : d + 2] for c in (0, 1)], float)
    covariances = np.zeros((2, d, d))
    for c in (0, 1):
        for (i, j), v in zip(pairs, sums[c][d + 2 :], strict=True):
            covariances[c, i, j] = covariances[c, j, i] = v - means[c, i] * means[c, j]
    pooled = (covariances * counts[:, None, None]).sum(0) / counts.sum()
    whiten, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - TO_COMMON) * covariances[c] + TO_COMMON * pooled
        shrunk = (1 - TO_IDENTITY) * shrunk + TO_IDENTITY * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        offsets.append(math.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())
    model = Model(centre, scale, means, np.array(whiten), np.array(offsets))
    ratio = _scored(rows.select("label", "x"), model, "label int", lambda m, v: m.log_ratio(v))
    bins = ratio.select("label", F.floor((F.col("score") + REACH) / (2 * REACH) * BINS).cast("int").alias("bin")).groupBy("label", "bin").count().collect()
    held = np.zeros((2, BINS + 1))
    for r in bins:
        held[r.label, r.bin] += r["count"]
    model.slope, model.shift = _logistic((np.arange(BINS + 1) + 0.5) / BINS * 2 * REACH - REACH, held[1], held[0])
    return model


def _scored(rows: DataFrame, model: Model | None, kept: str, how) -> DataFrame:
    """The first column and a score of x; without a model all scores are a half."""
    name = kept.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(how(model, x) if model else np.full(batch.num_rows, 0.5))], [name, "score"])

    return rows.select(F.col(name).cast(kept.split()[1]), "x").mapInArrow(run, f"{kept}, score double")


def in_training(doc_id: Column) -> Column:
    """False for the fifth of the identifiers that is held out; null is in neither part and counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labels outside the held-out fifth; of several labels of one document the best counts."""
    best = labels.filter(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(stats.join(best, "doc_id").select("x", "label"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1 or 0).

    Only doc_id and text are read, and doc_id only to find labels. Null and empty texts are scored as texts without
    words. Labels other than 0 and 1 are left out; if a class has no label, all scores are a half. Rows that share an
    identifier are each scored by their own text and share its label. An empty table gives an empty result.
    """
    stats = common.stored(with_statistics(docs), "statistics")
    scored = _scored(stats, fit_on_labels(stats, labels), "doc_id long", lambda m, x: m.scores(x))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; the rules are those of quality_scores.

    The rows are written once with their statistics, so that no text is gone through twice; the fit reads the statistics
    alone, and only they go to Python again for the score.
    """
    numbers = F.arrow_udf(_arrays, "array<double>")
    rows = common.stored(docs.select(F.struct("*").alias("_row"), numbers(F.col("text").cast("string")).alias("_x")), "with-statistics")
    model = fit_on_labels(rows.select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_x").alias("x")), labels)
    if model is None:
        return rows.select("_row.*")

    def scores(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(x.flatten().to_numpy().reshape(len(x), -1)))

    return rows.filter(F.arrow_udf(scores, "double")("_x") >= threshold).select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
