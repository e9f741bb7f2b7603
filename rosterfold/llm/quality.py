"""Text quality by regularised quadratic discriminant analysis over document statistics.

Each text is turned into ``FEATURES`` transformed statistics (lengths, shares of kinds of characters, repetition).
Class means and covariances come from sums over all labelled training rows, combined in each task before they are
added up, so nothing is sampled. A covariance is shrunk towards the pooled one and towards its own mean variance. The
score is the logistic of the difference of the two Gaussian log densities (Mahalanobis distances by cached inverse
Cholesky factors) plus the log ratio of the class sizes, divided by ``SOFTEN``.

Learned from rows with crc32(doc_id as text) mod 3 other than 1; labels, lang, source and doc_id are never inputs of a
score.

Defined cases: null texts count as empty and are scored by the same formula; rows that repeat are scored and learned
each; null labels and labels of unknown documents are not learned; with one class only every score is that class, with
no labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import pinned, table
from rosterfold.llm.words import SHINGLE, Words, pieces

SHRINK, RIDGE, SOFTEN = 0.1, 0.02, 4.0
SIZE = 18

_KIND = np.full(256, 9, np.uint8)  # bytes of characters outside ASCII
_KIND[:128] = 8
_KIND[ord("a"):ord("z") + 1] = 0
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 3
_KIND[[ord(c) for c in "#$%&*@^~=+<>_/\\{}[]"]] = 4
_KIND[ord("!")] = 5
_KIND[ord("|")] = 6
_KIND[[9, 10, 11, 12, 13]] = 7
_KINDS = 10


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``SIZE`` transformed statistics for each text."""
    words = Words(texts)
    n = len(words)
    kinds = _KIND[words.raw]
    sizes = np.diff(words.offsets).astype(float)
    total = np.maximum(1.0, sizes)
    shares = np.zeros((n, _KINDS))
    for k in range(_KINDS):
        upto = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        shares[:, k] = np.diff(upto[words.offsets]) / total
    counts = words.counts().astype(float)
    lengths = (words.ends - words.starts).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(values)])
        return (upto[words.bounds[1:]] - upto[words.bounds[:-1]]) / np.maximum(1.0, counts)

    mean = per_word(lengths)
    spread = np.sqrt(np.maximum(0.0, per_word(lengths ** 2) - mean ** 2))
    last = kinds[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    odd_end = per_word(np.isin(last, (4, 5, 6)).astype(float))
    distinct, fresh, top = np.zeros(n), np.ones(n), np.zeros(n)
    for k, shingles in enumerate(words.shingle_sets()):
        own = words.of(k)
        if len(own):
            seen = np.unique(own, return_counts=True)[1]
            distinct[k] = np.log((1 + len(seen)) / (1 + len(own)))
            top[k] = seen.max() / len(own)
            fresh[k] = len(shingles) / max(1, len(own) - SHINGLE + 1)
    rows = np.column_stack([np.log1p(sizes), np.log1p(counts), np.log1p(mean), np.log1p(spread), distinct, fresh, np.sqrt(top), np.sqrt(odd_end), np.sqrt(shares)])
    return rows[:, :SIZE]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, packed as 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, f binary")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of both classes; ``constant`` when there are not two."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float = 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(rows), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (rows - mean) @ factor.T
            logs.append(offset - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(-np.clip((logs[1] - logs[0]) / SOFTEN, -500, 500)))


def fit(rows: DataFrame) -> Discriminant:
    """Learn from ``rows`` (f, quality)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            x = np.array([np.frombuffer(p.as_buffer()) for p in batch.column(0)]).reshape(-1, SIZE)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], k)), pa.array(np.arange(total.shape[1])), pa.array(total[k])], names=["k", "i", "v"])

    # Two classes times the entries of a sum: as many rows for any input.
    added = rows.select("f", F.col("quality").cast("int")).mapInArrow(sums, "k bigint, i bigint, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for row in added:
        total[row["k"], row["i"]] = row["v"]
    counts = total[:, 0]
    if counts.min() == 0:
        return Discriminant(constant=float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = total[:, 1:1 + SIZE] / counts[:, None]
    covs = total[:, 1 + SIZE:].reshape(2, SIZE, SIZE) / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (covs * counts[:, None, None]).sum(axis=0) / counts.sum()
    scale = np.sqrt(np.diag(pooled)) + 1e-6
    unit = np.outer(scale, scale)
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - SHRINK) * covs[k] / unit + SHRINK * pooled / unit
        cov = (1 - RIDGE) * cov + RIDGE * np.eye(SIZE)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower) / scale)
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The model, and the statistics of all documents."""
    found = pinned(features(docs), "quality-features")
    known = labels.select(F.col("doc_id").cast("bigint"), "quality").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    return fit(found.join(known, "doc_id")), found


def scored(found: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(p.as_buffer()) for p in batch.column(1)]).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return found.mapInArrow(run, "doc_id bigint, score double")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns."""
    model, _ = trained(docs, labels)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.scores(statistics(batch.column(place))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op3_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    model, found = trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(found, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
