"""Text scores of a log-bilinear language model trained with noise-contrastive estimation.

Outcomes of the model are the ``WORDS`` most frequent training words, the end of a text, and one class for every shape of
the other words (what they end in, their length, whether they have bytes outside ASCII). The two outcomes before a token
are its context: their vectors, weighted by position, are added up and compared with the vector of each outcome. Training
is numpy, one pass over all training documents: each task descends on its own documents, minibatch by minibatch, with
noise outcomes drawn from the training frequencies, and the tasks' parameters are averaged in Spark. Scoring normalises
exactly: batched matrix products give the logits of all outcomes for each distinct context.

A word within its class has the probability ``(1 - u) c / n`` (its count c, the class's n); a word that was never seen has
``u``, the class's share of words seen once (Good-Turing). So the probabilities of all known words and of one unknown word of
each shape add up to one.

Counts of all words stay distributed. The ``COMMON`` most frequent ones (a bounded list) are sent to the tasks; the others
are looked up by a join.

Defined cases: null and empty texts are one end token; a null doc_id counts as training; repeated rows count each; no
training rows give uniform base scores 1 / (N + V + 1) with N = V = 0 and a uniform model; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import pinned, table
from rosterfold.llm.words import Words, pieces, signed

WORDS, COMMON = 767, 100_000
DIMENSIONS, NOISE, BATCH, RATE, SLOTS = 32, 64, 4096, 0.1, 16
END = np.uint64(0x0E4D0E4D0E4D0E4D)

_ENDING = np.full(256, 5, np.int64)
_ENDING[[*range(97, 123), *range(65, 91), *range(128, 256)]] = 0
_ENDING[[ord(c) for c in ",;:"]] = 1
_ENDING[[ord(c) for c in ".?"]] = 2
_ENDING[[ord(c) for c in "#$%&*@^~=+<>_/"]] = 3
_ENDING[ord("!")] = 4
_ENDING[48:58] = 6
SHAPES = 7 * 2 * 4


def shapes(words: Words) -> np.ndarray:
    """The shape class of each word, 0 to ``SHAPES - 1``."""
    high = np.concatenate([[0], np.cumsum(words.raw >= 128)])
    other = high[words.ends] > high[words.starts]
    length = np.digitize(words.ends - words.starts, (5, 9, 13))
    return (_ENDING[words.raw[words.ends - 1]] * 2 + other) * 4 + length if len(words.starts) else np.zeros(0, np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """h (hashed word, or the end), shape (-1 for the end) and c, the count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column(0))
            h, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            kinds = np.concatenate([shapes(words)[first], [-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([h, [END]]))), pa.array(kinds.astype(np.int32)), pa.array(np.concatenate([n, [len(words)]]).astype(np.int64))], names=["h", "shape", "c"])

    return docs.filter(~held_out()).select("text").mapInArrow(run, "h bigint, shape int, c bigint").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals of the training words, and the most frequent ones, sorted by hash, with the outcome each has."""

    tokens: int
    types: int
    hashes: np.ndarray
    counts: np.ndarray
    outcomes: np.ndarray
    size: int
    frequencies: np.ndarray  # of the outcomes
    class_n: np.ndarray
    unseen: np.ndarray

    def outcomes_of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its outcome, its count if it is common (else 0), and its shape."""
        shape = shapes(words)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == words.hashes if len(self.hashes) else np.zeros(len(shape), bool)
        own = self.outcomes[at] if len(self.hashes) else np.full(len(shape), -1)
        rest = 1 + self.size + shape
        return np.where(known & (own >= 0), own, rest), np.where(known, self.counts[at], 0) if len(self.hashes) else np.zeros(len(shape), np.int64), shape


def vocabulary(counts: DataFrame) -> Vocabulary:
    words = counts.filter("shape >= 0")
    # Words by eighths of the logarithm of their count, a few hundred rows; the common ones are whole steps from the top.
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    least, common = None, 0
    for row in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        common += row["n"]
        if common > COMMON:
            break
        least = row["c"]
    top = words.filter(F.col("c") >= F.lit(least)).select("h", "shape", "c").toArrow()
    own, kind, c = (top.column(k).to_numpy() for k in range(3))
    order = np.lexsort((own, -c))
    own, kind, c = own[order], kind[order], c[order]
    size = min(WORDS, len(own))
    outcomes = np.full(len(own), -1)
    outcomes[:size] = np.arange(1, size + 1)  # 0 is the end
    frequencies = np.zeros(1 + size + SHAPES)
    frequencies[1:size + 1] = c[:size]
    class_n, ones, tokens, types = np.zeros(SHAPES), np.zeros(SHAPES), 0, 0
    # One row for each shape.
    for row in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("types"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("ones")).collect():
        tokens, types = tokens + row["n"], types + row["types"]
        if row["shape"] < 0:
            frequencies[0] = row["n"]
        else:
            class_n[row["shape"]], ones[row["shape"]] = row["n"], row["ones"]
    # The most frequent words are outcomes of their own and leave their class.
    class_n -= np.bincount(kind[:size], c[:size], SHAPES)
    ones -= np.bincount(kind[:size], c[:size] == 1, SHAPES)
    frequencies[1 + size:] = class_n
    unseen = np.clip((ones + 0.5) / (class_n + 1.0), 1e-6, 0.9)
    unseen[class_n == 0] = 1.0  # only unknown words are left
    h = own.view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(tokens, types, h[order], c[order], outcomes[order], size, frequencies + 0.5, class_n, unseen)


def _contexts(outcome: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes of all texts with an end (0) behind each, and the two before each; before a text are ends."""
    ends = words.bounds[1:] + np.arange(len(words))
    full = np.zeros(len(outcome) + len(words), np.int64)
    inner = np.ones(len(full), bool)
    inner[ends] = False
    full[inner] = outcome
    one, two = np.zeros_like(full), np.zeros_like(full)
    one[1:] = full[:-1]
    two[2:] = full[:-2]
    starts = ends[:-1] + 1
    two[starts[starts < len(full)]] = 0
    return full, one, two


class Model:
    """Parameters: context vectors, outcome vectors, biases, and the weights of both positions."""

    def __init__(self, frequencies: np.ndarray, seed: int = 5):
        draw, k = np.random.Generator(np.random.PCG64(seed)), len(frequencies)
        share = frequencies / frequencies.sum()
        self.parts = [(draw.standard_normal((k, DIMENSIONS)) * 0.1).astype(np.float32), (draw.standard_normal((k, DIMENSIONS)) * 0.1).astype(np.float32),
                      np.log(share).astype(np.float32), np.full((2, DIMENSIONS), 1.0, np.float32)]
        self.noise_log = np.log(NOISE * share).astype(np.float32)
        self.draw, self.share = draw, share
        self.squares = [np.full_like(p, 1e-6) for p in self.parts]

    def _step(self, k: int, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Adagrad, on some rows or on all."""
        if rows is None:
            self.squares[k] += gradient * gradient
            self.parts[k] -= RATE * gradient / np.sqrt(self.squares[k])
        else:
            self.squares[k][rows] += gradient * gradient
            self.parts[k][rows] -= RATE * gradient / np.sqrt(self.squares[k][rows])

    def train(self, full: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One pass over the tokens; equal ones with equal contexts are taken together."""
        k = len(self.share)
        keys, counts = np.unique((two * k + one) * k + full, return_counts=True)
        order = self.draw.permutation(len(keys))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            w, rest = keys[some] % k, keys[some] // k
            self._batch(rest // k, rest % k, w, counts[some].astype(np.float32))

    def _batch(self, two: np.ndarray, one: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        r, q, b, c = self.parts
        noise = self.draw.choice(len(self.share), NOISE, p=self.share)
        r1, r2 = r[one], r[two]
        guess = r1 * c[0] + r2 * c[1]
        true = (guess * q[w]).sum(axis=1) + b[w] - self.noise_log[w]
        false = guess @ q[noise].T + b[noise] - self.noise_log[noise]
        scale = weight / weight.sum()
        up = -scale / (1 + np.exp(np.clip(true, -30, 30)))  # slope of -log sigmoid(true)
        down = scale[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))  # slope of -log(1 - sigmoid(false))
        d_guess = up[:, None] * q[w] + down @ q[noise]
        self._add(1, np.concatenate([w, noise]), np.concatenate([up[:, None] * guess, down.T @ guess]))
        d_bias = np.bincount(w, up, len(b)) + np.bincount(noise, down.sum(axis=0), len(b))
        self._add(0, np.concatenate([one, two]), np.concatenate([d_guess * c[0], d_guess * c[1]]))
        self._step(2, d_bias.astype(np.float32))
        self._step(3, np.stack([(d_guess * r1).sum(axis=0), (d_guess * r2).sum(axis=0)]))

    def _add(self, k: int, rows: np.ndarray, gradients: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows, first = np.unique(rows[order], return_index=True)
        self._step(k, np.add.reduceat(gradients[order], first, axis=0), rows)

    def packed(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parts)

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def log10(self, full: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log probability of each outcome in its context."""
        k = len(self.share)
        r, q, b, c = self.parts
        contexts, which = np.unique(two * k + one, return_inverse=True)
        out = np.empty(len(full))
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(0, len(contexts) + BATCH, BATCH))
        for i in range(0, len(contexts), BATCH):
            some = contexts[i:i + BATCH]
            logits = (r[some % k] * c[0] + r[some // k] * c[1]) @ q.T + b
            logits -= logits.max(axis=1, keepdims=True)
            total = np.log(np.exp(logits).sum(axis=1))
            own = order[bounds[i // BATCH]:bounds[i // BATCH + 1]]
            row = which[own] - i
            out[own] = logits[row, full[own]] - total[row]
        return out / np.log(10)


def trained(docs: DataFrame, words: Vocabulary) -> Model:
    """The average of the tasks' models, weighted by their tokens."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = Model(words.frequencies), 0
        for batch in pieces(batches):
            own = Words(batch.column(0))
            full, one, two = _contexts(words.outcomes_of(own)[0], own)
            model.train(full, one, two)
            tokens += len(full)
        if tokens:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([tokens], pa.int64()), pa.array([model.packed()], pa.binary())], names=["slot", "tokens", "model"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, added = 0, None
        for batch in batches:
            for n, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(packed.as_buffer(), np.float32).astype(float) * n
                total, added = total + n, part if added is None else added + part
        if added is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([added.tobytes()], pa.binary())], names=["tokens", "model"])

    one_each = docs.filter(~held_out()).select("text").mapInArrow(descend, "slot int, tokens bigint, model binary")
    # At most SLOTS rows reach the driver.
    rows = one_each.repartition(SLOTS, "slot").mapInArrow(average, "tokens bigint, model binary").collect()
    model = Model(words.frequencies)
    if rows:
        model.unpack(sum(np.frombuffer(r["model"]) for r in rows) / sum(r["tokens"] for r in rows))
    return model


_RARE = pa.list_(pa.struct([("h", pa.int64()), ("shape", pa.int32()), ("tf", pa.int64())]))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    counts = pinned(word_counts(docs), "word-counts")
    words = vocabulary(counts)
    model = trained(docs, words)
    floor = np.log10(words.tokens + words.types + 1)
    inside = np.log10(np.maximum(1 - words.unseen, 1e-12)) - np.log10(np.maximum(words.class_n, 1))
    end_count = float(words.frequencies[0] - 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = Words(batch.column(1))
            n = len(own)
            outcome, c, shape = words.outcomes_of(own)
            owner = own.owners()
            full, one, two = _contexts(outcome, own)
            logs = model.log10(full, one, two)
            sizes = own.counts() + 1
            model_log = np.add.reduceat(logs, np.cumsum(sizes) - sizes) if n else np.zeros(0)
            common = c > 0
            in_class = common & (outcome > words.size)
            model_log = model_log + np.bincount(owner[in_class], np.log10(c[in_class]) + inside[shape[in_class]], n)
            base = np.bincount(owner[common], np.log10(c[common] + 1.0), n) + np.log10(end_count + 1)
            known = np.bincount(owner[common], minlength=n) + (end_count > 0)
            rare = ~common
            rows, hashes, kinds = owner[rare], own.hashes[rare], shape[rare]
            order = np.lexsort((hashes, rows))
            rows, hashes, kinds = rows[order], hashes[order], kinds[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(rows)))
            structs = pa.StructArray.from_arrays([pa.array(signed(hashes[first])), pa.array(kinds[first].astype(np.int32)), pa.array(tf.astype(np.int64))], fields=list(_RARE.value_type))
            offsets = np.searchsorted(rows[first], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model_log), pa.ListArray.from_arrays(pa.array(offsets), structs)],
                names=["doc_id", "n_tokens", "n_known", "base", "model", "rare"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base double, model double, rare array<struct<h: bigint, shape: int, tf: bigint>>")
    rows = pinned(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    classes = docs.sparkSession.createDataFrame([(k, float(inside[k]), float(np.log10(words.unseen[k]))) for k in range(SHAPES)], "shape int, seen_log double, unseen_log double")
    # None of these words is among the most frequent, so no key is hot.
    exploded = rows.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.shape", "w.tf")
    looked_up = exploded.join(counts.select("h", "c"), "h", "left").join(F.broadcast(classes), "shape")
    known = F.col("c").isNotNull()
    tf = F.col("tf")
    added = looked_up.groupBy("row").agg(
        F.sum(F.when(known, tf).otherwise(0)).alias("more_known"),
        F.sum(tf * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more_base"),
        F.sum(tf * F.when(known, F.log10(F.col("c").cast("double")) + F.col("seen_log")).otherwise(F.col("unseen_log"))).alias("more_model"))
    zero = F.lit(0.0)
    return (rows.drop("rare").join(added, "row", "left")
            .select("doc_id", held_out().alias("held_out"), "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"),
                    F.lit(words.tokens).cast("bigint").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"),
                    (F.col("model") + F.coalesce("more_model", zero)).alias("score")))


def op2_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(table(spark, sf_dir, "documents"))
