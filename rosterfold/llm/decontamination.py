"""Benchmark passages in training documents, found by spaced-seed hashing.

Words of benchmark items and documents are hashed. A mask keeps some places of a window and ignores the others; equal
hashes of the kept words are a hit, also where ignored words were substituted. The mask of four words misses no overlap: m
substitutions leave m + 1 runs of at least max(13, 4 m) equal words together, so that one run has four at least. Hits on lines that
have too few equal words in all are dropped together. Around each hit the item is laid on the
document at that shift and compared word by word. The stretch with the most
words that agree, among those of which at least four fifths do, is an overlap when it has at least ``LEAST`` such words; it
begins and ends in one. An item of fewer than ``LEAST`` words must agree as a whole; one of fewer than
``SHORTEST`` words says nothing and is never reported.

Documents are read once and not shuffled. The benchmark is sent to the tasks in slices of at most about
``SLICE_BYTES``; a larger benchmark takes more slices, each joined with all documents.

Defined cases: null and empty texts have no overlap; repeated documents are reported each, repeated items each; an empty
table on either side gives no rows; a text is searched whole, whatever its length. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import table
from rosterfold.llm.words import PLACES, Words, mix, pieces

MASKS = ("1101011011", "1011101101", "1110110011", "11111111", "1111")
LEAST, SHORTEST = 13, 5
AGREES, DIFFERS = 1, 4  # a stretch adds up to 0 or more when at least four fifths of it agree
SLICE_BYTES = 64 << 20
_COMPARED = 1 << 21  # words compared at once
_FILTER_BITS = 20
OVERLAPS = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, words bigint, same bigint"


def _rolled(hashes: np.ndarray, mask: str) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - len(mask) + 1), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out += hashes[k:k + len(out)] * PLACES[k]
    return mix(out)


class Seeds:
    """Hashed windows of some benchmark items, by mask."""

    def __init__(self, ids: list, texts: list):
        words = Words(pa.array(texts, pa.string()))
        self.ids, self.hashes, self.bounds = ids, words.hashes, words.bounds
        self.tables = []
        lengths = words.counts()
        owners = words.owners()
        # An item shorter than every mask is found by all its words.
        shortest = min(map(len, MASKS))
        masks = [*MASKS, *("1" * int(n) for n in np.unique(lengths) if SHORTEST <= n < shortest)]
        for mask in masks:
            rolled = _rolled(self.hashes, mask)
            at = np.arange(len(rolled))
            inside = at + len(mask) <= self.bounds[owners[:len(rolled)] + 1]
            if len(mask) < shortest:
                inside &= lengths[owners[:len(rolled)]] == len(mask)
            at = at[inside]
            order = np.argsort(rolled[at], kind="stable")
            keys, at = rolled[at][order], at[order]
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, keys, at, owners[at] if len(at) else at, known))

    def overlaps(self, words: Words) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, equal words), one for each text and item."""
        lined = []
        for mask, keys, at, item, known in self.tables:
            if not len(keys):
                continue
            rolled = _rolled(words.hashes, mask)
            place = np.flatnonzero(known[rolled >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(keys, rolled[place], "left"), np.searchsorted(keys, rolled[place], "right")
            n = high - low
            place = np.repeat(place, n)
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(place))
            lined.append(np.stack([place, item[entry], place - at[entry] + self.bounds[item[entry]]], axis=1))
        if not lined:
            return []
        lined = np.concatenate(lined)
        text = np.searchsorted(words.bounds, lined[:, 0], "right") - 1
        best: dict[tuple[int, int], tuple] = {}
        lines = np.unique(np.stack([text, lined[:, 1], lined[:, 2]], axis=1), axis=0)
        for t, item, start in lines[self._enough(words, lines)].tolist():
            found = self._aligned(words, t, item, start)
            if found and found[3] > best.get((t, item), (0, 0, 0, 0))[3]:
                best[t, item] = found
        return [(t, item, *found) for (t, item), found in best.items()]

    def _enough(self, words: Words, lines: np.ndarray) -> np.ndarray:
        """Whether each (text, item, start) has as many equal words in all as an overlap must have."""
        text, item, start = lines.T
        own = self.bounds[item]
        size = self.bounds[item + 1] - own
        low, high = np.maximum(start, words.bounds[text]), np.minimum(start + size, words.bounds[text + 1])
        ends = np.cumsum(high - low)
        out = np.zeros(len(lines), np.int64)
        at = 0
        while at < len(lines):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _COMPARED, "right")))
            some = slice(at, stop)
            n = (high - low)[some]
            firsts = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(firsts, n)
            equal = words.hashes[np.repeat(low[some], n) + step] == self.hashes[np.repeat((low - start + own)[some], n) + step]
            out[some] = np.add.reduceat(equal, firsts, dtype=np.int64)  # a hit has words, so no line is empty
            at = stop
        return out >= np.minimum(LEAST, size)

    def _aligned(self, words: Words, text: int, item: int, start: int) -> tuple[int, int, int, int] | None:
        """``start``: the word of the batch on which the item's first word lies; may be before the text."""
        own = self.hashes[self.bounds[item]:self.bounds[item + 1]]
        low, high = int(words.bounds[text]), int(words.bounds[text + 1])
        a, b = max(start, low), min(start + len(own), high)
        if b <= a:
            return None
        equal = words.hashes[a:b] == own[a - start:b - start]
        # For each first word the farthest end up to which enough words agree.
        gain = np.concatenate([[0], np.cumsum(np.where(equal, AGREES, -DIFFERS))])
        later = np.maximum.accumulate(gain[::-1])[::-1]
        ends = np.searchsorted(-later, -gain[:-1], "right") - 1
        agree = np.concatenate([[0], np.cumsum(equal)])
        first = int(np.argmax(agree[ends] - agree[:-1]))
        inside = np.flatnonzero(equal[first:ends[first]])
        if not len(inside):
            return None
        first, end = first + int(inside[0]), first + int(inside[-1]) + 1
        same, length = len(inside), end - first
        if len(own) < SHORTEST or same < min(LEAST, len(own)):
            return None
        return a + first - low, a + first - start, length, same


def seeds(benchmark: DataFrame) -> Iterator[Seeds]:
    """The benchmark in slices of about ``SLICE_BYTES``."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // SLICE_BYTES
    for k in range(count):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).filter("text is not null").select("item_id", "text").collect()
        if rows:
            yield Seeds([r["item_id"] for r in rows], [r["text"] for r in rows])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: where, over how many words, and how many of them agree."""
    found = None
    for part in seeds(benchmark):
        def search(batches: Iterator[pa.RecordBatch], part: Seeds = part) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                rows = part.overlaps(Words(batch.column(1)))
                if rows:
                    ids = batch.column(0).to_pylist()
                    columns = zip(*((ids[t], part.ids[item], *rest) for t, item, *rest in rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_word", "item_word", "words", "same"])

        some = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(search, OVERLAPS)
        found = some if found is None else found.union(some)
    return found if found is not None else docs.sparkSession.createDataFrame([], OVERLAPS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap with any item, all columns kept."""
    place = docs.columns.index("text")
    for part in seeds(benchmark):
        def keep(batches: Iterator[pa.RecordBatch], part: Seeds = part) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                kept = np.ones(batch.num_rows, bool)
                kept[[row[0] for row in part.overlaps(Words(batch.column(place)))]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op8_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items; a document without any has no row."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
