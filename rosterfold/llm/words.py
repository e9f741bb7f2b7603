"""Words and shingles of a batch of texts as arrays of 64-bit hashes.

A word is a run of bytes outside space, tab, newline, vertical tab, form feed and carriage return,
with A-Z lower-cased. Texts are handled a few megabytes at a time, so memory does not depend on the
size of a batch; one text is always handled whole. Null texts count as empty.

Two words have the same hash when they are equal, and otherwise with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20_241)).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: One odd factor for each place of a word in a shingle or mask.
PLACES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, 0 to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together, and where each text begins (one more entry than texts)."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """Words of several texts: ``hashes`` of all, those of text k at ``bounds[k]:bounds[k + 1]``."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffers(texts)
        self.raw, self.offsets = raw, offsets
        word = ~_SPACE[raw]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        power, back = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:len(raw)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * back[self.starts])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k]:self.bounds[k + 1]]

    def shingle_sets(self, size: int = SHINGLE) -> Iterator[np.ndarray]:
        """For each text its sorted distinct shingles; a shorter text is one shingle, an empty one none."""
        n = len(self.hashes)
        rolled = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            rolled += self.hashes[k:k + len(rolled)] * PLACES[k]
        rolled = mix(rolled)
        for k in range(len(self)):
            at, end = self.bounds[k], self.bounds[k + 1]
            if end - at >= size:
                yield np.unique(rolled[at:end - size + 1])
            elif end > at:
                short = self.hashes[at:end]
                yield mix((short * PLACES[:len(short)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(short)))
            else:
                yield np.zeros(0, np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return h.view(np.int64)
