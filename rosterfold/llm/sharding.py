"""Shards of near equal size, by minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one group and stay together. Groups are put in order, largest first, then by hash. The
smallest capacity for which a greedy cut of that order needs no more than the given number of shards is found by
binary search; the first shard is cut there, and the rest is solved again for the shards left, so that one very
large group does not leave later shards empty. No shard is larger than the smallest possible capacity.

The order and its prefix sums stay distributed. The driver holds a bounded list of known group ends and asks Spark for
finer ones only where a cut may fall (``RESOLUTION`` per interval and round).

Defined cases: a null text has no bytes (size 1) and is grouped with the empty text; rows that repeat, also with the
same doc_id, are rows of their own; an empty table gives no rows; with fewer groups than shards some shards are empty;
a null doc_id sorts first in its group. Other columns are not carried: join them by doc_id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterfold.llm.shared import in_order, pinned, table, text_or_empty

RESOLUTION = 16_384
GROUP = ["_hash", "text_crc32", "size"]


class GroupEnds:
    """Ends of groups on the line of prefix sums, known as finely as they have been asked for."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.known, self.total = ends, [0, total], total
        self.open = {(0, total)} if total else set()
        self.touched: set[tuple[int, int]] = set()

    def floor(self, x: int) -> int:
        """The largest known end at most x; remembers the interval when a finer answer may exist."""
        if x >= self.total:
            return self.total
        k = bisect_right(self.known, x)
        around = (self.known[k - 1], self.known[k])
        if around in self.open and x > around[0]:
            self.touched.add(around)
        return around[0]

    def refine(self) -> None:
        spans = sorted(self.touched)
        self.touched = set()
        low, high = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
        width = np.maximum(1, -(-(high - low) // RESOLUTION))

        def last_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                end = batch.column(0).to_numpy()
                span = np.searchsorted(low, end, "left") - 1
                inside = span >= 0
                end, span = end[inside], span[inside]
                inside = end < high[span]
                end, span = end[inside], span[inside]
                yield pa.RecordBatch.from_arrays([pa.array(span), pa.array((end - low[span]) // width[span]), pa.array(end)], names=["span", "slot", "end"])

        inside = self.ends.filter(F.col("end").between(int(low[0]), int(high[-1])))
        found = (inside.mapInArrow(last_ends, "span bigint, slot bigint, end bigint")
                 .groupBy("span", "slot").agg(F.max("end").alias("end"), F.min("end").alias("first")).collect())
        by_span: dict[int, list] = {}
        for row in found:
            by_span.setdefault(row["span"], []).append((row["end"], row["first"]))
        for k, (a, b) in enumerate(spans):
            self.open.discard((a, b))
            before = a
            for end, first in sorted(by_span.get(k, [])):
                if first != end:  # other ends lie between
                    self.open.add((before, end))
                before = end
        self.known = sorted({*self.known, *(row["end"] for row in found)})


def _fits(ends: GroupEnds, start: int, capacity: int, shards: int) -> bool:
    at = start
    for _ in range(shards):
        at = max(at, ends.floor(at + capacity))
        if at >= ends.total:
            return True
    return False


def cuts(ends: GroupEnds, shards: int) -> list[int]:
    """Where shards 1 to ``shards - 1`` begin."""
    out, start = [], 0
    for left in range(shards, 1, -1):
        while True:
            low, high = -(-(ends.total - start) // left), ends.total - start
            while low < high:
                middle = (low + high) // 2
                if _fits(ends, start, middle, left):
                    high = middle
                else:
                    low = middle + 1
            cut = max(start, ends.floor(start + low))
            if not ends.touched:
                break
            ends.refine()
        out.append(cut)
        start = cut
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row of ``docs``."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    # The largest groups may hold a third of the rows: counts are combined before the shuffle, and the join back is one
    # whose large partitions Spark splits.
    groups = rows.groupBy(*GROUP).agg((F.count("*") * F.col("size")).alias("_bytes"))
    sized = rows.join(groups, GROUP)
    placed = in_order(sized, [F.desc("_bytes"), *map(F.col, GROUP), F.col("doc_id")], "size", "shard-rows")
    end = F.max(F.col("_before") + F.col("size")).alias("end")
    ends = pinned(placed.groupBy(*GROUP).agg(end).select("end"), "shard-ends")
    total = ends.agg(F.max("end")).first()[0] or 0
    at = cuts(GroupEnds(ends, total), shards)
    number = F.lit(0)
    for cut in at:
        number = number + (F.col("_before") >= F.lit(cut)).cast("int")
    numbered = placed.withColumn("shard", number)
    firsts = numbered.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return (numbered.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")))


def op1_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards, under the law ``bytes``."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
