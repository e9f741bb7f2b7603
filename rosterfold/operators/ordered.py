"""Running values per key, in order, for keys of any size.

An ordinary key is handled by a window over the whole key. The rows of heavy keys are range
partitioned by (key, order): a heavy key becomes several consecutive chunks, each chunk is scanned
on its own, and what the earlier chunks contribute is carried in by a join with one row per chunk.
The number of chunks is bounded by the heavy-key list, so that join is always a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterfold.operators.skew import HeavyKeys, Probe, lookup
from rosterfold.operators.workspace import pinned

CHUNK = "_chunk"
_WHOLE = -1


@dataclass(frozen=True)
class OrderedRows:
    """Rows grouped by ``keys`` and totally ordered inside a group by ``order``."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    descending: bool = False
    heavy: HeavyKeys | None = None

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], descending: bool = False,
           probe: Probe | None = None) -> OrderedRows:
        heavy = (probe or Probe(df)).heavy(keys)
        if heavy is None:
            return OrderedRows(df, keys, order, descending)
        if probe is not None and probe.df is not df:
            # Derived rows are read three times from here on (range sample, chunks, the rest).
            df = pinned(df, "rows")
        directed = [F.desc(c) if descending else F.asc(c) for c in order]
        chunks = (heavy.part(df, heavy=True)
                  .repartitionByRange(heavy.pieces, *keys, *directed)
                  .withColumn(CHUNK, F.spark_partition_id()))
        # Chunk numbers must not change when a task is rerun, so the placement is written down.
        spread = heavy.part(df, heavy=False).withColumn(CHUNK, F.lit(_WHOLE)).unionByName(pinned(chunks, "chunks"))
        return OrderedRows(spread, keys, order, descending, heavy)

    def running(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
                earlier: dict[str, Column] | None = None, totals: dict[str, Column] | None = None) -> OrderedRows:
        """Add inclusive running sums and the running last non-null value of expressions; ``earlier`` ones without the row itself.

        ``totals`` are the sums of whole keys.
        """
        sums, lasts, earlier, totals = sums or {}, lasts or {}, earlier or {}, totals or {}
        group = self.keys if self.heavy is None else [*self.keys, CHUNK]
        directed = [F.desc(c) if self.descending else F.asc(c) for c in self.order]
        window = Window.partitionBy(*group).orderBy(*directed).rowsBetween(Window.unboundedPreceding, 0)
        above, whole = (window.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
        # The expressions are evaluated under names of their own, so that an output may replace an input.
        inputs = {f"_in_{name}": value for name, value in {**sums, **lasts, **earlier, **totals}.items()}
        rows = self.df.withColumns(inputs)
        local = rows.withColumns({
            **{name: F.sum(f"_in_{name}").over(window) for name in sums},
            **{name: F.last(f"_in_{name}", ignorenulls=True).over(window) for name in lasts},
            **{name: F.last(f"_in_{name}", ignorenulls=True).over(above) for name in earlier},
            **{name: F.sum(f"_in_{name}").over(whole) for name in totals}}).drop(*inputs)
        if self.heavy is not None:
            local = self._carried(rows, local, list(sums), [*lasts, *earlier], list(totals))
        return OrderedRows(local, self.keys, self.order, self.descending, self.heavy)

    def _carried(self, rows: DataFrame, local: DataFrame, sums: list[str], lasts: list[str], whole: list[str]) -> DataFrame:
        place = F.struct(*self.order)
        latest = F.min_by if self.descending else F.max_by
        totals = rows.filter(F.col(CHUNK) != _WHOLE).groupBy(*self.keys, CHUNK).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(f"_in_{name}").alias(name) for name in [*sums, *whole]],
            *[latest(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), place)).alias(name) for name in lasts])
        before = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.keys, CHUNK,
            *[F.sum(name).over(before).alias(f"_before_{name}") for name in sums],
            *[F.last(name, ignorenulls=True).over(before).alias(f"_before_{name}") for name in lasts],
            *[F.sum(name).over(Window.partitionBy(*self.keys)).alias(f"_before_{name}") for name in whole])
        joined = local.join(F.broadcast(carry), [*self.keys, CHUNK], "left")
        added = {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))
                 for name in sums}
        kept = {name: F.coalesce(F.col(name), F.col(f"_before_{name}")) for name in lasts}
        # A chunk's own total is only a part of its key's.
        complete = {name: F.coalesce(F.col(f"_before_{name}"), F.col(name)) for name in whole}
        return joined.withColumns({**added, **kept, **complete}).select(*local.columns)

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.heavy is not None else self.df


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, descending: bool = False,
             probe: Probe | None = None) -> DataFrame:
    """Add the row's 1-based place inside its key."""
    return OrderedRows.of(df, keys, order, descending, probe).running(sums={name: F.lit(1)}).rows()


def with_minimum(df: DataFrame, keys: list[str], value: Column, name: str, spread: list[str],
                 probe: Probe | None = None) -> DataFrame:
    """Add the least non-null ``value`` of the row's key.

    Ordinary keys need one exchange, which a join on the same keys before it has already paid for.
    With heavy keys the minimum is combined before the shuffle and joined back by a spread lookup.
    """
    probe = probe or Probe(df)
    if probe.heavy(keys) is None:
        return df.withColumn(name, F.min(value).over(Window.partitionBy(*keys)))
    least = df.withColumn(name, value).filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(name).alias(name))
    return lookup(df, least, keys, spread, probe=probe)
