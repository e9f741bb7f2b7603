"""Which of a key's intervals are open at which of its points, without comparing all with all.

The points of a key are numbered in order. An interval covers a run of these numbers, found by reading its ends and the points in one
order. The run is cut into dyadic blocks, at most two of each size, and a point lies in one block of each size, so
interval and point meet by an equi-join on (key, size, block), exactly once. A key with n points costs log n rows for each of its
intervals and points, besides the pairs that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.operators.ordered import OrderedRows
from rosterfold.operators.skew import lookup
from rosterfold.operators.workspace import pinned

_OPEN, _CLOSE, _POINT = 0, 1, 2


def open_at(points: DataFrame, spans: DataFrame, keys: list[str], at: str, since: str, until: str) -> DataFrame:
    """Each point with each span of its key that is open there: ``since`` <= ``at``, and ``at`` < ``until`` or no ``until``.

    Points without an open span are not in the result. ``at``, ``since`` and ``until`` are of one type that has an order.
    Columns of points and spans other than the keys have different names.
    """
    rest = [c for c in points.columns if c not in keys]
    about = [c for c in spans.columns if c not in keys]
    points = points.select(*keys, F.struct(*rest).alias("_point"), F.col(at).alias("_at"))
    spans = pinned(spans.withColumn("_span", F.monotonically_increasing_id()), "spans")

    # Ends of spans and points in one order; an end counts the points before it, so a point at an opening is inside, one at a
    # closing is not.
    opens = spans.select(*keys, F.col(since).alias("_at"), F.lit(_OPEN).alias("_kind"), "_span", F.lit(None).cast(points.schema["_point"].dataType).alias("_point"))
    closes = spans.filter(F.col(until).isNotNull()).select(*keys, F.col(until).alias("_at"), F.lit(_CLOSE).alias("_kind"), "_span", F.lit(None).cast(points.schema["_point"].dataType).alias("_point"))
    stops = points.select(*keys, "_at", F.lit(_POINT).alias("_kind"), F.lit(None).cast("bigint").alias("_span"), "_point")
    merged = opens.unionByName(closes).unionByName(stops)
    is_point = F.col("_kind") == _POINT
    scan = OrderedRows.of(merged, keys, ["_at", "_kind"]).running(sums={"_n": F.when(is_point, 1).otherwise(0)})
    counted = pinned(scan.rows(), "counted")

    sizes = counted.filter(is_point).groupBy(*keys).agg(F.max("_n").alias("_points"))
    low = counted.filter(F.col("_kind") == _OPEN).select("_span", F.col("_n").alias("_low"))
    high = counted.filter(F.col("_kind") == _CLOSE).select("_span", F.col("_n").alias("_high"))
    runs = lookup(spans, sizes, keys, ["_span"], "inner").join(low, "_span").join(high, "_span", "left")
    runs = runs.withColumn("_high", F.coalesce("_high", "_points")).filter("_low < _high")

    # The blocks of a run at a size: one at its left end when that is odd, one at its right end when that is odd.
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("_points"))).cast("int"))
    cut = runs.withColumn("_level", F.explode(levels))
    cut = cut.withColumn("_width", F.expr("shiftleft(1L, _level)")).withColumns({"_left": F.expr("(_low + _width - 1) div _width"), "_right": F.expr("_high div _width")}).filter("_left < _right")
    blocks = F.array_compact(F.array(F.when(F.col("_left") % 2 == 1, F.col("_left")), F.when(F.col("_right") % 2 == 1, F.col("_right") - 1)))
    covered = cut.select(*keys, *about, "_level", F.explode(blocks).alias("_block"))

    placed = lookup(counted.filter(is_point), sizes, keys, ["_n"], "inner").withColumn("_level", F.explode(levels))
    placed = placed.select(*keys, "_point", "_n", "_level", F.expr("(_n - 1) div shiftleft(1L, _level)").alias("_block"))
    return lookup(placed, covered, [*keys, "_level", "_block"], ["_n"], "inner").select(*keys, "_point.*", *about)
