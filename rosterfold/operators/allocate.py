"""Granting two unique keys at once, first valid request first.

A request is granted when its fields are valid and no earlier granted request has its first or its
second key; a refused request holds nothing. That is a greedy matching in request order. It is
computed in rounds over the live (not yet decided) requests:

* a request that is the earliest of both its keys is granted;
* a request that is the earliest of one key and the second of the other has exactly one live request
  before it, and its outcome is the opposite of that one's. Such requests point to their blocker;
  pointers are doubled with the parity of the steps, so that a chain of n requests which block one
  another in turn is decided in about log2(n) joins, back to where it begins;
* everything that shares a key with a granted request leaves.

Requests with two or more live requests before them wait for the next round. An input may be made
so that many of them are left in each; it then takes more rounds, but no size changes the path. Only the
two earliest requests of a key can be decided, and each task keeps no more than two of a key before it sends
them, so no key is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rosterfold.operators.skew import lookup
from rosterfold.operators.workspace import new_folder, pinned


def allocated(requests: DataFrame, first: str, second: str, order: list[str],
              held: DataFrame | None = None) -> DataFrame:
    """Granted requests as (first, second, *order) out of valid ones; ``order`` is unique.

    ``held`` lists pairs granted earlier, which block requests of any order.
    """
    spark = requests.sparkSession
    live = requests.groupBy(first, second).agg(F.min(F.struct(*order)).alias("_place"))
    if held is not None:
        for key in (first, second):
            live = lookup(live, held.select(key), [key], ["_place"], "left_anti")
    live = pinned(live, "requests")
    folder, rounds = new_folder(spark, "granted"), 0
    while True:
        path = f"{folder}/round={rounds}"
        _granted(live, first, second).write.parquet(path)
        now = spark.read.schema(live.schema).parquet(path)
        for key in (first, second):
            live = lookup(live, now.select(key), [key], ["_place"], "left_anti")
        live = pinned(live, "live")
        rounds += 1
        if live.isEmpty():
            break
    return spark.read.schema(live.schema).parquet(folder).select(first, second, "_place.*")


def _earliest(live: DataFrame, key: str, other: str) -> DataFrame:
    """The two earliest requests of each key, with their number and the place of the first."""
    order = Window.partitionBy(key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (live.select(key, other, "_place")
            .withColumns({f"_nth_{key}": F.row_number().over(order), f"_one_{key}": F.min("_place").over(order)})
            .filter(F.col(f"_nth_{key}") <= 2))


def _granted(live: DataFrame, first: str, second: str) -> DataFrame:
    """Live requests whose outcome is known to be a grant."""
    ranked = _earliest(live, first, second).join(_earliest(live, second, first), [first, second, "_place"])
    one, two = F.col(f"_nth_{first}") == 1, F.col(f"_nth_{second}") == 1
    # The only live request before one that is the first of one key and the second of the other.
    blocker = F.when(one & ~two, F.col(f"_one_{second}")).when(~one & two, F.col(f"_one_{first}"))
    ranked = pinned(ranked.filter(one | two).select(first, second, "_place", blocker.alias("_to")), "ranked")
    winners = ranked.filter("_to is null").select(first, second, "_place")
    steps = ranked.filter("_to is not null").select("_place", "_to", F.lit(True).alias("_odd"))
    if steps.isEmpty():
        return winners
    even = (_followed(steps).filter("not _odd")
            .join(winners.select(F.col("_place").alias("_to")), "_to", "left_semi").select("_place"))
    return winners.unionByName(ranked.join(even, "_place", "left_semi").select(*winners.columns))


def _followed(steps: DataFrame) -> DataFrame:
    """Where each chain of pointers ends, and whether it has an odd number of steps."""
    rows = steps
    while True:
        onward = rows.select(F.col("_place").alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_odd_far"))
        joined = rows.join(onward, "_to", "left")
        rows = pinned(joined.select(
            "_place", F.coalesce("_far", "_to").alias("_to"), F.col("_far").isNull().alias("_ended"),
            F.when(F.col("_far").isNull(), F.col("_odd")).otherwise(F.col("_odd") != F.col("_odd_far")).alias("_odd")), "chain")
        if rows.filter("not _ended").isEmpty():
            return rows.select("_place", "_to", "_odd")
