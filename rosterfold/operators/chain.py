"""Chains of optimistic updates.

A resource stands at some version. A request that names this version takes effect and moves it to
the next one; then the first later request that names the next version takes effect, and so on. To
find the effective requests without walking one resource's requests in one place:

* the first request of the starting version is a minimum per resource;
* every request points to the first later request of the following version, a running value inside
  (resource, version);
* the requests reachable from the starts are collected by doubling the pointers, so a chain of n
  effective requests takes about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.operators.ordered import OrderedRows
from rosterfold.operators.skew import lookup
from rosterfold.operators.workspace import pinned


def effective(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Effective rows of (key, *order, level) requests, as (key, level, *order).

    ``level`` counts the versions between the resource's starting version and the one a request
    names: 0 is the starting version. (key, *order) is unique.
    """
    nodes = requests.select(key, "level", F.struct(*order).alias("place"))
    starts = nodes.filter("level = 0").groupBy(key, "level").agg(F.min("place").alias("place"))
    # Only the first request of level 0 can take effect, so it alone stands for its level.
    nodes = starts.unionByName(nodes.filter("level > 0"))

    asking = nodes.select(key, (F.col("level") + 1).alias("level"), "place", F.lit(False).alias("answers"))
    answering = nodes.filter("level > 0").withColumn("answers", F.lit(True))
    steps = (OrderedRows.of(asking.unionByName(answering), [key, "level"], ["place"], descending=True)
             .running(lasts={"goal": F.when(F.col("answers"), F.col("place"))}).rows()
             .filter("not answers and goal is not null")
             .select(key, "place", "goal", (F.col("level") - 1).alias("level")))
    steps = pinned(steps, "chain")
    if steps.isEmpty():
        return starts.select(key, "level", "place.*")
    # A request nobody points to is dead unless it is a start.
    aimed = (steps.select(key, F.col("goal").alias("place"))
             .unionByName(starts.select(key, "place")).distinct())
    steps = pinned(steps.join(aimed, [key, "place"], "left_semi"), "chain")

    # What was reached is a union of written tables, one for each round.
    reached, span = pinned(starts, "chain"), 1
    while True:
        found = lookup(reached, steps.select(key, "place", "goal"), [key, "place"], ["level"], "inner").select(
            key, (F.col("level") + span).alias("level"), F.col("goal").alias("place"))
        found = pinned(found, "chain")
        if found.isEmpty():
            break
        reached = reached.unionByName(found)
        onward = steps.select(key, F.col("place").alias("goal"), F.col("goal").alias("further"))
        steps = pinned(lookup(steps, onward, [key, "goal"], ["place"], "inner").select(
            key, "place", F.col("further").alias("goal"), "level"), "chain")
        span *= 2
    return reached.select(key, "level", "place.*")
