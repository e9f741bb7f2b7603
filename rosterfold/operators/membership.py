"""Removals from group lists, in order.

What a removal takes out depends on what came before it: the user's list may have been replaced, the group may have been added
more than once, and an earlier removal may have taken it out. But whatever an earlier removal of the same group found,
the group is not in the list after it. So a removal takes out the additions of its (user, group) since the latest of the
list's resets and of the removals of that group, and no removal has to wait for another one's outcome.

Resets cut a user's rows into epochs, removals cut a group's rows of an epoch into stretches; both are running counts. The
additions of a stretch are counted before they are shuffled and joined to the one removal that ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.operators.ordered import OrderedRows
from rosterfold.operators.skew import Probe
from rosterfold.operators.workspace import pinned

_RESET, _ADD, _REMOVE = 0, 1, 2


def removals_in_order(added: DataFrame, resets: DataFrame, removed: DataFrame, probe: Probe | None = None) -> DataFrame:
    """``removed`` with ``equal``, how many elements each removal takes out, and ``left``, how many the list has after it.

    ``added`` has (name, group_name, _at, ordinal), ``resets`` (name, _at), ``removed`` (name, group_name, _at), where ``_at``
    is a place in the user's history. What stands at the place of a reset is the new list. Places of removals are unique
    in a user's history.
    """
    group = removed.schema["group_name"].dataType
    rows = (added.select("name", "group_name", "_at", F.col("ordinal").cast("int").alias("ordinal"), F.lit(_ADD).alias("_kind"))
            .unionByName(resets.select("name", F.lit(None).cast(group).alias("group_name"), "_at", F.lit(-1).alias("ordinal"), F.lit(_RESET).alias("_kind")))
            .unionByName(removed.select("name", "group_name", "_at", F.lit(0).alias("ordinal"), F.lit(_REMOVE).alias("_kind"))))
    order = ["_at", "ordinal"]
    removing = F.col("_kind") == _REMOVE
    epochs = OrderedRows.of(rows, ["name"], order, probe=probe).running(sums={"_epoch": F.when(F.col("_kind") == _RESET, 1).otherwise(0)}).rows()
    epochs = pinned(epochs, "epochs")
    probe = Probe(epochs)
    cut = (OrderedRows.of(epochs.filter(F.col("_kind") != _RESET), ["name", "group_name", "_epoch"], order, probe=probe)
           .running(sums={"_stretch": F.when(removing, 1).otherwise(0)}).rows())
    cut = cut.withColumn("_stretch", F.col("_stretch") - F.when(removing, 1).otherwise(0))
    stretch = ["name", "group_name", "_epoch", "_stretch"]
    sizes = cut.filter(~removing).groupBy(*stretch).agg(F.count(F.lit(1)).alias("equal"))
    # A stretch has one removal, so no key of this join is heavy.
    ended = cut.filter(removing).join(sizes, stretch, "left").withColumn("equal", F.coalesce("equal", F.lit(0).cast("bigint")))
    steps = epochs.filter(F.col("_kind") == _ADD).withColumn("equal", F.lit(0).cast("bigint")).unionByName(ended.select(*epochs.columns, "equal"))
    left = (OrderedRows.of(steps, ["name", "_epoch"], order, probe=probe)
            .running(sums={"left": F.when(removing, -F.col("equal")).otherwise(1)}).rows())
    found = left.filter(removing).select("name", "group_name", "_at", "equal", "left")
    return removed.join(found, ["name", "group_name", "_at"], "left").select(*removed.columns, "equal", "left")
