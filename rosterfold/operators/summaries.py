"""Group lists as summaries that can be merged in any order.

Four kinds of rows say all that matters of a user's events: the place of its birth, of the last reset of its list, of the last removal of
each group, and the added elements that none of these has closed. What is closed within one part of the log stays closed
when other parts are added, and the last of two marks is the last of all, so summaries of parts can be merged two at a time or
all at once, in any order, and a part that is merged twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterfold.operators.folds import GROUP_CREATED, GROUP_REMOVED, INVITATION_ACCEPTED, USER_CREATED, is_snapshot
from rosterfold.operators.ordered import numbered
from rosterfold.operators.skew import lookup
from rosterfold.operators.workspace import pinned
from rosterfold.schemas import USER_EVENT_ORDER

_AT = "at struct<ts: timestamp_ntz, event_rank: int, seq: bigint>"
COLUMNS = f"name string, kind string, group_name string, {_AT}, ordinal int"
_BIRTH, _RESET, _REMOVAL, _ELEMENT = "birth", "reset", "removal", "element"


def summary(events: DataFrame) -> DataFrame:
    """The summary of some user events."""
    at = F.struct(*USER_EVENT_ORDER).alias("at")
    none, first = F.lit(None).cast("string").alias("group_name"), F.lit(0).alias("ordinal")
    created = F.col("event_type") == USER_CREATED
    resets = created | (is_snapshot() & F.col("groups").isNotNull())
    joins = F.col("event_type").isin(GROUP_CREATED, INVITATION_ACCEPTED)
    arriving = (F.when(joins, F.array("group_name"))
                .when(is_snapshot(), F.concat(F.coalesce("groups", F.array()), F.coalesce("added_groups", F.array()))))
    rows = (events.filter(created).select("name", F.lit(_BIRTH).alias("kind"), none, at, first)
            .unionByName(events.filter(resets).select("name", F.lit(_RESET).alias("kind"), none, at, first))
            .unionByName(events.filter(F.col("event_type") == GROUP_REMOVED).select("name", F.lit(_REMOVAL).alias("kind"), "group_name", at, first))
            .unionByName(events.select("name", F.lit(_ELEMENT).alias("kind"), at, F.posexplode(arriving).alias("ordinal", "group_name"))))
    return merged(rows.select("name", "kind", "group_name", "at", "ordinal"))


def merged(rows: DataFrame) -> DataFrame:
    """One summary of the rows of several."""
    rows = pinned(rows, "summaries")
    births = rows.filter(F.col("kind") == _BIRTH).groupBy("name").agg(F.min("at").alias("at"))
    resets = rows.filter(F.col("kind") == _RESET).groupBy("name").agg(F.max("at").alias("at"))
    removals = rows.filter(F.col("kind") == _REMOVAL).groupBy("name", "group_name").agg(F.max("at").alias("at"))
    reset = resets.withColumnRenamed("at", "_reset")
    # A removal before the last reset can close nothing any more.
    removals = lookup(removals, reset, ["name"], ["group_name"]).filter("_reset is null or at > _reset").drop("_reset")
    # Parts that are merged twice bring their elements twice.
    elements = rows.filter(F.col("kind") == _ELEMENT).select("name", "group_name", "at", "ordinal").distinct()
    open_ = lookup(elements, reset, ["name"], ["at", "ordinal"]).filter("_reset is null or at >= _reset")
    open_ = lookup(open_, removals.withColumnRenamed("at", "_gone"), ["name", "group_name"], ["at", "ordinal"]).filter("_gone is null or at > _gone")

    def of(kind: str, df: DataFrame) -> DataFrame:
        group = F.col("group_name") if "group_name" in df.columns else F.lit(None).cast("string").alias("group_name")
        ordinal = F.col("ordinal") if "ordinal" in df.columns else F.lit(0).alias("ordinal")
        return df.select("name", F.lit(kind).alias("kind"), group, "at", ordinal)

    return of(_BIRTH, births).unionByName(of(_RESET, resets)).unionByName(of(_REMOVAL, removals)).unionByName(of(_ELEMENT, open_))


def lists(rows: DataFrame) -> DataFrame:
    """The current lists, one row per element with its 1-based position, as ``folds.user_groups`` gives them."""
    now = pinned(merged(rows), "summary")
    births = now.filter(F.col("kind") == _BIRTH).select("name", F.col("at").alias("_born"))
    open_ = lookup(now.filter(F.col("kind") == _ELEMENT), births, ["name"], ["at", "ordinal"], "inner").filter("at >= _born")
    return numbered(open_, ["name"], ["at", "ordinal"], "position").select(
        "name", "position", "group_name", F.col("at.ts").alias("since_ts"), F.col("at.seq").alias("since_seq"))
