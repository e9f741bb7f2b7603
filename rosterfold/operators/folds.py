"""Folding event logs into versioned state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions.etags import INVITATION_SECRET, USER_SECRET, etag
from rosterfold.functions.names import invitation_parent
from rosterfold.operators.intervals import open_at
from rosterfold.operators.ordered import OrderedRows, numbered
from rosterfold.operators.skew import Probe, lookup
from rosterfold.schemas import INVITATION_EVENT_ORDER, INVITATION_EVENT_TYPES, USER_EVENT_ORDER, USER_EVENT_TYPES

USER_CREATED, USER_UPDATED, GROUP_CREATED, _, GROUP_REMOVED = USER_EVENT_TYPES
INVITATION_CREATED, INVITATION_ACCEPTED, INVITATION_REJECTED = INVITATION_EVENT_TYPES


def is_snapshot() -> Column:
    """Created and Updated replace the whole user by their payload."""
    return F.col("event_type").isin(USER_CREATED, USER_UPDATED)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key. Combined before the shuffle, so the size of a key does not matter."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*"))


def _versions(log: DataFrame, order: list[str], created: str, payload: list[str], carries: Column | None,
              prior: DataFrame | None, secret: str) -> DataFrame:
    """Epoch, version, etag and running payload of every event.

    A created event starts an epoch at version 1; every other event adds one. Without a created
    event, the count goes on from the version in ``prior``; without a prior row either, the event
    has no subject and its version stays null. ``payload`` columns hold the values of the last event
    that ``carries`` them.
    """
    created_here = F.col("event_type") == created
    lasts = {"_payload": F.when(carries, F.struct(*payload))} if payload else {}
    probe = Probe(log)
    rows = (OrderedRows.of(log, ["name"], order, probe=probe)
            .running(sums={"_place": F.lit(1), "epoch": F.when(created_here, 1).otherwise(0)}, lasts=lasts)
            .running(lasts={"_start": F.when(created_here, F.col("_place"))})
            .rows())
    version = F.col("_place") - F.col("_start") + 1
    if prior is not None:
        known = prior.select("name", F.col("aggregate_version").alias("_version"),
                             F.struct("name", *payload).alias("_prior"))
        rows = lookup(rows, known, ["name"], order, probe=probe)
        version = F.coalesce(version, F.col("_version") + F.col("_place"))
    rows = rows.withColumn("aggregate_version", version.cast("int"))
    alive = F.col("aggregate_version").isNotNull()

    def running_value(column: str) -> Column:
        value = F.col(f"_payload.{column}")
        if prior is not None:
            value = F.when(F.col("_payload").isNotNull(), value).otherwise(F.col(f"_prior.{column}"))
        return F.when(alive, value)

    rows = rows.withColumns({
        **{column: running_value(column) for column in payload},
        "etag": F.when(alive, etag(secret, F.col("name"), F.col("aggregate_version")))})
    return rows.drop("_place", "_payload", "_start", "_version", "_prior")


USER_PAYLOAD = ["uid", "display_name", "email"]


def user_history(events: DataFrame, prior: DataFrame | None = None, secret: str = USER_SECRET) -> DataFrame:
    """One row per user event: the state right after it. Group lists are in ``group_spans``.

    Rows with a null version had no user to act on; see ``orphans``.
    """
    return _versions(events, USER_EVENT_ORDER, USER_CREATED, USER_PAYLOAD, is_snapshot(), prior, secret)


def orphans(history: DataFrame) -> DataFrame:
    return history.filter(F.col("aggregate_version").isNull())


def user_snapshot(history: DataFrame) -> DataFrame:
    """Current state of every user."""
    known = history.filter(F.col("aggregate_version").isNotNull()).select(
        "name", *USER_PAYLOAD, "aggregate_version", "etag", *USER_EVENT_ORDER)
    return latest(known, ["name"], USER_EVENT_ORDER)


def before_all() -> Column:
    """A place before all events, where users begin that a log finds already there."""
    return F.struct(F.lit("0001-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("event_rank"), F.lit(0).cast("bigint").alias("seq"))


def births(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Place ``_born`` of each user's first created event, ahead of all places for users in ``prior``: earlier events have
    no subject."""
    born = events.filter(F.col("event_type") == USER_CREATED).select("name", F.struct(*USER_EVENT_ORDER).alias("_born"))
    if prior is not None:
        born = born.unionByName(prior.select("name", before_all().alias("_born")))
    return born.groupBy("name").agg(F.min("_born").alias("_born"))


def membership_changes(events: DataFrame, probe: Probe, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Added memberships, places of list resets per user, and removals, of events that have a subject.

    A created or updated event with a list resets the user's list to it. An updated event without
    one leaves the list alone; what an event appends is in ``added_groups``.
    """
    events = lookup(events.withColumn("_at", F.struct(*USER_EVENT_ORDER)), births(events, prior), ["name"],
                    USER_EVENT_ORDER, "inner", probe)
    events = events.filter(F.col("_at") >= F.col("_born")).drop("_born")
    resets = events.filter((F.col("event_type") == USER_CREATED) | (is_snapshot() & F.col("groups").isNotNull()))
    joins = F.col("event_type").isin(GROUP_CREATED, INVITATION_ACCEPTED)
    arriving = (F.when(joins, F.array("group_name"))
                .when(is_snapshot(), F.concat(F.coalesce("groups", F.array()), F.coalesce("added_groups", F.array()))))
    added = events.select("name", *USER_EVENT_ORDER, "_at", F.posexplode(arriving).alias("ordinal", "group_name"))
    removed = events.filter(F.col("event_type") == GROUP_REMOVED).select("name", "group_name", "_at")
    return added, resets.select("name", "_at"), removed


def user_groups(events: DataFrame) -> DataFrame:
    """Current groups of every user, one row per list element with its 1-based position.

    An added element survives when neither a later reset of the user's list nor a later removal of
    the same group exists; both are maxima per key. Equal elements are kept, as the list keeps them.
    """
    probe = Probe(events)
    added, resets, removed = membership_changes(events, probe)
    reset = resets.groupBy("name").agg(F.max("_at").alias("_reset"))
    gone = removed.groupBy("name", "group_name").agg(F.max("_at").alias("_gone"))
    order = [*USER_EVENT_ORDER, "ordinal"]
    alive = lookup(added, reset, ["name"], order, probe=probe)
    alive = alive.filter(F.col("_at") >= F.col("_reset"))
    alive = lookup(alive, gone, ["name", "group_name"], order, probe=probe)
    alive = alive.filter(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    return (numbered(alive, ["name"], order, "position", probe=probe)
            .select("name", "position", "group_name", F.col("ts").alias("since_ts"), F.col("seq").alias("since_seq")))


def group_spans(events: DataFrame) -> DataFrame:
    """Every membership a user ever had, with the event that ended it (null while it lasts).

    This is the history of the group lists: the list at any version is the spans open at it, in
    (since, ordinal) order. One row per addition, where a list per version would be quadratic.
    """
    probe = Probe(events)
    added, resets, removed = membership_changes(events, probe)
    ends = _first_after(_first_after(added, resets, ["name"], "_reset", probe), removed, ["name", "group_name"], "_gone", probe)
    until = F.least("_reset", "_gone")
    return ends.select("name", "group_name", F.col("ts").alias("since_ts"), F.col("event_rank").alias("since_rank"),
                       F.col("seq").alias("since_seq"), "ordinal", until["ts"].alias("until_ts"),
                       until["event_rank"].alias("until_rank"), until["seq"].alias("until_seq"))


def groups_at(spans: DataFrame, places: DataFrame) -> DataFrame:
    """The group list of each place (name, ts, event_rank, seq, and other columns) of a user's history, as rows in list
    order: the spans that are open right after that event. Users with many spans and many places are not compared pair by pair."""
    until = F.when(F.col("until_ts").isNotNull(), F.struct(F.col("until_ts").alias("ts"), F.col("until_rank").alias("event_rank"), F.col("until_seq").alias("seq")))
    held = spans.select("name", "group_name", F.struct(F.col("since_ts").alias("ts"), F.col("since_rank").alias("event_rank"), F.col("since_seq").alias("seq")).alias("_since"),
                        "ordinal", until.alias("_until"))
    listed = open_at(places.withColumn("_place", F.struct(*USER_EVENT_ORDER)), held, ["name"], "_place", "_since", "_until")
    return (numbered(listed, places.columns, ["_since", "ordinal"], "position")
            .select(*places.columns, "position", "group_name"))


def state_at(history: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """``places`` (name, ts, event_rank, seq, and others) with ``columns`` of the user right after them, null before it exists.

    History and places are read in one order, and each place takes the last state before it; no pair is made of them.
    """
    state = history.filter(F.col("aggregate_version").isNotNull()).select("name", *USER_EVENT_ORDER, F.struct(*columns).alias("_state"), F.lit(0).alias("_asks"))
    merged = places.withColumn("_asks", F.lit(1)).unionByName(state, allowMissingColumns=True)
    rows = OrderedRows.of(merged, ["name"], [*USER_EVENT_ORDER, "_asks"]).running(lasts={"_state": F.col("_state")}).rows()
    return rows.filter("_asks = 1").select(*places.columns, *[F.col(f"_state.{c}").alias(c) for c in columns])


def _first_after(rows: DataFrame, marks: DataFrame, keys: list[str], name: str, probe: Probe) -> DataFrame:
    """Add the place ``_at`` of the first mark after each row of its key, null without one.

    Rows and marks are merged and read backwards. A row at the place of a mark comes from that very
    event and is not ended by it, so at equal places marks come later in the backward reading.
    """
    asks = rows.withColumn("_mark", F.lit(1))
    answers = marks.select(*keys, "_at").withColumn("_mark", F.lit(0))
    merged = asks.unionByName(answers, allowMissingColumns=True)
    return (OrderedRows.of(merged, keys, ["_at", "_mark", "ordinal"], descending=True, probe=probe)
            .running(lasts={name: F.when(F.col("_mark") == 0, F.col("_at"))}).rows()
            .filter("_mark = 1").drop("_mark"))


def invitation_history(events: DataFrame, prior: DataFrame | None = None, secret: str = INVITATION_SECRET) -> DataFrame:
    """One row per invitation event: its payload with the version and etag it has from then on."""
    return _versions(events, INVITATION_EVENT_ORDER, INVITATION_CREATED, [], None, prior, secret)


def invitation_snapshot(history: DataFrame) -> DataFrame:
    known = history.filter(F.col("aggregate_version").isNotNull()).select(
        "name", "group_name", "state", "create_time", "update_time", "aggregate_version", "etag",
        *INVITATION_EVENT_ORDER)
    return latest(known, ["name"], INVITATION_EVENT_ORDER)


def invitation_index(created: DataFrame) -> DataFrame:
    """Invitations of every parent, newest first, as numbered rows.

    Built from created events only, so decided invitations stay listed. Names without a parent part
    are left to ``unnamed_parents``.
    """
    listed = created.withColumn("parent", invitation_parent("name")).filter("parent <> ''")
    return (numbered(listed, ["parent"], INVITATION_EVENT_ORDER, "position", descending=True)
            .select("parent", "position", "name"))


def unnamed_parents(created: DataFrame) -> DataFrame:
    return created.filter(invitation_parent("name") == "")


def uid_names(created: DataFrame, order: list[str]) -> DataFrame:
    """Name registered for each uid, last writer wins."""
    return latest(created.select("uid", "name", *order), ["uid"], order).select("uid", "name")


def last_write(writes: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Table from a stream of writes: the last non-null value of each key."""
    kept = writes.filter(F.col(value).isNotNull()).select(key, value, *order)
    return latest(kept, [key], order).select(key, value)
