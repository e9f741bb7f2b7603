"""Streaming forms of the folds and request plans.

Each job hands its micro-batches to the batch operators together with the state tables left by
earlier batches, and writes the results to batch tables. Inside a batch the operators order and
spread rows as they do in batch mode, so a key that fills a batch is not handled by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rosterfold.functions.etags import USER_SECRET
from rosterfold.functions.names import invitation_parent
from rosterfold.operators import folds, summaries
from rosterfold.operators.gates import passed
from rosterfold.operators.ordered import numbered
from rosterfold.operators.skew import lookup
from rosterfold.operators.workspace import pinned
from rosterfold.plans import removals
from rosterfold.plans.invitations import create_invitations, decided_events, replay_decisions
from rosterfold.plans.users import created_events, create_users, log_of_asked, releases, remove_groups, removed_events, replay_updates, updated_events
from rosterfold.schemas import INVITATION_EVENT, INVITATION_EVENT_ORDER, USER_EVENT, USER_EVENT_ORDER
from rosterfold.streaming.tables import BATCH, BatchTable

_USER_STATE = "name string, uid string, display_name string, email string, aggregate_version int, etag string"
_USER_CHANGE = f"{_USER_STATE}, ts timestamp_ntz, event_rank int, seq bigint, event_type string"
_UID_NAME = "uid string, name string"
_STATUS = """struct<code:int, message:string, violations:array<struct<field:string, description:string>>,
 reason:string, domain:string, metadata:map<string,string>,
 precondition:array<struct<type:string, subject:string, description:string>>>"""
_INVITE_STATUS = f"request_id bigint, gate string, status {_STATUS}"
_INVITE_EVENT = """request_id bigint, name string, group_name string, state string, create_time timestamp_ntz,
 aggregate_version int, etag string"""
_UPDATE_OUTCOME = f"""request_id bigint, ts timestamp_ntz, name string, gate string, status {_STATUS}, uid string,
 display_name string, email string, added_groups array<string>, aggregate_version int, etag string"""
_REMOVE_OUTCOME = f"""request_id bigint, ts timestamp_ntz, user_name string, group_name string, gate string, status {_STATUS},
 groups_left bigint, aggregate_version int, etag string"""
_ORDERED_OUTCOME = f"""request_id bigint, ts timestamp_ntz, user_name string, group_name string, gate string, status {_STATUS}, uid string,
 display_name string, email string, groups_left bigint, aggregate_version int, etag string"""
_GROUP_COUNT = "name string, group_name string, n bigint, as_of bigint"
_INVITATION_STATE = """name string, group_name string, state string, create_time timestamp_ntz, update_time timestamp_ntz,
 aggregate_version int, etag string"""
_INVITATION_CHANGE = f"{_INVITATION_STATE}, ts timestamp_ntz, event_rank int, seq bigint, request_id string, event_type string"
_DECIDE_OUTCOME = f"request_id string, ts timestamp_ntz, action string, gate string, status {_STATUS}, {_INVITATION_STATE}"
_LISTED = "parent string, ordinal bigint, name string"
_COUNTER = "parent string, total bigint"
_CREATE_OUTCOME = f"""request_id bigint, ts timestamp_ntz, uid string, user_id string, display_name string, email string, gate string,
 status {_STATUS}, name string, aggregate_version int, etag string"""
_HELD = "uid string, user_id string"


COMPACT_EVERY = 20


def _columns(schema: StructType) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)


_RELEASE = "kind string, key string, value bigint, ts timestamp_ntz, request_id bigint"


def event_sink(spark: SparkSession, root: str, pipeline: str) -> BatchTable:
    """The events of one of the pipelines ``create``, ``update``, ``remove`` and ``decide``, written with its statuses in each batch."""
    return BatchTable(spark, f"{root}/{pipeline}_events", _columns(INVITATION_EVENT if pipeline == "decide" else USER_EVENT))


def release_sink(spark: SparkSession, root: str) -> BatchTable:
    """Keys that refused create requests give back."""
    return BatchTable(spark, f"{root}/releases", _RELEASE)


def run_to_end(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Process everything available, batch after batch, and stop."""
    query = (stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def user_fold(spark: SparkSession, root: str, secret: str = USER_SECRET) -> tuple[Callable, BatchTable, BatchTable]:
    """Fold user events: (batch function, changelog table, state table)."""
    changes = BatchTable(spark, f"{root}/user_changes", _USER_CHANGE)
    state = BatchTable(spark, f"{root}/users", _USER_STATE, split="name")

    def work(batch: DataFrame, batch_id: int) -> None:
        history = folds.user_history(batch, state.current(["name"], batch_id, batch), secret)
        changes.write(history.filter(F.col("aggregate_version").isNotNull()), batch_id)
        state.write(folds.latest(changes.written(batch_id), ["name"], USER_EVENT_ORDER), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state.compact(["name"], batch_id)

    return work, changes, state


def uid_map(spark: SparkSession, root: str, order: list[str]) -> tuple[Callable, BatchTable]:
    """Keep the uid to name table of created events."""
    table = BatchTable(spark, f"{root}/uid_names", _UID_NAME)

    def work(batch: DataFrame, batch_id: int) -> None:
        table.write(folds.uid_names(batch, order), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            table.compact(["uid"], batch_id)

    return work, table


def invitation_requests(spark: SparkSession, root: str, users: Callable[[], DataFrame],
                        groups: Callable[[], DataFrame]) -> tuple[Callable, BatchTable, BatchTable]:
    """Judge create-invitation requests: statuses and events, two sinks of one stream.

    ``users`` and ``groups`` are read anew for every batch, as a replicated table would be.
    """
    statuses = BatchTable(spark, f"{root}/invitation_statuses", _INVITE_STATUS)
    events = BatchTable(spark, f"{root}/invitation_events", _INVITE_EVENT)

    def work(batch: DataFrame, batch_id: int) -> None:
        outcomes = create_invitations(batch, users(), groups()).persist()
        statuses.write(outcomes, batch_id)
        events.write(passed(outcomes), batch_id)
        outcomes.unpersist()

    return work, statuses, events


def user_requests(spark: SparkSession, root: str) -> tuple[Callable, BatchTable, BatchTable]:
    """Judge create-user requests against everything granted by earlier batches.

    What was granted is kept twice, split by either key, so a batch opens the parts of its own uids and user ids.
    """
    outcomes = BatchTable(spark, f"{root}/create_outcomes", _CREATE_OUTCOME)
    held = {key: BatchTable(spark, f"{root}/granted_by_{key}", _HELD, split=key) for key in ("uid", "user_id")}
    events, freed_keys = event_sink(spark, root, "create"), release_sink(spark, root)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = pinned(batch, "batch")
        known = [table.current([key], batch_id, batch).select("uid", "user_id") for key, table in held.items()]
        outcomes.write(create_users(batch, pinned(known[0].union(known[1]).distinct(), "held")), batch_id)
        done = outcomes.written(batch_id)
        events.write(created_events(done), batch_id)
        uids, ids = (freed.select(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "value", "ts", "request_id")
                     for kind, freed in zip(("uid", "user_id"), releases(done)))
        freed_keys.write(uids.unionByName(ids), batch_id)
        for key, table in held.items():
            table.write(passed(done), batch_id)
            if (batch_id + 1) % COMPACT_EVERY == 0:
                table.compact([key], batch_id)

    return work, outcomes, held["uid"]


def _known(state: BatchTable, start: DataFrame, key: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """State of the batch's keys: as earlier batches left it, else as it was at the start."""
    now = state.current([key], batch_id, batch)
    asked = start.join(batch.select(key).distinct(), key, "left_semi")
    before = asked.join(now.select(key), key, "left_anti").select(*now.columns)
    return pinned(now.unionByName(before), "known")


def update_requests(spark: SparkSession, root: str, start: Callable[[], DataFrame]) -> tuple[Callable, BatchTable, BatchTable]:
    """Judge update requests in order; each sees the updates of earlier batches. ``start``: the users to begin with."""
    outcomes = BatchTable(spark, f"{root}/update_outcomes", _UPDATE_OUTCOME)
    state = BatchTable(spark, f"{root}/updated_users", _USER_STATE, split="name")
    events = event_sink(spark, root, "update")

    def work(batch: DataFrame, batch_id: int) -> None:
        users = _known(state, start(), "name", batch, batch_id)
        outcomes.write(replay_updates(batch, users), batch_id)
        events.write(updated_events(outcomes.written(batch_id)), batch_id)
        state.write(folds.latest(passed(outcomes.written(batch_id)), ["name"], ["aggregate_version"]), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state.compact(["name"], batch_id)

    return work, outcomes, state


def remove_requests(spark: SparkSession, root: str, users: Callable[[], DataFrame],
                    groups: Callable[[], DataFrame]) -> tuple[Callable, BatchTable]:
    """Judge remove-group requests against replicated users and group rows, which are read anew for every batch."""

    def state(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = batch.select(F.col("user_name").alias("name")).distinct()
        return users().join(asked, "name", "left_semi"), groups().join(asked, "name", "left_semi")

    return _removing(spark, root, state)


def remove_requests_of_log(spark: SparkSession, root: str, log: Callable[[], DataFrame]) -> tuple[Callable, BatchTable]:
    """The same against a log of user events; each batch folds the events of the users that it names."""

    def state(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        events = log_of_asked(log(), batch)
        return folds.user_snapshot(folds.user_history(events)), folds.user_groups(events)

    return _removing(spark, root, state)


def _removing(spark: SparkSession, root: str, state: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[Callable, BatchTable]:
    outcomes = BatchTable(spark, f"{root}/remove_outcomes", _REMOVE_OUTCOME)
    events = event_sink(spark, root, "remove")

    def work(batch: DataFrame, batch_id: int) -> None:
        outcomes.write(remove_groups(batch, *state(batch)), batch_id)
        events.write(removed_events(outcomes.written(batch_id)), batch_id)

    return work, outcomes


#: Remove-group requests among user events.
MEMBER_LOG = StructType([*USER_EVENT, StructField("asked_id", LongType())])
REMOVE_ASKED = "RemoveGroupAsked"


def ordered_removals(spark: SparkSession, root: str, secret: str = USER_SECRET) -> tuple[Callable, BatchTable, BatchTable]:
    """Judge remove-group requests in their place among user events: (batch function, outcomes, state of users).

    The stream has events and requests in one order, requests as rows of the type ``REMOVE_ASKED`` with their id. Profiles and versions
    are one state table, how many elements of each group a user holds is another; of both only the parts of the batch's users are opened.
    """
    outcomes = BatchTable(spark, f"{root}/ordered_outcomes", _ORDERED_OUTCOME)
    state = BatchTable(spark, f"{root}/ordered_users", _USER_STATE, split="name")
    held = BatchTable(spark, f"{root}/ordered_groups", _GROUP_COUNT, split="name")

    def work(batch: DataFrame, batch_id: int) -> None:
        asked = batch.filter(F.col("event_type") == REMOVE_ASKED).select(F.col("asked_id").alias("request_id"), "ts", F.col("name").alias("user_name"), "group_name")
        steps = pinned(removals.steps_of(batch.filter(F.col("event_type") != REMOVE_ASKED), asked), "steps")
        names = pinned(steps.select("name").distinct(), "names")
        counts = removals.counts_now(held.stored(["name"], batch_id, names))
        all_names = steps.select("name").unionByName(held.stored(["name"], batch_id).select("name"))
        done = pinned(removals.walked(steps, state.current(["name"], batch_id, names), counts, all_names), "walked")
        outcomes.write(removals.outcomes(done, secret), batch_id)
        state.write(removals.users_after(done, secret), batch_id)
        held.write(removals.counts_after(done).withColumn("as_of", F.lit(batch_id).cast("bigint")), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state.compact(["name"], batch_id)
            held.compact(["name"], batch_id, removals.counts_now)

    return work, outcomes, state


def decision_requests(spark: SparkSession, root: str, start: Callable[[], DataFrame]) -> tuple[Callable, BatchTable, BatchTable]:
    """Judge accept and reject requests in one order; each sees the decisions of earlier batches."""
    outcomes = BatchTable(spark, f"{root}/decide_outcomes", _DECIDE_OUTCOME)
    state = BatchTable(spark, f"{root}/decided_invitations", _INVITATION_STATE, split="name")
    events = event_sink(spark, root, "decide")

    def work(batch: DataFrame, batch_id: int) -> None:
        # The state and the start are joined by name as they are, so that neither is written or sent once more.
        outcomes.write(replay_decisions(batch, start(), changed=state.current(["name"], batch_id, batch)), batch_id)
        events.write(decided_events(outcomes.written(batch_id)), batch_id)
        state.write(passed(outcomes.written(batch_id)), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state.compact(["name"], batch_id)

    return work, outcomes, state


def invitation_fold(spark: SparkSession, root: str) -> tuple[Callable, BatchTable, BatchTable]:
    """Fold invitation events: (batch function, changelog table, state table)."""
    changes = BatchTable(spark, f"{root}/invitation_changes", _INVITATION_CHANGE)
    state = BatchTable(spark, f"{root}/invitations", _INVITATION_STATE, split="name")

    def work(batch: DataFrame, batch_id: int) -> None:
        history = folds.invitation_history(batch, state.current(["name"], batch_id, batch))
        changes.write(history.filter(F.col("aggregate_version").isNotNull()), batch_id)
        state.write(folds.latest(changes.written(batch_id), ["name"], INVITATION_EVENT_ORDER), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            state.compact(["name"], batch_id)

    return work, changes, state


def invitation_index(spark: SparkSession, root: str) -> tuple[Callable, Callable[..., DataFrame]]:
    """Number created invitations as they come: (batch function, reader of the index of all or some parents).

    An invitation gets the next ordinal of its parent and keeps it; a counter for each parent is all that a batch reads, and
    only those of its own parents. The position, newest first, is count - ordinal + 1. Invitations of later batches are newer.
    """
    entries = BatchTable(spark, f"{root}/index_entries", _LISTED, split="parent")
    counters = BatchTable(spark, f"{root}/index_counts", _COUNTER, split="parent")

    def work(batch: DataFrame, batch_id: int) -> None:
        made = batch.filter(F.col("event_type") == folds.INVITATION_CREATED).withColumn("parent", invitation_parent("name")).filter("parent <> ''")
        made = pinned(numbered(made.select("parent", "name", *INVITATION_EVENT_ORDER), ["parent"], INVITATION_EVENT_ORDER, "nth"), "listed")
        sizes = pinned(made.groupBy("parent").agg(F.count(F.lit(1)).alias("added")), "added")
        before = counters.current(["parent"], batch_id, sizes)
        totals = pinned(sizes.join(before, "parent", "left").withColumn("before", F.coalesce("total", F.lit(0).cast("bigint"))), "totals")
        placed = lookup(made, totals.select("parent", "before"), ["parent"], ["name"], "inner")
        entries.write(placed.withColumn("ordinal", F.col("before") + F.col("nth")), batch_id)
        counters.write(totals.withColumn("total", F.col("before") + F.col("added")), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            counters.compact(["parent"], batch_id)
            entries.compact(["parent"], batch_id, lambda rows: rows)

    def read(parents: DataFrame | None = None) -> DataFrame:
        wanted = None if parents is None else parents.select("parent").distinct()
        totals = counters.current(["parent"], wanted=wanted)
        rows = lookup(entries.stored(["parent"], wanted=wanted), totals, ["parent"], ["ordinal"], "inner")
        return rows.select("parent", (F.col("total") - F.col("ordinal") + 1).alias("position"), "name")

    return work, read


def user_group_lists(spark: SparkSession, root: str) -> tuple[Callable, Callable[..., DataFrame], BatchTable]:
    """Keep group lists as summaries: (batch function, reader of the lists of all or some users, table of summaries).

    A batch writes the summary of its own events and reads nothing; a reader, and now and then a compaction, merges summaries.
    """
    table = BatchTable(spark, f"{root}/group_summaries", summaries.COLUMNS, split="name")

    def work(batch: DataFrame, batch_id: int) -> None:
        table.write(summaries.summary(batch), batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            table.compact(["name"], batch_id, summaries.merged)

    def read(names: DataFrame | None = None) -> DataFrame:
        wanted = None if names is None else names.select("name").distinct()
        return summaries.lists(table.stored(["name"], wanted=wanted).drop(BATCH))

    return work, read, table
