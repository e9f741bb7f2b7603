"""The registered queries: every operator over the derived directory data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rosterfold.functions import masks, paging, rules
from rosterfold.functions.etags import user_etag
from rosterfold.functions.names import invitation_parent
from rosterfold.functions.status import flat_status
from rosterfold.functions.text import strip_blank, units
from rosterfold.operators import folds
from rosterfold.operators.skew import Probe, lookup
from rosterfold.operators.workspace import move_files, new_folder, pinned
from rosterfold.plans import directory, invitations, lookups, users
from rosterfold.schemas import (CREATE_INVITATION_REQUEST, CREATE_USER_REQUEST, DECIDE_INVITATION_REQUEST, INVITATION_EVENT,
                                REMOVE_GROUP_REQUEST, UPDATE_USER_REQUEST, USER_EVENT, USER_EVENT_ORDER, USER_EVENT_TYPES)
from rosterfold.sources import fixtures as fx
from rosterfold.sources import layout, tables
from rosterfold.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# Scalar functions.


@registered
def etag_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.users(spark, sf_dir).select("name", "aggregate_version")
    return rows.withColumn("etag", user_etag(F.col("name"), F.col("aggregate_version")))


@registered
def parent_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.created_invitations(spark, sf_dir).select("name", invitation_parent("name").alias("parent"))


def _trimmed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.create_user_requests(spark, sf_dir).withColumns({
        "display_name": strip_blank(F.col("display_name")), "email": strip_blank(F.col("email"))})


@registered
def trimmed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed_requests(spark, sf_dir).select(
        "request_id", "display_name", "email", units(F.col("display_name")).cast("int").alias("display_units"))


def _errors(df: DataFrame, errors, *columns: str) -> DataFrame:
    return df.withColumn("_e", errors).select(
        *columns, F.array_join("_e.field", ",").alias("violation_fields"),
        F.array_join("_e.description", ",").alias("violation_texts"))


@registered
def user_id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(fx.create_user_requests(spark, sf_dir), rules.user_id_violations(F.col("user_id")),
                   "request_id", "user_id")


@registered
def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = rules.profile_violations(F.col("display_name"), F.col("email"), F.col("uid"))
    return _errors(_trimmed_requests(spark, sf_dir), errors, "request_id")


@registered
def mask_clean_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fx.users(spark, sf_dir).select("name", F.col("display_name").alias("d"), F.col("email").alias("e"))
    rows = lookup(fx.update_user_requests(spark, sf_dir), stored, ["name"], ["request_id"], "inner")
    rows = rows.withColumn("m", masks.writable(F.col("mask")))
    return rows.select(
        "request_id", F.array_join(F.array_sort("m"), ",").alias("clean_mask"),
        masks.is_known(F.col("m")).alias("mask_known"),
        strip_blank(masks.merged(F.col("m"), "display_name", F.col("display_name"), F.col("d"))).alias("display_name"),
        strip_blank(masks.merged(F.col("m"), "email", F.col("email"), F.col("e"))).alias("email"))


@registered
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.lookup_requests(spark, sf_dir).select("request_id", paging.page_offset(F.col("page_token")).alias("page_offset"))
    return rows.select("request_id", paging.page_token(F.col("page_offset")).alias("page_token"), "page_offset")


# Requests.


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.update_users(fx.update_user_requests(spark, sf_dir), fx.users(spark, sf_dir))


def _creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.create_users(fx.create_user_requests(spark, sf_dir))


@registered
def gate_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_updates(spark, sf_dir).groupBy(F.coalesce("gate", F.lit("passed")).alias("gate"))
            .agg(F.count(F.lit(1)).alias("requests")))


@registered
def uid_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.seen_counts(fx.create_user_requests(spark, sf_dir), "uid")


def _reaching_user_id(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.coalesce(~F.col("gate").isin("uid", "user_id_format"), F.lit(True)))


@registered
def user_id_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = fx.create_user_requests(spark, sf_dir)
    return users.seen_counts(_reaching_user_id(users.create_users(requests)), "user_id", Probe(requests))


@registered
def last_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = pinned(_creates(spark, sf_dir), "creates")
    freed_uids, freed_ids = users.releases(outcomes)
    tables_ = []
    for kind, counts, freed in (("uid", outcomes, freed_uids), ("user_id", _reaching_user_id(outcomes), freed_ids)):
        writes = (users.seen_counts(counts, kind).withColumn("step", F.lit(0))
                  .unionByName(freed.withColumn("step", F.lit(1))))
        table = folds.last_write(writes, kind, "value", ["ts", "request_id", "step"])
        tables_.append(table.select(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "value"))
    return tables_[0].unionByName(tables_[1])


@registered
def create_user_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_status(_creates(spark, sf_dir), "request_id", "uid", "user_id", "gate", "name",
                                "aggregate_version", "etag").drop("precondition")


@registered
def user_created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.created_events(_creates(spark, sf_dir)).select("name", "event_type", "seq", "uid", "display_name", "email")


_UPDATE_COLUMNS = ["request_id", "name", "gate", "display_name", "email", "aggregate_version", "etag"]


@registered
def update_user_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_status(_updates(spark, sf_dir), *_UPDATE_COLUMNS).drop("precondition")


@registered
def update_user_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = users.replay_updates(fx.update_user_requests(spark, sf_dir), fx.users(spark, sf_dir))
    return flat_status(outcomes, *_UPDATE_COLUMNS).drop("precondition")


def _removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = fx.remove_group_requests(spark, sf_dir)
    log = users.log_of_asked(fx.user_events(spark, sf_dir), requests)
    return users.remove_groups(requests, folds.user_snapshot(folds.user_history(log)), folds.user_groups(log))


@registered
def remove_group_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removals(spark, sf_dir).select(
        "request_id", "user_name", "group_name", "gate", F.col("status.code").alias("code"),
        F.col("status.message").alias("message"), "display_name", "groups_left", "aggregate_version", "etag")


@registered
def remove_group_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.remaining_groups(_removals(spark, sf_dir), folds.user_groups(fx.user_events(spark, sf_dir)))


@registered
def remove_group_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals in their place among the events of the log, each after the removals before it."""
    outcomes = directory.replay_removals(fx.remove_group_requests(spark, sf_dir), fx.near_user_events(spark, sf_dir))
    return outcomes.select("request_id", "user_name", "group_name", "gate", F.col("status.code").alias("code"), F.col("status.message").alias("message"),
                           "display_name", "groups_left", "aggregate_version", "etag")


def _invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invitations.create_invitations(fx.create_invitation_requests(spark, sf_dir), fx.users(spark, sf_dir),
                                          fx.groups(spark, sf_dir))


@registered
def create_invitation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_status(_invites(spark, sf_dir), "request_id", "parent", "group_name", "gate", "name", "state",
                       "create_time", "aggregate_version", "etag")
    return flat.drop("reason", "detail", "precondition")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.invitation_snapshot(folds.invitation_history(fx.created_invitations(spark, sf_dir)))


_DECISION_COLUMNS = ["request_id", "name", "action", "gate", "group_name", "state", "create_time",
                     "update_time", "aggregate_version", "etag"]


@registered
def decide_invitation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = invitations.decide_invitations(fx.decision_requests(spark, sf_dir), _pending(spark, sf_dir))
    return flat_status(outcomes, *_DECISION_COLUMNS)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invitations.replay_decisions(fx.decision_requests(spark, sf_dir), _pending(spark, sf_dir))


@registered
def decide_invitation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_status(_decisions(spark, sf_dir), *_DECISION_COLUMNS)


@registered
def upsert_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = users.upsert_users(fx.update_user_requests(spark, sf_dir), fx.users(spark, sf_dir))
    return outcomes.select("request_id", "name", "route", "gate", F.col("status.code").alias("code"), "uid",
                           "display_name", "email", "aggregate_version", "etag")


@registered
def upsert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = users.replay_upserts(fx.update_user_requests(spark, sf_dir), fx.users(spark, sf_dir))
    return outcomes.select("request_id", "name", "route", "gate", F.col("status.code").alias("code"), "uid",
                           "display_name", "email", "aggregate_version", "etag")


@registered
def directory_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All request tables in one order: the outcome of every request."""
    got = directory.replay(fx.users(spark, sf_dir), _pending(spark, sf_dir), directory.Requests(
        creates=fx.newcomer_requests(spark, sf_dir), updates=fx.informed_update_requests(spark, sf_dir), removals=fx.remove_group_requests(spark, sf_dir),
        invites=fx.create_invitation_requests(spark, sf_dir), decisions=fx.near_decision_requests(spark, sf_dir), made=fx.known_and_made_groups(spark, sf_dir)))
    kinds = {"create": got.created, "update": got.updated, "remove": got.removed.withColumnRenamed("user_name", "name"), "invite": got.invited, "decide": got.decided}
    rows = [df.select(F.lit(kind).alias("pipeline"), F.col("request_id").cast("string").alias("request_id"), "gate", F.col("status.code").alias("code"),
                      "aggregate_version", "etag") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


# Folds.


def _user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.user_history(fx.user_events(spark, sf_dir))


@registered
def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_history(spark, sf_dir).select("name", "ts", "seq", "event_type", "epoch", "aggregate_version",
                                               "display_name", "etag")


@registered
def user_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.user_snapshot(_user_history(spark, sf_dir)).select("name", "display_name", "aggregate_version", "etag")


@registered
def changelog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table recovered from a written changelog."""
    changelog = pinned(_user_history(spark, sf_dir), "changelog")
    return tables.current_state(changelog).select("name", "display_name", "aggregate_version", "etag")


@registered
def user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.user_groups(fx.user_events(spark, sf_dir))


@registered
def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_spans(fx.user_events(spark, sf_dir))


@registered
def groups_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group lists that users had at the versions that requests name."""
    log = fx.near_user_events(spark, sf_dir)
    history = pinned(folds.user_history(log).select("name", *USER_EVENT_ORDER, "epoch", "aggregate_version"), "history")
    asked = fx.lookup_requests(spark, sf_dir).select("request_id", "name", (1 + F.col("request_id") % 12).cast("int").alias("aggregate_version"))
    places = lookup(asked, history.filter("epoch = 1"), ["name", "aggregate_version"], ["request_id"], "inner").drop("epoch")
    return folds.groups_at(folds.group_spans(log), places).select("request_id", "name", "aggregate_version", "position", "group_name")


@registered
def user_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that requests ask for as they were at the time of the request."""
    asked = fx.lookup_requests(spark, sf_dir).select("request_id", "name", "ts", F.lit(len(USER_EVENT_TYPES) + 1).alias("event_rank"), F.col("request_id").alias("seq"))
    history = folds.user_history(fx.near_user_events(spark, sf_dir))
    return folds.state_at(history, asked, ["display_name", "aggregate_version", "etag"]).select("request_id", "name", "display_name", "aggregate_version", "etag")


def _ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.created_invitations(spark, sf_dir).withColumn("ts", F.lit("1900-01-01").cast("timestamp_ntz"))


def _invitation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = pinned(invitations.decided_events(_decisions(spark, sf_dir)), "decided")
    # A decision follows its invitation whatever the dates in the test tables say.
    return folds.invitation_history(_ahead(spark, sf_dir).unionByName(decided))


_INVITATION_COLUMNS = ["name", "group_name", "state", "create_time", "update_time", "aggregate_version", "etag"]


@registered
def invitation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _invitation_history(spark, sf_dir).select("event_type", *_INVITATION_COLUMNS)


@registered
def membership_from_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that users are in because they accepted an invitation, end to end."""
    joined = invitations.membership_events(invitations.decided_events(_decisions(spark, sf_dir)))
    held = folds.user_groups(fx.member_births(spark, sf_dir).unionByName(joined))
    return held.groupBy("name", "group_name").agg(F.count("*").alias("times"))


@registered
def membership_from_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that users are in because they made them."""
    made = invitations.group_created_events(fx.created_groups(spark, sf_dir))
    return folds.user_groups(fx.member_births(spark, sf_dir).unionByName(made)).select("name", "position", "group_name")


@registered
def invitation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.invitation_snapshot(_invitation_history(spark, sf_dir)).select(*_INVITATION_COLUMNS)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.invitation_index(fx.created_invitations(spark, sf_dir))


@registered
def invitation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@registered
def uid_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.uid_names(users.created_events(_creates(spark, sf_dir)), ["ts", "seq"])


@registered
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.orphans(_user_history(spark, sf_dir)).select("name", "ts", "seq", "event_type")


@registered
def unnamed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invitations whose name has no parent part are kept apart."""
    return folds.unnamed_parents(fx.oddly_named_invitations(spark, sf_dir)).select("name", "group_name")


def laid_out_state(spark: SparkSession, sf_dir: str, buckets: int = 8) -> DataFrame:
    """Users with the number of their events, from event and history tables that are laid out by user."""
    log = layout.laid_out(fx.user_events(spark, sf_dir), "events", "name", USER_EVENT_ORDER, buckets)
    history = layout.laid_out(folds.user_history(log), "history", "name", USER_EVENT_ORDER, buckets)
    counts = log.groupBy("name").agg(F.count(F.lit(1)).alias("events"))
    return folds.user_snapshot(history).join(counts, "name").select("name", "display_name", "aggregate_version", "etag", "events")


@registered
def laid_out_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out_state(spark, sf_dir)


# Reads.


@registered
def malformed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a topic, those that parse and those that are kept apart."""
    records = fx.request_records(spark, sf_dir)
    good = tables.well_formed(records, CREATE_USER_REQUEST).select(F.lit("request").alias("kind"), F.col("request_id").cast("string").alias("key"), "uid", "ts")
    bad = tables.malformed(records, CREATE_USER_REQUEST).select(F.lit("malformed").alias("kind"), "key", F.lit(None).cast("string").alias("uid"), F.col("timestamp").cast("timestamp_ntz").alias("ts"))
    return good.unionByName(bad)


@registered
def get_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.get_users(fx.lookup_requests(spark, sf_dir), fx.users(spark, sf_dir))
    return rows.select("request_id", "name", "gate", F.col("status.code").alias("code"),
                       F.col("status.message").alias("message"), *lookups.USER_COLUMNS)


@registered
def find_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.users(spark, sf_dir)
    names = folds.uid_names(known, ["aggregate_version"])
    rows = lookups.find_users(fx.lookup_requests(spark, sf_dir), names, known)
    return rows.select("request_id", "asked_uid", "name", "gate", F.col("status.code").alias("code"),
                       F.col("status.message").alias("message"), *lookups.USER_COLUMNS)


@registered
def get_user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.user_events(spark, sf_dir)
    known = folds.user_snapshot(folds.user_history(log))
    return lookups.groups_of(fx.lookup_requests(spark, sf_dir), known, folds.user_groups(log), Probe(log)).select(
        "name", "position", "group_name")


@registered
def list_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the asked parents; only their invitations and the decisions on these are folded."""
    asked = pinned(fx.lookup_requests(spark, sf_dir), "asked")
    made = pinned(lookups.of_parents(fx.created_invitations(spark, sf_dir), asked), "made")
    pending = folds.invitation_snapshot(folds.invitation_history(made))
    decided = pinned(invitations.decided_events(invitations.replay_decisions(lookups.of_parents(fx.decision_requests(spark, sf_dir), asked), pending)), "decided")
    ahead = made.withColumn("ts", F.lit("1900-01-01").cast("timestamp_ntz"))
    state = folds.invitation_snapshot(folds.invitation_history(ahead.unionByName(decided)))
    return lookups.list_invitations(asked, folds.invitation_index(made), state)[1].select(
        "request_id", "parent", "position", "name", "group_name", "state", "aggregate_version", "etag")


@registered
def list_invitation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.lookup_requests(spark, sf_dir)
    made = pinned(lookups.of_parents(fx.created_invitations(spark, sf_dir), asked), "made")
    state = folds.invitation_snapshot(folds.invitation_history(made))
    rows = lookups.list_invitations(asked, folds.invitation_index(made), state)[0]
    return rows.select("request_id", "parent", "gate", F.col("status.code").alias("code"),
                       F.col("status.message").alias("message"), "total", "next_page_token")


# Sinks and streams.


@registered
def event_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds of events, each pipeline written once to its folders, and read back."""
    root = new_folder(spark, "events")
    tables.write_events(users.created_events(_creates(spark, sf_dir)), f"{root}/users", "create")
    tables.write_events(users.updated_events(_updates(spark, sf_dir)), f"{root}/users", "update")
    tables.write_events(users.removed_events(_removals(spark, sf_dir)), f"{root}/users", "remove")
    tables.write_events(invitations.created_invitation_events(_invites(spark, sf_dir)), f"{root}/invitations", "create")
    tables.write_events(invitations.decided_events(_decisions(spark, sf_dir)), f"{root}/invitations", "decide")
    shown = ["event_type", "name", "ts", "seq", "group_name", "display_name", "email", "state"]
    blank = F.lit("")
    log = tables.read_table(spark, f"{root}/users", USER_EVENT).withColumn("state", blank).select(*shown)
    return log.unionByName(tables.read_table(spark, f"{root}/invitations", INVITATION_EVENT)
                           .withColumns({"display_name": blank, "email": blank, "seq": F.coalesce("seq", F.lit(0).cast("bigint"))}).select(*shown))


@registered
def response_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of all six pipelines written and read back."""
    root = new_folder(spark, "statuses")
    decided = pinned(_decisions(spark, sf_dir), "decisions")
    outcomes = {"create_user": _creates(spark, sf_dir), "update_user": _updates(spark, sf_dir), "remove_group": _removals(spark, sf_dir),
                "create_invitation": _invites(spark, sf_dir), "accept_invitation": decided.filter("action = 'ACCEPTED'"),
                "reject_invitation": decided.filter("action = 'REJECTED'")}
    for name, rows in outcomes.items():
        tables.write_statuses(rows, f"{root}/pipeline={name}", "all")
    rows = spark.read.parquet(root)
    return rows.select("pipeline", "request_id", "gate", F.col("status.code").alias("code"), F.col("status.message").alias("message"),
                       F.coalesce(F.array_join("status.violations.field", ","), F.lit("")).alias("violation_fields"))


STRETCHES = 4


def _replayed(df: DataFrame, root: str, schema: StructType, work: Callable[[DataFrame, int], None],
              shape: Callable[[DataFrame], DataFrame] | None = None, stretches: int = STRETCHES) -> None:
    """Let rows arrive in a few stretches of time and process each stretch as it arrives, every time by a query that is started anew.

    ``shape`` is what Spark does to the stream where it keeps state itself."""
    spark, path = df.sparkSession, f"{root}/in"
    bounds = df.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if bounds.low is None:
        return
    width = (bounds.high - bounds.low) / stretches
    stretch_of = F.lit(stretches - 1)
    for stretch in reversed(range(stretches - 1)):
        stretch_of = F.when(F.col("ts") < bounds.low + (stretch + 1) * width, stretch).otherwise(stretch_of)
    # All rows are written at once, and the files of a stretch arrive when its turn comes.
    rows = df.filter(F.col("ts").isNotNull()).withColumn("stretch", stretch_of)
    rows.write.option("compression", "zstd").partitionBy("stretch").parquet(f"{root}/arriving")
    for stretch in range(stretches):
        move_files(spark, f"{root}/arriving/stretch={stretch}", path, f"{stretch}-")
        stream = tables.read_stream(spark, path, schema)
        if shape is None:
            jobs.run_to_end(stream, f"{root}/progress", work)
        else:
            stateful.run_to_end(shape(stream), f"{root}/progress", work)


@registered
def stream_user_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-users")
    rows = fx.user_events(spark, sf_dir)
    work, _, state = jobs.user_fold(spark, root)
    _replayed(rows, root, USER_EVENT, work)
    return state.current(["name"]).select("name", "display_name", "aggregate_version", "etag")


@registered
def stream_update_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-updates")
    work, outcomes, _ = jobs.update_requests(spark, root, lambda: fx.users(spark, sf_dir))
    _replayed(fx.update_user_requests(spark, sf_dir), root, UPDATE_USER_REQUEST, work)
    return outcomes.rows().select("request_id", "gate", "aggregate_version")


@registered
def stream_remove_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-removals")
    work, outcomes = jobs.remove_requests_of_log(spark, root, lambda: fx.user_events(spark, sf_dir))
    _replayed(fx.remove_group_requests(spark, sf_dir), root, REMOVE_GROUP_REQUEST, work)
    return outcomes.rows().select("request_id", "gate", F.col("status.code").alias("code"), "aggregate_version")


@registered
def stream_remove_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals in their place among the events, as both arrive."""
    root = new_folder(spark, "stream-ordered-removals")
    work, outcomes, _ = jobs.ordered_removals(spark, root)
    asked = fx.remove_group_requests(spark, sf_dir).select("ts", F.col("user_name").alias("name"), "group_name", F.col("request_id").alias("asked_id"),
                                                           F.lit(jobs.REMOVE_ASKED).alias("event_type"))
    _replayed(fx.near_user_events(spark, sf_dir).unionByName(asked, allowMissingColumns=True), root, jobs.MEMBER_LOG, work)
    return outcomes.rows().select("request_id", "gate", "groups_left", "aggregate_version", "etag")


def _laid_out_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending invitations, stored by name, so that no batch sends them."""
    return layout.laid_out(_pending(spark, sf_dir), "pending", "name", ["group_name"], int(spark.conf.get("spark.sql.shuffle.partitions")))


@registered
def stream_decide_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-decisions")
    pending = _laid_out_pending(spark, sf_dir)
    work, outcomes, _ = jobs.decision_requests(spark, root, lambda: pending)
    _replayed(fx.decision_requests(spark, sf_dir), root, DECIDE_INVITATION_REQUEST, work)
    return outcomes.rows().select("request_id", "gate", "state")


@registered
def stream_invitation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-invitations")
    work, _, state = jobs.invitation_fold(spark, root)
    decided = pinned(invitations.decided_events(_decisions(spark, sf_dir)), "decided")
    _replayed(_ahead(spark, sf_dir).unionByName(decided), root, INVITATION_EVENT, work)
    return state.current(["name"]).select(*_INVITATION_COLUMNS)


@registered
def stream_invitation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-index")
    work, index = jobs.invitation_index(spark, root)
    _replayed(fx.created_invitations(spark, sf_dir), root, INVITATION_EVENT, work)
    return index()


@registered
def stream_user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-groups")
    work, groups, _ = jobs.user_group_lists(spark, root)
    _replayed(fx.user_events(spark, sf_dir), root, USER_EVENT, work)
    return groups().select("name", "position", "group_name")


@registered
def stream_multi_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-invites")
    rows = fx.create_invitation_requests(spark, sf_dir)
    work, statuses, events = jobs.invitation_requests(
        spark, root, lambda: fx.users(spark, sf_dir), lambda: fx.groups(spark, sf_dir))
    _replayed(rows, root, CREATE_INVITATION_REQUEST, work)
    named = events.rows().select("request_id", F.col("name").alias("event_name"))
    return statuses.rows().join(named, "request_id", "left").select(
        "request_id", "gate", F.col("status.code").alias("code"), "event_name")


@registered
def stream_uid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-uids")
    rows = pinned(users.created_events(_creates(spark, sf_dir)), "created")
    work, table = jobs.uid_map(spark, root, ["ts", "seq"])
    _replayed(rows, root, USER_EVENT, work)
    return table.current(["uid"])


@registered
def stream_create_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "stream-creates")
    rows = fx.create_user_requests(spark, sf_dir)
    work, outcomes, _ = jobs.user_requests(spark, root)
    _replayed(rows, root, CREATE_USER_REQUEST, work)
    return outcomes.rows().select("request_id", "uid", "user_id", "gate")


@registered
def stream_uid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each uid was asked for, counted by a streaming aggregation."""
    root = new_folder(spark, "stream-counts")
    shape, work, table = stateful.counts(spark, root, "uid")
    _replayed(fx.create_user_requests(spark, sf_dir), root, CREATE_USER_REQUEST, work, shape)
    return table.current(["uid"])


@registered
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current users, folded by a keyed state processor."""
    root = new_folder(spark, "stream-state")
    shape, work, table = stateful.user_state(spark, root)
    _replayed(fx.user_events(spark, sf_dir), root, USER_EVENT, work, shape)
    return table.current(["name"]).select("name", "display_name", "aggregate_version", "etag")


@registered
def stream_event_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the create, update, remove and decide streams write beside their statuses: events, and releases of keys."""
    root = new_folder(spark, "stream-events")
    pending = _laid_out_pending(spark, sf_dir)
    streams = {
        "create": (fx.create_user_requests(spark, sf_dir), CREATE_USER_REQUEST, lambda at: jobs.user_requests(spark, at)),
        "update": (fx.update_user_requests(spark, sf_dir), UPDATE_USER_REQUEST, lambda at: jobs.update_requests(spark, at, lambda: fx.users(spark, sf_dir))),
        "remove": (fx.remove_group_requests(spark, sf_dir), REMOVE_GROUP_REQUEST, lambda at: jobs.remove_requests_of_log(spark, at, lambda: fx.user_events(spark, sf_dir))),
        "decide": (fx.decision_requests(spark, sf_dir), DECIDE_INVITATION_REQUEST, lambda at: jobs.decision_requests(spark, at, lambda: pending))}
    parts = []
    for pipeline, (requests, schema, job) in streams.items():
        at = f"{root}/{pipeline}"
        _replayed(requests, at, schema, job(at)[0], stretches=2)
        events = jobs.event_sink(spark, at, pipeline).rows()
        parts.append(events.select("event_type", "name", "ts", *[F.col(c) if c in events.columns else F.lit("").alias(c) for c in ("group_name", "display_name", "email", "state")]))
    freed = jobs.release_sink(spark, f"{root}/create").rows()
    blank = [F.lit("").alias(c) for c in ("group_name", "display_name", "email", "state")]
    parts.append(freed.select(F.concat(F.lit("Released "), "kind").alias("event_type"), F.col("key").alias("name"), "ts", *blank))
    return reduce(DataFrame.unionByName, parts)
