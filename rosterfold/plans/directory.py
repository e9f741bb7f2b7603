"""Whole histories of requests: every request sees what all earlier ones of any kind have done.

Nothing here walks through one user's requests. What depends on what is cut so that each part is one of the ordered
operators: creations depend on no later state; groups and invitations exist from a moment on; decisions depend on invitations
alone; a removal depends on the list events before it and on no other removal's outcome; an update depends on how many events
moved its user before it and on the updates before it. Only updates that append groups can matter to removals, which
matter to updates: where there are such updates, both are computed again until the appended groups stay the same. Each time
all requests of a user are right up to the first one that was not, so this ends, and with the only order there is. Users do not
depend on one another there, so only those are computed again whose appended groups changed ahead of one of their removals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions import masks, messages as text, status as st
from rosterfold.functions.etags import INVITATION_SECRET, USER_SECRET, user_etag
from rosterfold.functions.names import user_id_of
from rosterfold.operators import folds
from rosterfold.operators.gates import judged, when_passed
from rosterfold.operators.membership import removals_in_order
from rosterfold.operators.skew import Probe, lookup
from rosterfold.operators.workspace import pinned
from rosterfold.plans import invitations as inv, removals as rem, users as usr
from rosterfold.schemas import USER, USER_EVENT, USER_EVENT_ORDER, conform

_PROFILE = ["uid", "display_name", "email"]


def _prior_groups(users: DataFrame) -> DataFrame:
    return users.select("name", F.posexplode("groups").alias("ordinal", "group_name"))


def _removal_effects(requests: DataFrame, events: DataFrame, prior: DataFrame, groups: DataFrame) -> DataFrame:
    """The requests with ``_at``, whether their user exists, and what they find: ``equal`` elements, and ``left`` after them.

    ``groups`` are the elements that the lists of ``prior`` users have before all events."""
    probe = Probe(events)
    added, resets, removed = folds.membership_changes(events, probe, prior)
    added = added.select("name", "group_name", "_at", "ordinal").unionByName(groups.select("name", "group_name", folds.before_all().alias("_at"), "ordinal"))
    asked = requests.withColumnRenamed("user_name", "name").withColumn("_at", usr.place_of(folds.GROUP_REMOVED))
    asked = lookup(asked, folds.births(events, prior), ["name"], ["request_id"], probe=Probe(requests.withColumnRenamed("user_name", "name")))
    asked = pinned(asked.withColumn("_exists", F.coalesce(F.col("_born") <= F.col("_at"), F.lit(False))).drop("_born"), "removals")
    marks = removed.select("name", "group_name", "_at", F.lit(None).cast(asked.schema["request_id"].dataType).alias("request_id"))
    marks = marks.unionByName(asked.filter("_exists").select("name", "group_name", "_at", "request_id"))
    found = removals_in_order(added, resets, marks, probe).filter("request_id is not null")
    return asked.join(found.select("request_id", "equal", "left"), "request_id", "left")


def _removal_events(effects: DataFrame) -> DataFrame:
    rows = effects.filter("_exists and equal > 0").select("name", "group_name", "ts", F.col("request_id").alias("seq"),
                                                          F.lit(folds.GROUP_REMOVED).alias("event_type"))
    return conform(rows, USER_EVENT, keep_null=("groups",))


def _removal_outcomes(effects: DataFrame, history: DataFrame) -> DataFrame:
    """Statuses of removals, with the state that the passed ones have in the history."""
    after = history.filter(F.col("event_type") == folds.GROUP_REMOVED).select(
        "name", F.struct(*USER_EVENT_ORDER).alias("_at"), F.struct("aggregate_version", "etag", *_PROFILE).alias("now"))
    # Two removals of one user are told apart by their places, so no key is heavy.
    rows = effects.join(after, ["name", "_at"], "left").withColumnRenamed("name", "user_name")
    return judged(rows, rem.removal_gates(F.col("_exists"), F.col("equal")), st.ok(text.GROUP_REMOVED)).select(
        *usr.ORDER, "user_name", "group_name", "gate", "status", *[when_passed(F.col(f"now.{c}")).alias(c) for c in _PROFILE],
        when_passed(F.col("left")).alias("groups_left"), when_passed(F.col("now.aggregate_version")).alias("aggregate_version"),
        when_passed(F.col("now.etag")).alias("etag"))


def replay_removals(requests: DataFrame, events: DataFrame, prior: DataFrame | None = None, secret: str = USER_SECRET) -> DataFrame:
    """Outcome of remove-group requests in order, each seeing the events before it and the removals before it.

    ``events`` are user events that do not depend on these requests; ``prior`` are users that were there before all of them, with
    their groups. The reply is the user right after the removal, as in ``users.remove_groups``.
    """
    prior = _no_users(events) if prior is None else conform(prior, USER)
    counts = _prior_groups(prior).groupBy("name", "group_name").agg(F.count(F.lit(1)).alias("n"))
    names = events.select("name").unionByName(requests.select(F.col("user_name").alias("name"))).unionByName(counts.select("name"))
    return rem.outcomes(rem.walked(rem.steps_of(events, requests), prior, counts, names), secret)


def _no_users(events: DataFrame) -> DataFrame:
    return conform(events.select("name").limit(0), USER)


# All kinds together.


@dataclass(frozen=True)
class Requests:
    """The request tables; ``made`` are groups that another service made: name, owner, ts, seq."""

    creates: DataFrame
    updates: DataFrame
    removals: DataFrame
    invites: DataFrame
    decisions: DataFrame
    made: DataFrame


@dataclass(frozen=True)
class Replayed:
    """Outcomes of every request table, the log of user events that they led to, and its history."""

    created: DataFrame
    updated: DataFrame
    removed: DataFrame
    invited: DataFrame
    decided: DataFrame
    events: DataFrame
    history: DataFrame


def _since(known: DataFrame, key: str, since: Column) -> DataFrame:
    return known.groupBy("name").agg(F.min(since).alias("_since")).withColumnRenamed("name", key)


def _there(rows: DataFrame, known: DataFrame, key: str, flag: str, probe: Probe) -> DataFrame:
    """Add whether ``key`` exists at the time of each request; what begins at that very time does."""
    found = lookup(rows, known, [key], ["request_id"], probe=probe)
    return found.withColumn(flag, F.coalesce(F.col("_since") <= F.col("ts"), F.lit(False))).drop("_since")


def _some(rows: DataFrame, names: DataFrame, spread: list[str], how: str = "left_semi", key: str = "name") -> DataFrame:
    """The rows of some users, or of all others."""
    return lookup(rows, names.withColumnRenamed("name", key), [key], spread, how).select(*rows.columns)


@dataclass(frozen=True)
class _Part:
    """Users whose removals and updates are computed together, and all that concerns them."""

    start: DataFrame
    everyone: DataFrame
    born: DataFrame
    outside: DataFrame
    removals: DataFrame
    updates: DataFrame

    def of(self, names: DataFrame) -> _Part:
        users = [pinned(df.join(names, "name", "left_semi").select(*df.columns), "some-users") for df in (self.start, self.everyone, self.born)]
        return _Part(*users, pinned(_some(self.outside, names, USER_EVENT_ORDER), "some-events"),
                     pinned(_some(self.removals, names, ["request_id"], key="user_name"), "some-removals"),
                     pinned(_some(self.updates, names, ["request_id"]), "some-updates"))


def _unsettled(now: DataFrame, before: DataFrame | None, removals: DataFrame) -> DataFrame:
    """Names of users whose appended groups are not those ``before`` at a time when a removal of theirs is still to come."""
    key = ["name", "ts", "seq"]
    changed = now.select(*key)
    if before is not None:
        changed = changed.join(before, key, "left_anti").unionByName(before.select(*key).join(now, key, "left_anti"))
    last = removals.groupBy(F.col("user_name").alias("name")).agg(F.max("ts").alias("_last"))
    return changed.groupBy("name").agg(F.min("ts").alias("_first")).join(last, "name").filter("_last >= _first").select("name")


def replay(start: DataFrame, pending: DataFrame, requests: Requests, secret: str = USER_SECRET,
           invitation_secret: str = INVITATION_SECRET, domain: str = st.DOMAIN) -> Replayed:
    """Let all requests take their turn, by time, then kind of event, then id.

    ``start`` are the users and ``pending`` the invitations that are there before all requests; groups are there when ``made`` has
    them, or before all requests when its ``ts`` is null.
    """
    start = conform(start, USER)
    held = start.select("uid", user_id_of(F.col("name")).alias("user_id"))
    created = pinned(usr.create_users(requests.creates, held, secret, domain), "created")
    born = pinned(usr.created_events(created), "born")
    everyone = pinned(start.unionByName(conform(born.withColumn("aggregate_version", F.lit(1)), USER)
                                        .withColumn("etag", user_etag(F.col("name"), F.lit(1), secret))), "everyone")

    always = F.lit("0001-01-01").cast("timestamp_ntz")
    people = born.select("name", F.col("ts").alias("_ts")).unionByName(start.select("name", always.alias("_ts")))
    groups = requests.made.select("name", F.coalesce("ts", always).alias("_ts"))
    probe = Probe(requests.invites)
    asked = _there(requests.invites, _since(groups, "group_name", F.col("_ts")), "group_name", "_group", probe)
    asked = _there(asked, _since(people, "parent", F.col("_ts")), "parent", "_parent", probe)
    invited = pinned(inv.invited(asked, invitation_secret), "invited")

    offered = pending.withColumn("since", F.lit(None).cast("timestamp_ntz")).select(*inv.STORED, "since").unionByName(
        invited.filter("gate is null").select(*inv.STORED, F.col("ts").alias("since")))
    decided = pinned(inv.replay_decisions(requests.decisions, offered, invitation_secret, domain), "decided")

    outside = inv.group_created_events(requests.made.filter("ts is not null")).unionByName(inv.membership_events(inv.decided_events(decided)))
    outside = pinned(outside.unionByName(born), "outside")
    appending = requests.updates.filter(masks.covers(masks.writable(F.col("mask")), "groups") & (F.size("groups") > 0))
    settled, grown, rounds = appending.isEmpty(), None, []
    part = _Part(start, everyone, born, outside, requests.removals, requests.updates)
    while True:
        log = part.outside if grown is None else part.outside.unionByName(grown)
        effects = pinned(_removal_effects(part.removals, log, part.start, _prior_groups(part.start)), "removal-effects")
        moved = log.filter(F.col("event_type") != folds.USER_CREATED).filter(F.col("event_type") != folds.USER_UPDATED).unionByName(_removal_events(effects))
        moved = lookup(moved, folds.births(part.outside, part.start), ["name"], USER_EVENT_ORDER, "inner", Probe(part.outside))
        moved = pinned(moved.filter(F.struct(*USER_EVENT_ORDER) > F.col("_born")).select("name", *USER_EVENT_ORDER), "moved")
        updated = pinned(usr.replay_updates(part.updates, part.everyone, secret, domain, bumps=moved, births=part.born), "updated")
        if not settled:
            now = pinned(usr.updated_events(updated).filter(F.size("added_groups") > 0), "grown")
            again = pinned(_unsettled(now, grown, part.removals), "unsettled")
            settled = again.isEmpty()
        if settled:
            rounds.append((effects, updated))
            break
        # What is computed again is a part of what was computed last, so each user has the rows of its last time.
        rounds.append(tuple(_some(rows, again, ["request_id"], "left_anti") for rows in (effects, updated)))
        part, grown = part.of(again), pinned(_some(now, again, USER_EVENT_ORDER), "grown")
    effects, updated = (reduce(DataFrame.unionByName, rows) for rows in zip(*rounds))
    gone = _removal_events(effects)

    events = pinned(outside.unionByName(usr.updated_events(updated)).unionByName(gone), "events")
    history = folds.user_history(events, start, secret)
    return Replayed(created, updated, _removal_outcomes(effects, history), invited, decided, events, history)
