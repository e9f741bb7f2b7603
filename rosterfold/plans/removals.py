"""Removals in their place among user events, in one reading of each user's rows.

Events, requests and what is there before them become steps in one order. Three stacked readings give all that is asked for: how often
the list was replaced before a step, how many elements of a group are held since then and since its last removal, and version, list
size and profile. All of them are per user or finer, so ordinary users are sent once and sorted three times; users with too many steps
are read in chunks (``operators.ordered``). What goes on from here is the user and the number of equal elements of each group, so lists
of any length cost a row for each of their groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions import messages as text, status as st
from rosterfold.functions.etags import USER_SECRET, user_etag
from rosterfold.operators.folds import (GROUP_CREATED, GROUP_REMOVED, INVITATION_ACCEPTED, USER_CREATED, USER_PAYLOAD, before_all,
                                        is_snapshot, latest)
from rosterfold.operators.gates import Gate, judged, when_passed
from rosterfold.operators.ordered import OrderedRows
from rosterfold.operators.skew import Probe
from rosterfold.operators.workspace import pinned
from rosterfold.schemas import USER_EVENT, USER_EVENT_ORDER, conform
from rosterfold.plans.users import ORDER, place_of

_USER, _ORDER = ["_key", "name"], [*USER_EVENT_ORDER, "ordinal"]
_PROFILE = "struct<uid: string, display_name: string, email: string>"


def _step(group_name: Column | str, ordinal: Column, **known: Column) -> list[Column]:
    """Columns of a step; what is not named says nothing.

    ``n``: elements it adds; ``removes``, ``resets``: what it takes from the list; ``starts``: the version a user begins with;
    ``moves``: versions it adds; ``profile``: the new one; ``request_id``: of a request.
    """
    rest = {"n": F.lit(0).cast("bigint"), "removes": F.lit(False), "resets": F.lit(False), "starts": F.lit(None).cast("int"), "moves": F.lit(0),
            "profile": F.lit(None).cast(_PROFILE), "request_id": F.lit(None).cast("bigint")} | known
    return [F.col("name"), *[F.col(c) for c in USER_EVENT_ORDER], ordinal.cast("int").alias("ordinal"),
            (F.col(group_name) if isinstance(group_name, str) else group_name).alias("group_name"), *[value.alias(c) for c, value in rest.items()]]


def steps_of(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Steps of user events and of remove-group requests."""
    events = conform(events, USER_EVENT, keep_null=("groups", "display_name"))
    created, listing = F.col("event_type") == USER_CREATED, is_snapshot()
    joins = F.col("event_type").isin(GROUP_CREATED, INVITATION_ACCEPTED)
    # An event is one step, and one more for each element it brings with a profile.
    brought = F.concat(F.array(F.lit("")), F.coalesce("groups", F.array().cast("array<string>")), F.coalesce("added_groups", F.array().cast("array<string>")))
    rows = events.select("*", F.posexplode(F.when(listing, brought).otherwise(F.array("group_name"))).alias("ordinal", "_group"))
    first = F.col("ordinal") == 0
    done = rows.select(*_step(
        "_group", F.col("ordinal"),
        n=F.when(joins | ~first, 1).otherwise(0).cast("bigint"), removes=F.col("event_type") == GROUP_REMOVED,
        resets=first & (created | (listing & F.col("groups").isNotNull())), starts=F.when(first & created, 1), moves=F.when(first, 1).otherwise(0),
        profile=F.when(first & listing, F.struct(*USER_PAYLOAD)).cast(_PROFILE)))
    place = place_of(GROUP_REMOVED)
    asked = requests.select(F.col("user_name").alias("name"), "group_name", "request_id", *[place[c].alias(c) for c in USER_EVENT_ORDER])
    # At one place a removal that happened comes before one that is asked for.
    return done.unionByName(asked.select(*_step("group_name", F.lit(1), removes=F.lit(True), request_id=F.col("request_id").cast("bigint"))))


def _prior_steps(users: DataFrame, counts: DataFrame) -> DataFrame:
    """Steps of users that are there before all events, and of the elements they hold: (name, group_name, n)."""
    start = [before_all()[c].alias(c) for c in USER_EVENT_ORDER]
    users = users.select("name", "aggregate_version", *USER_PAYLOAD, *start).select(*_step(
        F.lit(""), F.lit(0), starts=F.col("aggregate_version").cast("int"), profile=F.struct(*USER_PAYLOAD).cast(_PROFILE)))
    return users.unionByName(counts.select("name", "group_name", "n", *start).select(*_step("group_name", F.lit(1), n=F.col("n").cast("bigint"))))


def keyed(df: DataFrame) -> DataFrame:
    """Add a number made of the name. Names begin alike, so a sort tells them apart by the number first."""
    return df.withColumn(_USER[0], F.xxhash64("name"))


def walked(steps: DataFrame, users: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """The steps that matter later, with the state after them: requests, the last move of each user, and the last step of each group
    whose number of elements may have changed (``count``). ``names`` has a row for each step, and is cheaper to look at."""
    rows, probe = keyed(steps.unionByName(_prior_steps(users, counts))), Probe(keyed(names))
    spread = probe.heavy(_USER) is not None
    rows = OrderedRows.of(rows, _USER, _ORDER, probe=probe).running(
        sums={"_epoch": F.when(F.col("resets"), 1).otherwise(0), "_alive": F.when(F.col("starts").isNotNull(), 1).otherwise(0)},
        totals={"_end": F.when(F.col("resets"), 1).otherwise(0)}).rows()
    rows = rows.withColumns({"alive": F.col("_alive") > 0, "n": F.when(F.col("_alive") > 0, F.col("n")).otherwise(F.lit(0).cast("bigint"))})

    # Where no user has too many steps, no group of a user has.
    group = [*_USER, "_epoch", "group_name"]
    if spread:
        rows = pinned(rows, "epochs")
    stretches = OrderedRows.of(rows, group, _ORDER, probe=Probe(rows)) if spread else OrderedRows(rows, group, _ORDER)
    rows = (stretches.running(sums={"_all": F.col("n"), "_nth": F.lit(1)}, totals={"_steps": F.lit(1)})
            .running(earlier={"_gone": F.when(F.col("removes"), F.col("_all"))}).rows())
    held = F.col("_all") - F.coalesce("_gone", F.lit(0).cast("bigint"))
    none, now, prior = F.lit(0).cast("bigint"), F.col("_epoch") == F.col("_end"), F.col("event_rank") == 0
    rows = rows.withColumn("equal", F.when(F.col("removes"), held))
    # A group that was held before and whose list was replaced since may come twice, then with the larger number.
    rows = rows.withColumn("count", F.when(F.col("alive") & now & ~prior & (F.col("_nth") == F.col("_steps")) & (F.col("_all") > 0),
                                           F.when(F.col("removes"), none).otherwise(held))
                           .when(prior & ~now & (F.col("n") > 0), none))
    hit = F.col("request_id").isNotNull() & F.col("alive") & (F.col("equal") > 0)
    rows = rows.withColumn("moves", F.when(hit, 1).otherwise(F.col("moves")))

    scan = (OrderedRows.of(rows, _USER, _ORDER, probe=probe)
            .running(sums={"_sum": F.when(F.col("removes"), -F.col("equal")).otherwise(F.col("n")), "_moved": F.col("moves")}, totals={"_moves": F.col("moves")})
            .running(lasts={"_before": F.when(F.col("resets"), F.col("_sum")), "_profile": F.col("profile"),
                            "_start": F.when(F.col("starts").isNotNull(), F.struct("starts", "_moved"))}))
    version = F.col("_start.starts") + F.col("_moved") - F.col("_start._moved")
    last = F.col("alive") & (F.col("moves") > 0) & (F.col("_moved") == F.col("_moves"))
    done = scan.rows().select(
        "name", *USER_EVENT_ORDER, "group_name", "request_id", "alive", "equal", "count", last.alias("last"), F.col("_profile").alias("profile"),
        version.cast("int").alias("aggregate_version"), (F.col("_sum") - F.coalesce("_before", none)).alias("left"))
    return done.filter("request_id is not null or count is not null or last")


def removal_gates(exists: Column, equal: Column) -> list[Gate]:
    return [Gate("user", ~exists, st.not_found(F.format_string(text.NO_USER, "user_name"))),
            Gate("group", F.coalesce(equal == 0, F.lit(True)), st.not_found(F.format_string(text.NO_GROUP, "group_name")))]


def outcomes(done: DataFrame, secret: str = USER_SECRET) -> DataFrame:
    """Statuses of the requests, with the user right after each that passed."""
    rows = judged(done.filter("request_id is not null").withColumnRenamed("name", "user_name"),
                  removal_gates(F.col("alive"), F.col("equal")), st.ok(text.GROUP_REMOVED))
    return rows.select(
        *ORDER, "user_name", "group_name", "gate", "status", *[when_passed(F.col(f"profile.{c}")).alias(c) for c in USER_PAYLOAD],
        when_passed(F.col("left")).alias("groups_left"), when_passed(F.col("aggregate_version")).alias("aggregate_version"),
        when_passed(user_etag(F.col("user_name"), F.col("aggregate_version"), secret)).alias("etag"))


def users_after(done: DataFrame, secret: str = USER_SECRET) -> DataFrame:
    """The users that events or requests moved."""
    return done.filter("last").select("name", "profile.*", "aggregate_version",
                                      user_etag(F.col("name"), F.col("aggregate_version"), secret).alias("etag"))


def counts_after(done: DataFrame) -> DataFrame:
    """How many elements users hold of each group whose number may have changed, none included: (name, group_name, n)."""
    return done.filter("count is not null").select("name", "group_name", F.col("count").alias("n"))


def counts_now(stored: DataFrame) -> DataFrame:
    """The numbers that were written last, ``as_of`` a batch; see ``walked`` for two of one batch."""
    return latest(stored, ["name", "group_name"], ["as_of", "n"]).filter("n > 0").select("name", "group_name", "n", "as_of")
