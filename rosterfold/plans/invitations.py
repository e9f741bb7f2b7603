"""Requests on invitations: create, accept, reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions import messages as text, status as st
from rosterfold.functions.etags import INVITATION_SECRET, invitation_etag
from rosterfold.functions.names import invitation_name, invitation_parent
from rosterfold.operators.folds import GROUP_CREATED, INVITATION_ACCEPTED, INVITATION_CREATED, INVITATION_REJECTED
from rosterfold.operators.gates import Gate, judged, passed, when_passed
from rosterfold.operators.ordered import with_minimum
from rosterfold.operators.skew import Probe, exists_in, lookup
from rosterfold.schemas import INVITATION_EVENT, USER_EVENT, conform

# Invitation states.
PENDING, ACCEPTED, REJECTED = "PENDING", "ACCEPTED", "REJECTED"

DECISION_ORDER = ["ts", "request_id"]
STORED = ["name", "group_name", "state", "create_time", "aggregate_version", "etag"]


def _unknown(field: str, name: Column) -> Column:
    return st.bad_request(F.array(st.violation(field, F.format_string(text.NOT_THERE, name))))


def _moment() -> Column:
    """The request's own time at millisecond precision, so that a rerun gives the same value."""
    return F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz")


def create_invitations(requests: DataFrame, users: DataFrame, groups: DataFrame,
                       secret: str = INVITATION_SECRET) -> DataFrame:
    """Outcome of create requests: the group must exist, then the parent user.

    The etag belongs to the generated name, so it equals the one the stored invitation gets.
    """
    rows = exists_in(requests, groups.select(F.col("name").alias("group_name")), ["group_name"], ["request_id"], "_group")
    return invited(exists_in(rows, users.select(F.col("name").alias("parent")), ["parent"], ["request_id"], "_parent", Probe(requests)), secret)


def invited(rows: DataFrame, secret: str = INVITATION_SECRET) -> DataFrame:
    """Outcome of create requests that say whether their group (``_group``) and their parent (``_parent``) exist."""
    gates = [Gate("group", ~F.col("_group"), _unknown("group", F.col("group_name"))),
             Gate("parent", ~F.col("_parent"), _unknown("parent", F.col("parent")))]
    name = invitation_name(F.col("parent"), F.col("request_id"))
    return judged(rows, gates, st.ok(text.INVITATION_CREATED)).select(
        "request_id", "ts", "parent", "group_name", "gate", "status",
        when_passed(name).alias("name"),
        when_passed(F.lit(PENDING)).alias("state"),
        when_passed(_moment()).alias("create_time"),
        when_passed(F.lit(1)).alias("aggregate_version"),
        when_passed(invitation_etag(name, F.lit(1), secret)).alias("etag"))


def created_invitation_events(outcomes: DataFrame) -> DataFrame:
    rows = passed(outcomes).withColumns({"seq": F.col("request_id"), "event_type": F.lit(INVITATION_CREATED)})
    return conform(rows, INVITATION_EVENT)


def _with_stored(requests: DataFrame, invitations: DataFrame, probe: Probe, changed: DataFrame | None = None) -> DataFrame:
    since = ["since"] if "since" in invitations.columns else []
    stored = invitations.select("name", F.struct(*STORED[1:]).alias("cur"), *since)
    rows = lookup(requests.withColumnRenamed("etag", "request_etag"), stored, ["name"], DECISION_ORDER, probe=probe)
    if changed is not None:
        later = changed.select("name", F.struct(*STORED[1:]).alias("_later"))
        rows = lookup(rows, later, ["name"], DECISION_ORDER, probe=probe).withColumn("cur", F.coalesce("_later", "cur")).drop("_later")
    if since:  # an invitation that is made on the way is not there before
        rows = rows.withColumn("cur", F.when(F.col("since").isNull() | (F.col("since") <= F.col("ts")), F.col("cur"))).drop("since")
    return rows


def _decided(rows: DataFrame, etag_now: Column, state_now: Column, secret: str, domain: str) -> DataFrame:
    gates = [
        Gate("invitation", F.col("cur").isNull(), _unknown("group", F.col("name"))),
        Gate("etag", F.col("request_etag") != etag_now, st.stale_etag(F.col("request_etag"), domain)),
        Gate("state", state_now != PENDING, st.failed_precondition(
            "NOT_PENDING", f"{domain}/GroupInvitation", text.NOT_PENDING))]
    success = st.ok(F.when(F.col("action") == ACCEPTED, text.INVITATION_ACCEPTED).otherwise(text.INVITATION_REJECTED))
    version = F.col("cur.aggregate_version") + 1
    return judged(rows, gates, success).select(
        *DECISION_ORDER, "name", "action", "gate", "status",
        when_passed(F.col("cur.group_name")).alias("group_name"),
        when_passed(F.col("action")).alias("state"),
        when_passed(F.col("cur.create_time")).alias("create_time"),
        when_passed(_moment()).alias("update_time"),
        when_passed(version).alias("aggregate_version"),
        when_passed(invitation_etag(F.col("name"), version, secret)).alias("etag"))


def decide_invitations(requests: DataFrame, invitations: DataFrame, secret: str = INVITATION_SECRET,
                       domain: str = st.DOMAIN) -> DataFrame:
    """Outcome of accept and reject requests that all see the same stored invitations.

    Where the invitations have a time ``since``, requests before it do not find them.
    """
    rows = _with_stored(requests, invitations, Probe(requests))
    return _decided(rows, F.col("cur.etag"), F.col("cur.state"), secret, domain)


def replay_decisions(requests: DataFrame, invitations: DataFrame, secret: str = INVITATION_SECRET,
                     domain: str = st.DOMAIN, changed: DataFrame | None = None) -> DataFrame:
    """Outcome of accept and reject requests in order.

    A pending invitation is decided by the first request that carries its etag; that is a minimum
    per invitation. Later requests meet the next version, which is no longer pending. ``changed`` has
    the invitations that are not as in ``invitations`` any more.
    """
    place, probe = F.struct(*DECISION_ORDER), Probe(requests)
    rows = _with_stored(requests, invitations, probe, changed)
    deciding = (F.col("request_etag") == F.col("cur.etag")) & (F.col("cur.state") == PENDING)
    rows = with_minimum(rows, ["name"], F.when(deciding, place), "_won", DECISION_ORDER, probe)
    late = F.coalesce(place > F.col("_won"), F.lit(False))
    etag_now = F.when(late, invitation_etag(F.col("name"), F.col("cur.aggregate_version") + 1, secret)).otherwise(
        F.col("cur.etag"))
    state_now = F.when(late, "DECIDED").otherwise(F.col("cur.state"))
    return _decided(rows, etag_now, state_now, secret, domain)


def decided_events(outcomes: DataFrame) -> DataFrame:
    rows = passed(outcomes).withColumns({
        "seq": F.lit(0),
        "event_type": F.when(F.col("action") == ACCEPTED, INVITATION_ACCEPTED).otherwise(INVITATION_REJECTED)})
    return conform(rows, INVITATION_EVENT)


def membership_events(accepted: DataFrame) -> DataFrame:
    """An accepted invitation as an event of the invited user, who joins the group.

    Invitations that a user accepts at one time join in the order of a hash of their names, which are unique.
    """
    rows = (accepted.filter(F.col("event_type") == INVITATION_ACCEPTED)
            .select("ts", F.xxhash64("name").alias("seq"), invitation_parent("name").alias("name"), "event_type", "group_name"))
    return conform(rows.filter("name <> ''"), USER_EVENT, keep_null=("groups",))


def group_created_events(groups: DataFrame) -> DataFrame:
    """A created group (name, owner, ts, seq) as an event of its owner, who is its first member."""
    rows = groups.filter("owner <> ''").select(
        "ts", "seq", F.col("owner").alias("name"), F.lit(GROUP_CREATED).alias("event_type"), F.col("name").alias("group_name"))
    return conform(rows, USER_EVENT, keep_null=("groups",))
