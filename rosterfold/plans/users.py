"""Requests that change a user: create, update, upsert, remove a group.

Each function takes requests and state as frames and returns the requests with ``gate``, ``status``
and, where the request passed, the resulting values. Events are a projection of the passed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions import masks, messages as text, rules, status as st
from rosterfold.functions.etags import USER_SECRET, user_etag
from rosterfold.functions.names import is_user_name, user_id_of, user_name
from rosterfold.functions.text import strip_blank
from rosterfold.operators.allocate import allocated
from rosterfold.operators.chain import effective
from rosterfold.operators.folds import GROUP_REMOVED, USER_CREATED, USER_UPDATED
from rosterfold.operators.gates import Gate, judged, passed, when_passed
from rosterfold.operators.ordered import OrderedRows, numbered
from rosterfold.operators.skew import Probe, exists_in, lookup
from rosterfold.operators.workspace import pinned
from rosterfold.schemas import USER, USER_EVENT, USER_EVENT_ORDER, USER_EVENT_TYPES, conform

ORDER = ["ts", "request_id"]


def _missing_user(name: Column) -> Column:
    return st.not_found(F.format_string(text.NO_USER, name))


# Create


def _checked(requests: DataFrame) -> DataFrame:
    """Trimmed fields and the violations of both rule sets."""
    trimmed = requests.withColumns({"display_name": strip_blank(F.col("display_name")),
                                    "email": strip_blank(F.col("email"))})
    return trimmed.withColumns({
        "_id_errors": rules.user_id_violations(F.col("user_id")),
        "_errors": rules.profile_violations(F.col("display_name"), F.col("email"), F.col("uid"))})


def _granted(requests: DataFrame, held: DataFrame | None) -> DataFrame:
    rows = _checked(requests)
    valid = rows.filter(~rules.broken(F.col("_id_errors")) & ~rules.broken(F.col("_errors")))
    return allocated(valid.select("uid", "user_id", *ORDER), "uid", "user_id", ORDER, held)


def create_users(requests: DataFrame, held: DataFrame | None = None, secret: str = USER_SECRET,
                 domain: str = st.DOMAIN, granted: DataFrame | None = None) -> DataFrame:
    """Outcome of every create request.

    The uid and the user id each go to the first request that passes everything. ``held`` lists the
    (uid, user_id) pairs of users that exist already, ``granted`` what is allocated where that is known.
    """
    rows = _checked(requests)
    if granted is None:
        granted = _granted(requests, held)
    place, probe = F.struct(*ORDER), Probe(requests)
    taken = {"uid": F.lit(False), "user_id": F.lit(False)}
    for key in taken:
        rows = lookup(rows, granted.select(key, place.alias(f"_{key}_from")), [key], ["request_id"], probe=probe)
        taken[key] = F.coalesce(F.col(f"_{key}_from") < place, F.lit(False))
        if held is not None:
            asked = held.select(key).join(requests.select(key), key, "left_semi").distinct()
            rows = exists_in(rows, asked, [key], ["request_id"], f"_{key}_held", probe)
            taken[key] = taken[key] | F.col(f"_{key}_held")
    gates = [
        Gate("uid", taken["uid"], st.error_info(
            st.ALREADY_EXISTS, text.UID_EXISTS, F.format_string(text.UID_EXISTS_REASON, "uid"), "uid", F.col("uid"),
            domain)),
        Gate("user_id_format", rules.broken(F.col("_id_errors")), st.bad_request(F.col("_id_errors"))),
        Gate("user_id", taken["user_id"], st.error_info(
            st.ALREADY_EXISTS, text.USER_ID_TAKEN, F.format_string(text.USER_ID_TAKEN_REASON, "user_id"), "userId",
            F.col("user_id"), domain)),
        Gate("fields", rules.broken(F.col("_errors")), st.bad_request(F.col("_errors")))]
    outcome = judged(rows, gates, st.ok(text.USER_CREATED))
    name = user_name(F.col("user_id"))
    return outcome.select(
        *requests.columns, "gate", "status",
        when_passed(name).alias("name"),
        when_passed(F.lit(1)).alias("aggregate_version"),
        when_passed(user_etag(name, F.lit(1), secret)).alias("etag"))


def created_events(outcomes: DataFrame) -> DataFrame:
    rows = passed(outcomes).withColumns({"seq": F.col("request_id"), "event_type": F.lit(USER_CREATED)})
    return conform(rows, USER_EVENT)


def releases(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that a refused create request gives back: (uid, ...) and (user_id, ...) with value 0.

    A uid is freed by any refusal after the uid gate, a user id by a refusal of the fields.
    """
    after_uid = F.col("gate").isin("user_id_format", "user_id", "fields")
    zero = F.lit(0).cast("long").alias("value")
    return (outcomes.filter(after_uid).select("uid", zero, *ORDER),
            outcomes.filter(F.col("gate") == "fields").select("user_id", zero, *ORDER))


def seen_counts(requests: DataFrame, key: str, probe: Probe | None = None) -> DataFrame:
    """Running number of requests per key, after each request."""
    return numbered(requests, [key], ORDER, "value", probe=probe).select(key, "value", *ORDER)


# Update


def _against_current(requests: DataFrame) -> DataFrame:
    """Mask and merged, trimmed fields of requests joined with ``cur``, the stored user."""
    rows = requests.withColumn("_mask", masks.writable(F.col("mask")))
    return rows.withColumns({
        f"_new_{field}": strip_blank(masks.merged(F.col("_mask"), field, F.col(field), F.col(f"cur.{field}")))
        for field in ("display_name", "email")})


def _update_gates(domain: str, exists: Column, same_etag: Column, errors: Column) -> list[Gate]:
    return [
        Gate("user", ~exists, _missing_user(F.col("name"))),
        Gate("etag", ~same_etag, st.stale_etag(F.col("request_etag"), domain)),
        Gate("mask", ~masks.is_known(F.col("_mask")), st.bad_request(F.array(st.violation(
            "update_mask", text.BAD_MASK)))),
        Gate("fields", rules.broken(errors), st.bad_request(errors))]


def _updated(outcome: DataFrame, version: Column, display_name: Column, email: Column, secret: str) -> DataFrame:
    appended = F.when(masks.covers(F.col("_mask"), "groups"), F.col("groups")).otherwise(F.array())
    next_version = (version + 1).cast("int")
    return outcome.select(
        *ORDER, "name", "gate", "status",
        when_passed(F.col("cur.uid")).alias("uid"),
        when_passed(display_name).alias("display_name"),
        when_passed(email).alias("email"),
        when_passed(appended).alias("added_groups"),
        when_passed(next_version).alias("aggregate_version"),
        when_passed(user_etag(F.col("name"), next_version, secret)).alias("etag"))


def _with_current(requests: DataFrame, users: DataFrame, probe: Probe) -> DataFrame:
    state = users.select("name", F.struct("uid", "display_name", "email", "aggregate_version", "etag").alias("cur"))
    return lookup(requests, state, ["name"], ["request_id"], probe=probe)


def place_of(event_type: str) -> Column:
    """Where a request's event stands among the events of its user."""
    rank = USER_EVENT_TYPES.index(event_type) + 1
    return F.struct("ts", F.lit(rank).alias("event_rank"), F.col("request_id").alias("seq"))


def _since_birth(rows: DataFrame, births: DataFrame | None, probe: Probe) -> DataFrame:
    """Without the stored user on requests that come before it exists."""
    if births is None:
        return rows
    known = births.select("name", F.struct(*USER_EVENT_ORDER).alias("_born"))
    rows = lookup(rows, known, ["name"], ["request_id"], probe=probe)
    early = F.coalesce(F.col("_born") > place_of(USER_UPDATED), F.lit(False))
    return rows.withColumn("cur", F.when(~early, F.col("cur"))).drop("_born")


def _with_bumps(rows: DataFrame, bumps: DataFrame | None, probe: Probe) -> DataFrame:
    """Add ``_bumps``, how many of the other events of its user come before each request."""
    if bumps is None:
        return rows.withColumn("_bumps", F.lit(0).cast("bigint"))
    asks = rows.withColumns({**{c: place_of(USER_UPDATED)[c] for c in ("event_rank", "seq")}, "_ask": F.lit(True)})
    merged = asks.unionByName(bumps.select("name", *USER_EVENT_ORDER, F.lit(False).alias("_ask")), allowMissingColumns=True)
    return (OrderedRows.of(merged, ["name"], [*USER_EVENT_ORDER, "_ask"], probe=probe)
            .running(sums={"_bumps": F.when(F.col("_ask"), 0).otherwise(1)}).rows()
            .filter("_ask").drop("event_rank", "seq", "_ask"))


def update_users(requests: DataFrame, users: DataFrame, secret: str = USER_SECRET,
                 domain: str = st.DOMAIN) -> DataFrame:
    """Outcome of update requests that all see the same state.

    Two requests with the current etag can both pass, as when they read a replicated table at the
    same time; ``replay_updates`` lets every request see the earlier ones.
    """
    requests = requests.withColumnRenamed("etag", "request_etag")
    rows = _against_current(_with_current(requests, conform(users, USER), Probe(requests)))
    errors = rules.profile_violations(F.col("_new_display_name"), F.col("_new_email"), F.col("cur.uid"))
    rows = rows.withColumn("_errors", errors)
    outcome = judged(rows, _update_gates(domain, F.col("cur").isNotNull(), F.col("request_etag") == F.col("cur.etag"),
                                         F.col("_errors")), st.ok(text.USER_UPDATED))
    return _updated(outcome, F.col("cur.aggregate_version"), F.col("_new_display_name"), F.col("_new_email"), secret)


def _named_versions(rows: DataFrame, bumps: DataFrame | None, probe: Probe, secret: str) -> DataFrame:
    """How far above the stored version is the version each distinct etag of a user names?

    A user with d distinct etags in the log cannot move more than d versions by its updates, and not more than one by each
    other event. So as many candidate tags as the user has etags and events, made from those rows themselves, are
    enough to read every etag that can matter.
    """
    tags = rows.select("name", "request_etag", F.col("cur.aggregate_version").alias("_base")).distinct()
    steps = tags
    if bumps is not None:
        bases = tags.select("name", "_base").distinct()
        moved = lookup(bumps.select("name", *USER_EVENT_ORDER), bases, ["name"], USER_EVENT_ORDER, "inner")
        steps = tags.unionByName(moved.select("name", F.concat_ws(" ", "ts", "event_rank", "seq").alias("request_etag"), "_base"))
    placed = numbered(steps, ["name"], ["request_etag"], "_nth", probe=probe)
    level = (F.col("_nth") - 1).cast("int")
    candidates = placed.select("name", level.alias("named"), user_etag(
        F.col("name"), F.col("_base") + level, secret).alias("request_etag"))
    return tags.select("name", "request_etag").join(candidates, ["name", "request_etag"])


def replay_updates(requests: DataFrame, users: DataFrame, secret: str = USER_SECRET, domain: str = st.DOMAIN,
                   bumps: DataFrame | None = None, births: DataFrame | None = None) -> DataFrame:
    """Outcome of update requests in order, each seeing the effects of those before it.

    A request takes effect when it names the version its user has at that moment and its mask and
    fields are fine. Once a user was updated all stored fields are valid, so fields outside the mask
    matter only on the starting version, and whether a request is fine depends on nothing but
    itself, the version it names and the stored user.

    ``bumps`` are the other events of users, which move a version by one each: groups that are joined, made or removed.
    What a request names, less the stored version and the bumps before it, is the number of updates it expects to
    have taken effect, so the chain of updates is the same with and without them. ``births`` has the
    created event of users that begin to exist on the way; before it they are not there.
    """
    requests = requests.withColumnRenamed("etag", "request_etag")
    probe = Probe(requests)
    rows = _against_current(_since_birth(_with_current(requests, conform(users, USER), probe), births, probe))
    rows = _with_bumps(rows, bumps, probe)
    if bumps is not None:
        rows = pinned(rows, "bumped")
    named = _named_versions(rows.filter("cur is not null"), bumps, probe, secret)
    rows = lookup(rows, named, ["name", "request_etag"], ["request_id"], probe=probe)
    rows = pinned(rows.withColumn("level", (F.col("named") - F.col("_bumps")).cast("int")).drop("named"), "updates")

    def judged_value(field: str) -> Column:
        from_store = (F.col("level") > 0) & ~masks.covers(F.col("_mask"), field)
        return F.when(from_store, "fine").otherwise(F.col(f"_new_{field}"))

    rows = rows.withColumn("_errors", rules.profile_violations(
        judged_value("display_name"), judged_value("email"), F.col("cur.uid")))
    able = rows.filter((F.col("level") >= 0) & F.col("cur").isNotNull() & masks.is_known(F.col("_mask")) & ~rules.broken(F.col("_errors")))
    effects = effective(able.select("name", "level", *ORDER), "name", ORDER).withColumn("_effect", F.lit(1))

    # The join key tells every row apart, so no key of it is heavy.
    rows = rows.join(effects, ["name", "level", *ORDER], "left")
    hit = F.col("_effect").isNotNull()
    scan = OrderedRows.of(rows, ["name"], ORDER, probe=probe).running(
        sums={"_moved": F.when(hit, 1).otherwise(0)},
        lasts={f"_kept_{field}": F.when(hit & masks.covers(F.col("_mask"), field), F.struct(F.col(f"_new_{field}").alias("v")))
               for field in ("display_name", "email")})
    rows = scan.rows()
    before = F.col("_moved") - F.when(hit, 1).otherwise(0)
    outcome = judged(rows, _update_gates(domain, F.col("cur").isNotNull(), F.coalesce(F.col("level") == before, F.lit(False)),
                                         F.col("_errors")), st.ok(text.USER_UPDATED))

    def value_now(field: str) -> Column:
        kept = F.col(f"_kept_{field}")
        return F.when(kept.isNotNull(), kept["v"]).otherwise(strip_blank(F.col(f"cur.{field}")))

    return _updated(outcome, F.col("cur.aggregate_version") + F.col("_bumps") + before, value_now("display_name"), value_now("email"),
                    secret)


def updated_events(outcomes: DataFrame) -> DataFrame:
    """An update names its new profile and what it appends to the group list, which it leaves alone."""
    rows = passed(outcomes).withColumns({"seq": F.col("request_id"), "event_type": F.lit(USER_UPDATED)})
    return conform(rows, USER_EVENT, keep_null=("groups",))


# Upsert

UPSERT_CREATE, UPSERT_UPDATE, UPSERT_INVALID = "create", "update", "invalid"


def _asked_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Only users with an asked name or uid can matter."""
    asked = requests.select("name", "uid").distinct()
    users = conform(users, USER)
    named, known = users.join(asked, "name", "left_semi").select(*users.columns), users.join(asked, "uid", "left_semi").select(*users.columns)
    return pinned(named.union(known).distinct(), "asked-users")


def _as_creates(rows: DataFrame) -> DataFrame:
    return rows.select(*ORDER, "uid", user_id_of(F.col("name")).alias("user_id"), "display_name", "email")


def _held(users: DataFrame) -> DataFrame:
    return users.select("uid", user_id_of(F.col("name")).alias("user_id"))


def _upserted(rows: DataFrame, created: DataFrame, updated: DataFrame) -> DataFrame:
    """The outcomes of all routes of ``rows`` in one shape."""
    created = created.withColumn("name", user_name(F.col("user_id")))
    created = created.withColumns({field: when_passed(value) for field, value in {
        "uid": F.col("uid"), "display_name": strip_blank(F.col("display_name")), "email": strip_blank(F.col("email"))
    }.items()})
    invalid = judged(rows.filter(F.col("route") == UPSERT_INVALID), [Gate("name", F.lit(True), st.status(
        st.INVALID_ARGUMENT, F.format_string(text.BAD_NAME, "name")))], st.ok(""))

    columns = [*ORDER, "name", "route", "gate", "status", "uid", "display_name", "email", "aggregate_version", "etag"]
    empty = F.lit(None)
    invalid = invalid.withColumns({
        **{c: empty.cast("string") for c in ("uid", "display_name", "email", "etag")},
        "aggregate_version": empty.cast("int")})
    return (created.withColumn("route", F.lit(UPSERT_CREATE)).select(*columns)
            .unionByName(updated.withColumn("route", F.lit(UPSERT_UPDATE)).select(*columns))
            .unionByName(invalid.select(*columns)))


def upsert_users(requests: DataFrame, users: DataFrame, secret: str = USER_SECRET,
                 domain: str = st.DOMAIN) -> DataFrame:
    """Update, or create when the user is absent and the request allows it. One route per request.

    All requests see the same users, so a second upsert of an absent user takes the create route too and finds its name
    taken; ``replay_upserts`` lets every request see the earlier ones.
    """
    users = _asked_users(requests, users)
    rows = exists_in(requests, users.select("name"), ["name"], ["request_id"], "_exists")
    route = (F.when(~is_user_name(F.col("name")), UPSERT_INVALID)
             .when(~F.col("_exists") & F.col("allow_missing"), UPSERT_CREATE).otherwise(UPSERT_UPDATE))
    rows = rows.withColumn("route", route).drop("_exists")
    created = create_users(_as_creates(rows.filter(F.col("route") == UPSERT_CREATE)), _held(users), secret, domain)
    updated = update_users(rows.filter(F.col("route") == UPSERT_UPDATE).drop("route"), users, secret, domain)
    return _upserted(rows, created, updated)


def replay_upserts(requests: DataFrame, users: DataFrame, secret: str = USER_SECRET,
                   domain: str = st.DOMAIN) -> DataFrame:
    """Upserts in order: the first that is granted an absent user's name creates it, later ones of that name update it.

    The allocation of uids and names is that of create requests: a later request of a granted name could not be granted
    whatever its route, so who is granted does not depend on the routes. Requests of the name before the granted one
    keep the create route, later ones become links of the update chain that begins at version 1.
    """
    users = _asked_users(requests, users)
    probe = Probe(requests)
    rows = exists_in(requests, users.select("name"), ["name"], ["request_id"], "_exists", probe)
    rows = pinned(rows.withColumn("_valid", is_user_name(F.col("name"))), "upserts")
    creating = rows.filter(F.col("_valid") & ~F.col("_exists") & F.col("allow_missing"))
    granted = pinned(_granted(_as_creates(creating), _held(users)), "granted-upserts")

    place = F.struct(*ORDER)
    firsts = granted.select(user_name(F.col("user_id")).alias("name"), place.alias("_first"))
    rows = lookup(rows, firsts, ["name"], ["request_id"], probe=probe)
    there = F.col("_exists") | F.coalesce(F.col("_first") < place, F.lit(False))
    route = (F.when(~F.col("_valid"), UPSERT_INVALID)
             .when(~there & F.col("allow_missing"), UPSERT_CREATE).otherwise(UPSERT_UPDATE))
    rows = pinned(rows.withColumns({"route": route, "_there": there}).select(*requests.columns, "route", "_there"), "routes")

    creates = _as_creates(rows.filter(F.col("route") == UPSERT_CREATE))
    created = pinned(create_users(creates, _held(users), secret, domain, granted), "upserts-created")
    added = conform(created_events(created).withColumn("aggregate_version", F.lit(1)), USER).withColumn("etag", user_etag(F.col("name"), F.lit(1), secret))
    updates = rows.filter(F.col("route") == UPSERT_UPDATE)
    updated = replay_updates(updates.filter("_there").select(*requests.columns), users.unionByName(added), secret, domain)
    early = update_users(updates.filter("not _there").select(*requests.columns), users.limit(0), secret, domain)
    return _upserted(rows, created, updated.unionByName(early))


# Remove a group


def log_of_asked(events: DataFrame, requests: DataFrame) -> DataFrame:
    """The events of the users that remove-group requests name; no other user's state matters to them."""
    asked = pinned(requests.select(F.col("user_name").alias("name")).distinct(), "asked")
    return pinned(lookup(events, asked, ["name"], USER_EVENT_ORDER, "left_semi").select(*events.columns), "asked-events")


def remove_groups(requests: DataFrame, users: DataFrame, groups: DataFrame, secret: str = USER_SECRET) -> DataFrame:
    """Outcome of remove-group requests against users and their group rows (see ``user_groups``).

    The reply is the user with its version and etag after the removal. ``groups_left`` is the length of the
    remaining list; its elements, one row each, are given by ``remaining_groups``.
    """
    held = pinned(groups.groupBy("name", "group_name").agg(F.count(F.lit(1)).alias("_equal")), "held")
    sizes = held.groupBy("name").agg(F.sum("_equal").alias("_size"))
    profile = ["uid", "display_name", "email"]
    state = users.select("name", "aggregate_version", *profile).join(sizes, "name", "left").select(
        F.col("name").alias("user_name"), F.struct("aggregate_version", "_size", *profile).alias("cur"))
    rows = lookup(requests, state, ["user_name"], ["request_id"])
    rows = lookup(rows, held.withColumnRenamed("name", "user_name"), ["user_name", "group_name"], ["request_id"],
                  probe=Probe(requests))
    gates = [
        Gate("user", F.col("cur").isNull(), _missing_user(F.col("user_name"))),
        Gate("group", F.col("_equal").isNull(), st.not_found(F.format_string(text.NO_GROUP, "group_name")))]
    version = F.col("cur.aggregate_version") + 1
    return judged(rows, gates, st.ok(text.GROUP_REMOVED)).select(
        *ORDER, "user_name", "group_name", "gate", "status",
        *[when_passed(F.col(f"cur.{field}")).alias(field) for field in profile],
        when_passed(F.col("cur._size") - F.col("_equal")).alias("groups_left"),
        when_passed(version).alias("aggregate_version"),
        when_passed(user_etag(F.col("user_name"), version, secret)).alias("etag"))


def remaining_groups(outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    """The list each passed removal leaves, as (request_id, position, group_name) rows in list order."""
    asked = passed(outcomes).select("request_id", F.col("user_name").alias("name"), F.col("group_name").alias("_gone"))
    held = groups.select("name", "group_name", F.col("position").alias("_place"))
    left = lookup(asked, held, ["name"], ["request_id"], "inner").filter(F.col("group_name") != F.col("_gone"))
    return numbered(left, ["request_id"], ["_place"], "position").select("request_id", "position", "group_name")


def removed_events(outcomes: DataFrame) -> DataFrame:
    rows = passed(outcomes).select(F.col("user_name").alias("name"), "group_name", "ts", F.col("request_id").alias("seq"),
                                   F.lit(GROUP_REMOVED).alias("event_type"))
    return conform(rows, USER_EVENT, keep_null=("groups",))
