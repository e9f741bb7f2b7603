"""Requests of all kinds in order, against one-by-one handling."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest

import sequential
from rosterfold.plans import directory
from rosterfold.plans.users import replay_upserts
from rosterfold.schemas import (CREATE_INVITATION_REQUEST, CREATE_USER_REQUEST, DECIDE_INVITATION_REQUEST, REMOVE_GROUP_REQUEST, UPDATE_USER_REQUEST,
                                USER, USER_EVENT, conform)

START = datetime(2024, 1, 1)
DIRTY = ("groups", "display_name")


def users_of(spark, users):
    rows = [(n, u[0], u[1], u[2], u[3], list(u[4]) if len(u) > 4 else [], sequential.user_etag(n, u[3])) for n, u in users.items()]
    return conform(spark.createDataFrame(rows, "name string, uid string, display_name string, email string, aggregate_version int, groups array<string>, etag string"), USER)


def events_of(spark, rows):
    return conform(spark.createDataFrame(rows, "ts timestamp_ntz, seq long, name string, event_type string, group_name string, display_name string, groups array<string>, added_groups array<string>"), USER_EVENT, keep_null=DIRTY)


# Removals.


def test_removals_in_order(either):
    rng = random.Random(1)
    prior = {"users/old1": ("u1", "Old one", "o@x", 4, ["g1", "g2", "g1"]), "users/old2": ("u2", "Old two", "p@x", 1, [])}
    names, groups = ["users/hot1", "users/old1", "users/old2", "users/new1", "users/none"], ["g1", "g2", "g3"]
    events, requests = [], []
    for k in range(180):
        ts = START + timedelta(minutes=k // 4)
        name = "users/hot1" if rng.random() < 0.5 else rng.choice(names[:4])
        kind = rng.random()
        if kind < 0.35:
            events.append((ts, k, name, rng.choice(["GroupCreated", "GroupInvitationAccepted"]), rng.choice(groups), None, None, None))
        elif kind < 0.42:
            events.append((ts, k, name, "GroupRemoved", rng.choice(groups), None, None, None))
        elif kind < 0.5:
            events.append((ts, k, name, "UserUpdated", None, f"Name {k}", rng.choice([None, [], ["g1", "g1", "g2"]]), rng.choice([None, ["g3"]])))
        elif kind < 0.53 and name.endswith(("hot1", "new1")):
            events.append((ts, k, name, "UserCreated", None, f"Born {k}", ["g2"], None))
        else:
            requests.append((1000 + k, ts, rng.choice([name, "users/none"]) if rng.random() < 0.1 else name, rng.choice(groups)))
    # One by one, in the order of the events of a user.
    steps = [(sequential.event_place(e), "event", e) for e in events] + [((r[1], 5, r[0]), "request", r) for r in requests]
    state, want = {n: [u[3], list(u[4])] for n, u in prior.items()}, {}
    for _, what, row in sorted(steps, key=lambda s: s[0]):
        if what == "request":
            rid, _, name, group = row
            if name not in state:
                want[rid] = ("user", None, None)
            elif group not in state[name][1]:
                want[rid] = ("group", None, None)
            else:
                state[name] = [state[name][0] + 1, [g for g in state[name][1] if g != group]]
                want[rid] = (None, state[name][0], len(state[name][1]))
            continue
        _, _, name, kind, group, _, held, added = row
        if kind == "UserCreated":
            state[name] = [1, list(held or []) + list(added or [])]
        elif name in state:
            version, members = state[name]
            if kind == "UserUpdated":
                members = (list(held) if held is not None else members) + list(added or [])
            elif kind == "GroupRemoved":
                members = [g for g in members if g != group]
            else:
                members = [*members, group]
            state[name] = [version + 1, members]
    asked = conform(either.createDataFrame(requests, "request_id long, ts timestamp_ntz, user_name string, group_name string"), REMOVE_GROUP_REQUEST)
    outcomes = directory.replay_removals(asked, events_of(either, events), users_of(either, prior))
    got = {r.request_id: (r.gate, r.aggregate_version, r.groups_left) for r in outcomes.collect()}
    assert got == want
    assert {g for g, _, _ in want.values()} == {None, "user", "group"}


def test_the_second_removal_finds_nothing(spark):
    events = events_of(spark, [(START, 1, "users/abcd", "UserCreated", None, "Name", ["g1", "g1", "g2"], None)])
    asked = conform(spark.createDataFrame([(n, START + timedelta(1), "users/abcd", "g1") for n in (1, 2)], "request_id long, ts timestamp_ntz, user_name string, group_name string"), REMOVE_GROUP_REQUEST)
    got = {r.request_id: (r.status.code, r.aggregate_version, r.groups_left, r.display_name, r.etag) for r in directory.replay_removals(asked, events).collect()}
    assert got == {1: (0, 2, 1, "Name", sequential.user_etag("users/abcd", 2)), 2: (5, None, None, None, None)}


# Upserts.

UPSERT = "request_id long, ts timestamp_ntz, name string, uid string, etag string, mask array<string>, display_name string, email string, allow_missing boolean"


def test_upserts_in_order(either):
    rng = random.Random(3)
    users = {"users/abcd": ("u0", "Old name", "o@x", 2), "users/bad1": ("u1", "x", "b@x", 1)}
    names = [*users, "users/new1", "users/new2", "users/new3", "users/Bad_Id", "users/x", "nobody"]
    rows = []
    for rid in range(160):
        name = "users/new1" if rng.random() < 0.4 else rng.choice(names)
        version = rng.choice([1, 1, 2, 3])
        if rid % 8 == 0:
            done = sequential.replay_upserts(users, rows)
            heads = {r[2]: done[r[0]][2] for r in rows if done[r[0]][2]}
        version = heads.get(name, version) if rng.random() < 0.6 else version
        rows.append((rid, START + timedelta(minutes=rid // 5), name, rng.choice(["u0", "u7", f"v{name[-1]}", f"v{rid}"]), sequential.user_etag(name, version),
                     rng.choice([["display_name"], ["email"], ["uid"], ["nope"], ["email", "display_name"]]), rng.choice(["x", f" Name {rid} "]), rng.choice(["", f"m{rid}@x"]),
                     rng.random() < 0.7))
    outcomes = replay_upserts(conform(either.createDataFrame(rows, UPSERT), UPDATE_USER_REQUEST), users_of(either, users))
    got = {r.request_id: (r.route, r.gate, r.aggregate_version) for r in outcomes.collect()}
    want = sequential.replay_upserts(users, rows)
    assert got == want
    assert {(r, g) for r, g, _ in want.values()} >= {("create", None), ("create", "uid"), ("update", None), ("update", "user"), ("update", "etag"), ("invalid", "name")}


def test_the_second_upsert_updates(spark):
    tag = sequential.user_etag("users/none", 1)
    rows = [(1, START, "users/none", "v", "", [], "Brand new", "n@x", True), (2, START, "users/none", "v", tag, ["email"], "", "m@x", True)]
    outcomes = replay_upserts(conform(spark.createDataFrame(rows, UPSERT), UPDATE_USER_REQUEST), users_of(spark, {"users/else": ("w", "Some one", "s@x", 1)}))
    got = {r.request_id: (r.route, r.status.code, r.uid, r.display_name, r.email, r.aggregate_version) for r in outcomes.collect()}
    assert got == {1: ("create", 0, "v", "Brand new", "n@x", 1), 2: ("update", 0, "v", "Brand new", "m@x", 2)}


# Everything together.


def invitation_of(parent, request_id):
    digest = hashlib.sha256(str(request_id).encode()).hexdigest()
    return f"{parent}/groupInvitations/{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:32]}"


def random_directory(seed, appending, size=240):
    """Users, groups and invitations at the start, and steps (kind, ts, id, fields), ids unique, in the order that is theirs."""
    rng = random.Random(seed)
    users = {"users/hot1": ("u0", "Hot one", "h@x", 3, ["g1", "g1"]), "users/cold": ("u1", "Cold one", "c@x", 1, []), "users/thin": ("u2", "x", "t@x", 1, ["g2"])}
    pending = {f"users/{u}/groupInvitations/i{k}": f"g{k % 4}" for k in range(14) for u in ("hot1", "cold", "new1")}
    names, groups = [*users, "users/new1", "users/new2"], [f"g{k}" for k in range(5)]
    steps, live = [], sequential.Directory(users, ["g0", "g1"], pending)
    for k in range(size):
        ts, name, kind = START + timedelta(minutes=k), ("users/hot1" if rng.random() < 0.5 else rng.choice(names)), rng.random()
        if kind < 0.05:
            fields = (rng.choice(["u0", "v1", f"v{k}"]), rng.choice(["new1", "new2", "x"]), rng.choice(["Some name", "x"]), "n@x")
            steps.append(("create", ts, k, fields))
        elif kind < 0.5:
            version = live.users[name][3] if name in live.users and rng.random() < 0.7 else rng.randrange(8)
            groups_here = [rng.choice(groups)] if appending and rng.random() < 0.5 else []
            mask = rng.choice([["display_name"], ["email"], ["groups"], ["groups", "email"], ["nope"], ["uid"]] if appending else [["display_name"], ["email"], ["nope"], ["uid"]])
            steps.append(("update", ts, k, (name, sequential.user_etag(name, version), mask, rng.choice(["x", f" Name {k}"]), f"m{k}@x", groups_here)))
        elif kind < 0.58:
            steps.append(("make", ts, k, (rng.choice(groups + [f"own{k}"]), name)))
        elif kind < 0.75:
            steps.append(("remove", ts, k, (name, rng.choice(groups))))
        elif kind < 0.82:
            steps.append(("invite", ts, k, (invitation_of(name, k), name, rng.choice(groups))))
        else:
            made = [n for n in live.invitations if n not in pending]
            invitation = rng.choice(made if made and rng.random() < 0.3 else list(pending) + ["users/none/groupInvitations/x"])
            steps.append(("decide", ts, k, (invitation, sequential.invitation_etag(invitation, rng.choice([1, 1, 1, 2])), rng.choice(["ACCEPTED", "ACCEPTED", "REJECTED"]))))
        getattr(live, steps[-1][0])(*steps[-1][3])
    return users, pending, steps


@pytest.mark.parametrize(("seed", "appending", "size"), [(1, False, 200), (2, True, 130)])
def test_directory_equals_one_by_one_handling(spark, seed, appending, size):
    against_one_by_one_handling(spark, *random_directory(seed, appending, size))


def test_directory_with_heavy_keys(heavy):
    against_one_by_one_handling(heavy, *random_directory(3, True, 60))


def against_one_by_one_handling(spark, users, pending, steps):
    live, want = sequential.Directory(users, ["g0", "g1"], pending), {}
    for kind, _, rid, fields in steps:
        want[kind, rid] = getattr(live, kind)(*fields)
    of = lambda kind: [(rid, ts, *fields) for k, ts, rid, fields in steps if k == kind]
    head = "request_id long, ts timestamp_ntz, "
    frame = lambda rows, columns, schema: conform(spark.createDataFrame(rows, head + columns), schema)
    decisions = [(str(r[0]), *r[1:]) for r in of("decide")]
    made = [(ts, rid, group, owner) for rid, ts, group, owner in of("make")] + [(None, 0, "g0", ""), (None, 0, "g1", "")]
    requests = directory.Requests(
        creates=frame(of("create"), "uid string, user_id string, display_name string, email string", CREATE_USER_REQUEST),
        updates=frame(of("update"), "name string, etag string, mask array<string>, display_name string, email string, groups array<string>", UPDATE_USER_REQUEST),
        removals=frame(of("remove"), "user_name string, group_name string", REMOVE_GROUP_REQUEST),
        invites=frame([(r[0], r[1], *r[3:]) for r in of("invite")], "parent string, group_name string", CREATE_INVITATION_REQUEST),
        decisions=conform(spark.createDataFrame(decisions, "request_id string, ts timestamp_ntz, name string, etag string, action string"), DECIDE_INVITATION_REQUEST),
        made=spark.createDataFrame(made, "ts timestamp_ntz, seq long, name string, owner string"))
    offered = spark.createDataFrame([(n, g, "PENDING", START, 1, sequential.invitation_etag(n, 1)) for n, g in pending.items()],
                                    "name string, group_name string, state string, create_time timestamp_ntz, aggregate_version int, etag string")
    got = directory.replay(users_of(spark, users), offered, requests)
    rows = {**{("create", r.request_id): (r.gate, r.aggregate_version) for r in got.created.collect()},
            **{("update", r.request_id): (r.gate, r.aggregate_version) for r in got.updated.collect()},
            **{("remove", r.request_id): (r.gate, r.aggregate_version, r.groups_left) for r in got.removed.collect()},
            **{("invite", r.request_id): (r.gate, r.aggregate_version) for r in got.invited.collect()},
            **{("decide", int(r.request_id)): (r.gate, r.aggregate_version) for r in got.decided.collect()}}
    assert rows == {k: v for k, v in want.items() if k[0] != "make"}
    # The history that the outcomes lead to ends where the service ends, and gives updates the versions they were told.
    last = {r.name: r for r in directory.folds.user_snapshot(got.history).collect()}
    assert {n: (r.uid, r.display_name, r.email, r.aggregate_version) for n, r in last.items()} == {n: tuple(u[:4]) for n, u in live.users.items() if n in last}
    assert sum(v[0] is None for (k, _), v in want.items() if k == "update" and v) > 5
    versions = {r.seq: r.aggregate_version for r in got.history.filter("event_type = 'UserUpdated'").collect()}
    assert versions == {rid: v for (k, rid), (g, v, *_) in rows.items() if k == "update" and g is None}


def test_only_users_whose_appended_groups_matter_are_computed_again(spark, monkeypatch):
    users = {f"users/u{k}": (f"v{k}", f"User {k}", "u@x", 1, ["g1"]) for k in range(3)}
    at = [START + timedelta(minutes=k) for k in range(4)]
    # u0 appends a group that is removed later, u1 appends one after its removal, u2 appends nothing.
    updates = [(1, at[1], "users/u0", ["groups"], ["g2"]), (2, at[2], "users/u1", ["groups"], ["g2"]), (3, at[1], "users/u2", ["email"], [])]
    removals = [(4, at[2], "users/u0", "g2"), (5, at[1], "users/u1", "g2"), (6, at[2], "users/u2", "g1")]
    rows = [(r, t, n, sequential.user_etag(n, 1), mask, "Some name", "m@x", groups) for r, t, n, mask, groups in updates]
    empty = lambda schema: conform(spark.createDataFrame([], "request_id long, ts timestamp_ntz").select("ts"), schema)
    requests = directory.Requests(
        creates=empty(CREATE_USER_REQUEST), invites=empty(CREATE_INVITATION_REQUEST), decisions=empty(DECIDE_INVITATION_REQUEST),
        updates=conform(spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, name string, etag string, mask array<string>, display_name string, email string, groups array<string>"), UPDATE_USER_REQUEST),
        removals=conform(spark.createDataFrame(removals, "request_id long, ts timestamp_ntz, user_name string, group_name string"), REMOVE_GROUP_REQUEST),
        made=spark.createDataFrame([], "ts timestamp_ntz, seq long, name string, owner string"))
    pending = spark.createDataFrame([], "name string, group_name string, state string, create_time timestamp_ntz, aggregate_version int, etag string")
    seen, effects = [], directory._removal_effects
    monkeypatch.setattr(directory, "_removal_effects", lambda asked, *rest: (seen.append(sorted(r[0] for r in asked.select("user_name").collect())), effects(asked, *rest))[1])
    got = directory.replay(users_of(spark, users), pending, requests)
    assert seen == [sorted(users), ["users/u0"]]
    assert {r.request_id: (r.gate, r.aggregate_version, r.groups_left) for r in got.removed.collect()} == {4: (None, 3, 1), 5: ("group", None, None), 6: (None, 3, 0)}
    assert {r.request_id: (r.gate, r.aggregate_version) for r in got.updated.collect()} == {1: (None, 2), 2: (None, 2), 3: (None, 2)}


def test_rows_of_some_users_and_of_all_others(either):
    rows = [(f"u{k % 3}", k) for k in range(60)] + [("u1", k) for k in range(60, 100)]
    df = either.createDataFrame(rows, "user_name string, request_id long")
    names = either.createDataFrame([("u1",), ("u9",)], "name string")
    for how, inside in (("left_semi", True), ("left_anti", False)):
        got = directory._some(df, names, ["request_id"], how, "user_name")
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if (r[0] == "u1") == inside)
