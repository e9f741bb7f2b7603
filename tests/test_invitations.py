import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import sequential
from rosterfold.functions.status import flat_status
from rosterfold.operators import folds
from rosterfold.plans import invitations as inv
from rosterfold.plans.lookups import BLOCK, find_users, get_users, groups_of, list_invitations
from rosterfold.schemas import (CREATE_INVITATION_REQUEST, DECIDE_INVITATION_REQUEST, INVITATION, INVITATION_EVENT, LOOKUP_REQUEST,
                                conform)

START = datetime(2024, 1, 1, 0, 0, 0, 123456)


def stored_of(spark, states):
    rows = [(n, "groups/g", s, START, v, sequential.invitation_etag(n, v)) for n, (s, v) in states.items()]
    return conform(spark.createDataFrame(rows, "name string, group_name string, state string, create_time timestamp_ntz, "
                                               "aggregate_version int, etag string"), INVITATION)


def decisions_of(spark, rows):
    return conform(spark.createDataFrame(
        rows, "request_id string, ts timestamp_ntz, name string, etag string, action string"),
        DECIDE_INVITATION_REQUEST)


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_decisions_equal_one_by_one_handling(either, seed):
    rng = random.Random(seed)
    names = [f"users/a/groupInvitations/i{n}" for n in range(12)]
    states = {n: (rng.choice(["PENDING", "PENDING", "ACCEPTED"]), rng.choice([1, 1, 3])) for n in names}
    rows = []
    for n in range(200):
        name = names[0] if rng.random() < 0.35 else rng.choice([*names, "users/a/groupInvitations/none"])
        tag = sequential.invitation_etag(name, states.get(name, ("", 1))[1] + rng.choice([-1, 0, 1, 1]))
        # Few times, so that very many requests have equal ones.
        rows.append((f"r{n}", START + timedelta(minutes=rng.randrange(4)), name, tag, rng.choice(["ACCEPTED", "REJECTED"])))
    outcomes = inv.replay_decisions(decisions_of(either, rows), stored_of(either, states))
    want = sequential.replay_decisions(states, rows)
    assert {r.request_id: r.gate for r in outcomes.collect()} == want
    decided = inv.decided_events(outcomes)
    assert decided.count() == sum(gate is None for gate in want.values())
    joined = inv.membership_events(decided).collect()
    assert {r.name for r in joined} == {"users/a"} and all(r.event_type == "GroupInvitationAccepted" for r in joined)


def test_equal_times(spark):
    """Of two requests on one invitation at one time only the first may succeed, and a decision at the time of its
    invitation follows it."""
    name, tag = "users/a/groupInvitations/p", sequential.invitation_etag
    rows = [("r2", START, name, tag(name, 1), "REJECTED"), ("r1", START, name, tag(name, 1), "ACCEPTED")]
    outcomes = inv.replay_decisions(decisions_of(spark, rows), stored_of(spark, {name: ("PENDING", 1)}))
    assert {r.request_id: r.gate for r in outcomes.collect()} == {"r1": None, "r2": "etag"}
    created = conform(spark.createDataFrame([(START, 99, name, "GroupInvitationCreated", "PENDING")],
                                            "ts timestamp_ntz, seq long, name string, event_type string, state string"), INVITATION_EVENT)
    state = folds.invitation_snapshot(folds.invitation_history(created.unionByName(inv.decided_events(outcomes)))).collect()
    assert [(s.state, s.aggregate_version) for s in state] == [("ACCEPTED", 2)]


def test_groups_of_owners(spark):
    made = spark.createDataFrame([(START, 1, "groups/g", "users/a"), (START, 2, "groups/h", "")], "ts timestamp_ntz, seq long, name string, owner string")
    assert [(r.name, r.group_name, r.event_type) for r in inv.group_created_events(made).collect()] == [("users/a", "groups/g", "GroupCreated")]


def test_decision_statuses(spark):
    states = {"users/a/groupInvitations/p": ("PENDING", 1), "users/a/groupInvitations/d": ("REJECTED", 2)}
    tag = sequential.invitation_etag
    p, d = states
    rows = [("none", START, "x", "", "ACCEPTED"), ("stale", START, p, tag(p, 9), "ACCEPTED"),
            ("done", START, d, tag(d, 2), "ACCEPTED"), ("ok", START, p, tag(p, 1), "REJECTED")]
    outcomes = inv.decide_invitations(decisions_of(spark, rows), stored_of(spark, states), domain="svc")
    flat = {r.request_id: r for r in flat_status(outcomes, "request_id", "state", "update_time", "etag", "group_name").collect()}
    assert {k: r.code for k, r in flat.items()} == {"none": 3, "stale": 10, "done": 9, "ok": 0}
    assert (flat["none"].violation_fields, flat["none"].violation_texts) == ("group", "x does not exists.")
    assert (flat["done"].message, flat["done"].precondition) == ("", "NOT_PENDING")
    assert flat["ok"].message == "Group Invitation rejected" and flat["ok"].state == "REJECTED"
    assert flat["ok"].update_time == START.replace(microsecond=123000) and flat["ok"].etag == tag(p, 2)


def test_created_invitations_keep_the_etag_of_their_reply(spark):
    requests = conform(spark.createDataFrame(
        [(1, START, "users/abcd", "groups/g"), (2, START, "users/abcd", "groups/no"), (3, START, "users/none", "groups/g"),
         (4, START, "users/none", "groups/no")],
        "request_id long, ts timestamp_ntz, parent string, group_name string"), CREATE_INVITATION_REQUEST)
    users, groups = (spark.createDataFrame([(n,)], "name string") for n in ("users/abcd", "groups/g"))
    outcomes = inv.create_invitations(requests, users, groups)
    made = {r.request_id: r for r in outcomes.collect()}
    assert {k: r.gate for k, r in made.items()} == {1: None, 2: "group", 3: "parent", 4: "group"}
    state = folds.invitation_snapshot(folds.invitation_history(inv.created_invitation_events(outcomes))).collect()
    assert [(s.name, s.etag, s.state, s.group_name) for s in state] == [
        (made[1].name, made[1].etag, "PENDING", "groups/g")]


def test_pages(either):
    index = either.createDataFrame(
        [("users/many", n, f"m{n}") for n in range(1, 2 * BLOCK + 10)] + [("users/few1", n, f"f{n}") for n in (1, 2, 3)],
        "parent string, position long, name string")
    state = index.select("name", F.lit("g").alias("group_name"), F.lit("PENDING").alias("state"),
                         F.lit(1).alias("aggregate_version"), F.lit("e").alias("etag"))
    token = {0: "", 2: "Mg==", 3: "Mw==", 100: "MTAw"}
    asked = [(1, "users/few1", token[0], 2), (2, "users/few1", token[2], 2), (3, "users/few1", token[3], 2),
             (4, "users/few1", token[0], 0), (5, "users/none", token[0], 2), (6, "users/many", token[100], 10_000),
             (7, "users/few1", "!!", 3), (8, "users/many", "", BLOCK)] + [(n, "users/many", token[100], 1) for n in range(20, 40)]
    requests = conform(either.createDataFrame(asked, "request_id long, name string, page_token string, page_size int"),
                       LOOKUP_REQUEST)
    answers, items = list_invitations(requests, index, state)
    told = {r.request_id: (r.status.code, r.next_page_token) for r in answers.collect()}
    assert [told[n] for n in range(1, 9)] == [(0, "Mg=="), (0, ""), (0, ""), (3, None), (5, None), (0, ""), (0, ""),
                                              (0, "MTI4")]
    shown = {}
    for r in items.orderBy("request_id", "position").collect():
        shown.setdefault(r.request_id, []).append(r.name)
    assert shown[1] == ["f1", "f2"] and shown[2] == ["f3"] and 3 not in shown and shown[7] == ["f1", "f2", "f3"]
    assert shown[6] == [f"m{n}" for n in range(101, 2 * BLOCK + 10)] and shown[8] == [f"m{n}" for n in range(1, BLOCK + 1)]
    assert all(shown[n] == ["m101"] for n in range(20, 40))


def test_reading_users(either):
    users = either.createDataFrame([("users/abcd", "u", "Name", "e", 1, "t"), ("users/x", "w", "Name", "e", 1, "t")],
                                   "name string, uid string, display_name string, email string, aggregate_version int, etag string")
    asked = [(1, "users/abcd", "u"), (2, "users/x", "w"), (3, "users/none", "none")]
    requests = either.createDataFrame(asked, "request_id long, name string, uid string")
    got = {r.request_id: (r.status.code, r.status.message, r.uid) for r in get_users(requests, users).collect()}
    assert got == {1: (0, "", "u"), 2: (3, "users/x is not a valid name format.", None),
                   3: (5, "users/none does not exists.", None)}
    found = {r.request_id: (r.status.code, r.status.message, r.name)
             for r in find_users(requests, users.select("uid", "name"), users).collect()}
    assert found == {1: (0, "", "users/abcd"), 2: (3, "users/x is not a valid name format.", "users/x"),
                     3: (5, "Uid none does not exists.", None)}
    groups = either.createDataFrame([("users/abcd", 1, "g"), ("users/other", 1, "g")], "name string, position long, group_name string")
    assert [r.name for r in groups_of(requests, users, groups).collect()] == ["users/abcd"]
