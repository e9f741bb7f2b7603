import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import sequential
from rosterfold.functions.status import flat_status
from rosterfold.plans.users import remove_groups, removed_events, replay_updates, update_users, updated_events, upsert_users
from rosterfold.schemas import REMOVE_GROUP_REQUEST, UPDATE_USER_REQUEST, USER, conform

START = datetime(2024, 1, 1)
COLUMNS = "request_id long, ts timestamp_ntz, name string, etag string, mask array<string>, display_name string, email string"


def users_of(spark, users):
    rows = [(n, u, d, e, v, sequential.user_etag(n, v)) for n, (u, d, e, v) in users.items()]
    return conform(spark.createDataFrame(
        rows, "name string, uid string, display_name string, email string, aggregate_version int, etag string"), USER)


def requests_of(spark, rows, extra=""):
    return conform(spark.createDataFrame(rows, COLUMNS + extra), UPDATE_USER_REQUEST)


def random_case(seed, size=220):
    rng = random.Random(seed)
    users = {"users/hot1": ("u0", "Hot one", "h@x", 3), "users/bad1": ("u1", "x", "b@x", 1), "users/noid": ("", "Name", "n@x", 1),
             **{f"users/c{n:03}": (f"u{n}", " Old name ", "o@x", rng.choice([1, 2])) for n in range(8)}}
    names, heads = list(users), {n: v[3] for n, v in users.items()}
    rows = []
    for rid in range(size):
        name = "users/hot1" if rng.random() < 0.4 else rng.choice([*names, "users/none"])
        if rid % 10 == 0:
            # Versions follow the state, so that a good share of the requests names the current one.
            outcomes = sequential.replay_updates(users, rows)
            heads.update({r[2]: outcomes[r[0]][3] for r in rows if outcomes[r[0]][0] is None})
        version = heads.get(name, 1) + rng.choice([0, 0, 0, 1, 2, -1])
        etag = '"stale"' if rng.random() < 0.1 else sequential.user_etag(name, max(version, 0))
        mask = rng.choice([["display_name"], ["email"], ["display_name", "email"], ["uid"], [], ["nope"], ["email", "name"]])
        rows.append((rid, START + timedelta(minutes=rid // 3), name, etag, mask,
                     rng.choice(["x", f"  Name {rid} ", f"Name {rid}"]), rng.choice(["", f" m{rid}@x"])))
    return users, rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_one_by_one_handling(either, seed):
    users, rows = random_case(seed)
    outcomes = replay_updates(requests_of(either, rows), users_of(either, users))
    got = {r.request_id: (r.gate, r.display_name, r.email, r.aggregate_version) for r in outcomes.collect()}
    want = sequential.replay_updates(users, rows)
    assert got == want
    assert sum(w[0] is None for w in want.values()) > 10
    assert max(w[3] or 0 for w in want.values()) > 6


def test_snapshot_mode_lets_equal_etags_pass(spark):
    users = {"users/abcd": ("u", "Old name", "o@x", 4)}
    tag = sequential.user_etag("users/abcd", 4)
    rows = [(n, START, "users/abcd", tag, ["display_name"], f"Name {n}", "") for n in range(2)]
    requests, state = requests_of(spark, rows), users_of(spark, users)
    assert [r.aggregate_version for r in update_users(requests, state).collect()] == [5, 5]
    replayed = {r.request_id: r.gate for r in replay_updates(requests, state).collect()}
    assert replayed == {0: None, 1: "etag"}


def test_update_statuses_and_events(spark):
    users = {"users/abcd": ("u", "Old name", "o@x", 1)}
    tag = sequential.user_etag("users/abcd", 1)
    rows = [(0, START, "users/none", tag, [], "", ""), (1, START, "users/abcd", '"stale"', [], "", ""),
            (2, START, "users/abcd", tag, ["nope"], "", ""), (3, START, "users/abcd", tag, ["email"], "", " "),
            (4, START, "users/abcd", tag, ["uid"], "", ""), (5, START, "users/abcd", tag, ["groups"], "", "")]
    requests = requests_of(spark, rows).withColumn("groups", F.array(F.lit("groups/g")))
    outcomes = update_users(requests, users_of(spark, users))
    flat = {r.request_id: r for r in flat_status(outcomes, "request_id", "added_groups", "aggregate_version").collect()}
    assert [flat[n].code for n in range(6)] == [5, 10, 3, 3, 0, 0]
    assert flat[0].message == "User with name users/none does not exists."
    assert flat[1].detail == 'providedEtag="stale"'
    assert (flat[2].violation_fields, flat[3].violation_fields) == ("update_mask", "user.email")
    assert (flat[4].added_groups, flat[4].aggregate_version) == ([], 2)
    assert flat[5].added_groups == ["groups/g"]
    events = {r.seq: r for r in updated_events(outcomes).collect()}
    assert events[4].groups is None and events[5].added_groups == ["groups/g"] and events[4].display_name == "Old name"


def test_upsert_takes_one_route_per_request(either):
    users = {"users/abcd": ("u", "Old name", "o@x", 1)}
    tag = sequential.user_etag("users/abcd", 1)
    rows = [(0, START, "users/abcd", tag, ["email"], "", "new@x", "u", True),
            (1, START, "users/none", "", [], "Brand new", "n@x", "v", True),
            (2, START + timedelta(1), "users/none", "", [], "Brand new", "n@x", "v", True),
            (3, START, "users/gone", "", [], "Brand new", "n@x", "w", False),
            (4, START, "users/x", "", [], "Brand new", "n@x", "w", True),
            (5, START, "users/else", "", [], "Brand new", "n@x", "u", True)]
    outcomes = upsert_users(requests_of(either, rows, ", uid string, allow_missing boolean"), users_of(either, users))
    got = {r.request_id: (r.route, r.code, r.gate) for r in flat_status(outcomes, "request_id", "route", "gate").collect()}
    assert got == {0: ("update", 0, None), 1: ("create", 0, None), 2: ("create", 6, "uid"), 3: ("update", 5, "user"),
                   4: ("invalid", 3, "name"), 5: ("create", 6, "uid")}


def test_remove_group(either):
    users = users_of(either, {"users/abcd": ("u", "Name", "o@x", 7)})
    groups = either.createDataFrame([("users/abcd", n, g) for n, g in enumerate(["g1", "g2", "g1"])],
                                    "name string, position int, group_name string")
    rows = [(0, START, "users/none", "g1"), (1, START, "users/abcd", "g9"), (2, START, "users/abcd", "g1")]
    requests = conform(either.createDataFrame(
        rows, "request_id long, ts timestamp_ntz, user_name string, group_name string"), REMOVE_GROUP_REQUEST)
    outcomes = remove_groups(requests, users, groups)
    got = {r.request_id: (r.status.code, r.status.message, r.groups_left, r.aggregate_version) for r in outcomes.collect()}
    assert got == {0: (5, "User with name users/none does not exists.", None, None),
                   1: (5, "Group with name g9 does not exists.", None, None), 2: (0, "Group removed.", 1, 8)}
    assert [(r.name, r.group_name) for r in removed_events(outcomes).collect()] == [("users/abcd", "g1")]
