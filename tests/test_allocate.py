import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import sequential
from rosterfold.functions.status import flat_status
from rosterfold.operators.allocate import allocated
from rosterfold.operators.folds import last_write
from rosterfold.plans.users import create_users, created_events, releases, seen_counts
from rosterfold.schemas import CREATE_USER_REQUEST, conform

START = datetime(2024, 1, 1)
COLUMNS = "request_id long, ts timestamp_ntz, uid string, user_id string, display_name string, email string"


def requests_of(spark, rows):
    return conform(spark.createDataFrame(rows, COLUMNS), CREATE_USER_REQUEST)


def random_requests(seed, size=150, uids=14, ids=12):
    rng = random.Random(seed)
    rows = []
    for rid in rng.sample(range(10_000), size):
        uid = "uid-hot" if rng.random() < 0.3 else rng.choice(["", *[f"uid-{n}" for n in range(uids)]])
        user_id = rng.choice(["ab", "Bad_Name", *[f"user-{n}" for n in range(ids)]])
        rows.append((rid, START + timedelta(minutes=rng.randrange(60)), uid, user_id,
                     rng.choice([" x ", " Some Name "]), rng.choice(["  ", "a@b.c", "a@b.c", "a@b.c"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_equal_one_by_one_handling(either, seed):
    rows = random_requests(seed)
    got = {r.request_id: r.gate for r in create_users(requests_of(either, rows)).select("request_id", "gate").collect()}
    assert got == sequential.create_users(rows)


def test_users_that_exist_already_block_both_keys(either):
    rows = random_requests(5)
    held = [("uid-1", "user-zz"), ("uid-zz", "user-3")]
    outcomes = create_users(requests_of(either, rows), either.createDataFrame(held, "uid string, user_id string"))
    assert {r.request_id: r.gate for r in outcomes.select("request_id", "gate").collect()} == \
        sequential.create_users(rows, held)


def test_a_refused_request_frees_its_keys(spark):
    rows = [(1, START, "u", "name-one", "x", "e"),            # fields fail, so uid and user id stay free
            (2, START + timedelta(1), "u", "ab", "Good", "e"),  # format fails
            (3, START + timedelta(2), "u", "name-one", "Good", "e"),
            (4, START + timedelta(3), "v", "name-one", "Good", "e"),
            (5, START + timedelta(4), "u", "name-two", "Good", "e")]
    outcomes = create_users(requests_of(spark, rows))
    flat = {r.request_id: r for r in flat_status(outcomes, "request_id", "name", "etag", "aggregate_version").collect()}
    assert [flat[n].code for n in range(1, 6)] == [3, 3, 0, 6, 6]
    assert flat[1].violation_fields == "user.displayName" and flat[2].violation_fields == "userId"
    assert (flat[3].name, flat[3].aggregate_version) == ("users/name-one", 1)
    assert flat[3].etag == sequential.user_etag("users/name-one", 1)
    assert (flat[4].message, flat[4].detail) == ("User Id is taken.", "userId=name-one")
    assert (flat[5].message, flat[5].reason) == ("User already exists.", "User with uid u already exists.")
    uids, ids = releases(outcomes)
    assert sorted(r.request_id for r in uids.collect()) == [1, 2, 4]
    assert [r.request_id for r in ids.collect()] == [1]
    assert created_events(outcomes).count() == 1


@pytest.mark.parametrize("size", [60, 100_000])
def test_a_long_chain_is_decided_by_doubling(spark, monkeypatch, size):
    """Request n shares one key with request n-1 and the other with n+1: every outcome hangs on all before it."""
    from rosterfold.operators import allocate

    rounds = []
    monkeypatch.setattr(allocate, "_granted", lambda *a, f=allocate._granted: (rounds.append(1), f(*a))[1])
    n = F.col("id")
    df = spark.range(size).select(n.alias("request_id"), F.timestamp_seconds(n).cast("timestamp_ntz").alias("ts"),
                                  F.concat(F.lit("uid-"), F.floor(n / 2)).alias("uid"), F.concat(F.lit("user-"), F.floor((n + 1) / 2)).alias("user_id"))
    got = allocated(df, "uid", "user_id", ["ts", "request_id"])
    assert sorted(r.request_id for r in got.collect()) == list(range(0, size, 2)) and len(rounds) == 1


@pytest.mark.parametrize("seed", range(3))
def test_dense_pairs_equal_one_by_one_handling(spark, seed):
    rng = random.Random(seed)
    pairs = [(n, rng.randrange(25), rng.randrange(25)) for n in range(300)]
    taken, want = (set(), set()), []
    for n, a, b in pairs:
        if a not in taken[0] and b not in taken[1]:
            taken[0].add(a)
            taken[1].add(b)
            want.append(n)
    got = allocated(spark.createDataFrame(pairs, "n int, a int, b int"), "a", "b", ["n"])
    assert sorted(r.n for r in got.collect()) == want


def test_counts_and_releases_make_the_last_write_table(spark):
    rows = random_requests(9)
    requests = requests_of(spark, rows)
    outcomes = create_users(requests)
    writes = seen_counts(requests, "uid").withColumn("step", F.lit(0)).unionByName(
        releases(outcomes)[0].withColumn("step", F.lit(1)))
    got = {r.uid: r.value for r in last_write(writes, "uid", "value", ["ts", "request_id", "step"]).collect()}
    gates, want, seen = sequential.create_users(rows), {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        seen[r[2]] = seen.get(r[2], 0) + 1
        want[r[2]] = 0 if gates[r[0]] in ("user_id_format", "user_id", "fields") else seen[r[2]]
    assert got == want
