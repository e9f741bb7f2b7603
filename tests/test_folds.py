import random
from datetime import datetime, timedelta

import pytest

import sequential
from rosterfold.operators import folds
from rosterfold.plans import users
from rosterfold.schemas import INVITATION_EVENT, USER_EVENT, USER_EVENT_ORDER, conform

START = datetime(2024, 1, 1)
EVENT = ("ts timestamp_ntz, seq long, name string, event_type string, group_name string, display_name string, "
         "groups array<string>, added_groups array<string>")


def random_events(seed, size=300):
    rng = random.Random(seed)
    rows = []
    for seq in range(size):
        name = "users/hot1" if rng.random() < 0.4 else f"users/c{rng.randrange(8)}"
        kind = rng.choice(["UserCreated", *["UserUpdated"] * 2, *["GroupRemoved"] * 3, *["GroupCreated"] * 4,
                           *["GroupInvitationAccepted"] * 3])
        group = shown = groups = added = None
        pool = [f"g{n}" for n in range(4)]
        if kind == "UserCreated":
            shown, groups = f"Name {seq}", rng.choice([[], ["g1"], ["g1", "g2", "g1"]])
        elif kind == "UserUpdated":
            shown, groups = f"Name {seq}", rng.choice([None, None, [], ["g3"], ["g1", "g1"]])
            added = rng.choice([None, [], ["g2", "g2"]])
        else:
            group = rng.choice(pool)
        rows.append((START + timedelta(minutes=rng.randrange(50)), seq, name, kind, group, shown, groups, added))
    return rows


def log_of(spark, rows):
    return conform(spark.createDataFrame(rows, EVENT), USER_EVENT, keep_null=("groups", "display_name"))


@pytest.mark.parametrize("seed", [1, 2])
def test_user_history_and_snapshot(either, seed):
    rows = random_events(seed)
    want, _ = sequential.fold_users(rows)
    history = folds.user_history(log_of(either, rows))
    got = {(r.name, r.seq): (r.aggregate_version, r.display_name) for r in history.collect()}
    assert got == want
    assert folds.orphans(history).count() == sum(v is None for v, _ in want.values()) > 0
    latest = {}
    for _, seq, name, *_ in sorted(rows, key=sequential.event_place):
        if want[name, seq][0]:
            latest[name] = want[name, seq]
    snapshot = {r.name: r for r in folds.user_snapshot(history).collect()}
    assert {n: (r.aggregate_version, r.display_name) for n, r in snapshot.items()} == latest
    assert all(r.etag == sequential.user_etag(n, r.aggregate_version) for n, r in snapshot.items())


@pytest.mark.parametrize("seed", [3, 4])
def test_group_lists(either, seed):
    rows = random_events(seed)
    _, lists = sequential.fold_users(rows)
    got = {}
    for r in folds.user_groups(log_of(either, rows)).orderBy("name", "position").collect():
        got.setdefault(r.name, []).append(r.group_name)
    assert got == {name: steps[-1][1] for name, steps in lists.items() if steps[-1][1]}


def test_group_spans_give_the_list_at_every_version(either):
    rows = random_events(5, size=160)
    _, lists = sequential.fold_users(rows)
    places = {r[1]: sequential.event_place(r) for r in rows}
    spans = folds.group_spans(log_of(either, rows)).collect()
    for name, steps in lists.items():
        mine = sorted((s for s in spans if s.name == name), key=lambda s: (s.since_ts, s.since_rank, s.since_seq, s.ordinal))
        for seq, want in steps:
            now = places[seq]
            assert [s.group_name for s in mine if (s.since_ts, s.since_rank, s.since_seq) <= now
                    and (s.until_ts is None or now < (s.until_ts, s.until_rank, s.until_seq))] == want
    listed = {}
    for r in folds.groups_at(folds.group_spans(log_of(either, rows)), log_of(either, rows).select("name", *USER_EVENT_ORDER)).orderBy("position").collect():
        listed.setdefault(r.seq, []).append(r.group_name)
    assert listed == {seq: want for steps in lists.values() for seq, want in steps if want}


def test_history_continues_from_an_earlier_snapshot(either):
    rows = sorted(random_events(6), key=sequential.event_place)
    want, _ = sequential.fold_users(rows)
    prior = folds.user_snapshot(folds.user_history(log_of(either, rows[:120])))
    later = folds.user_history(log_of(either, rows[120:]), prior)
    assert {(r.name, r.seq): (r.aggregate_version, r.display_name) for r in later.collect()} == {
        (r[2], r[1]): want[r[2], r[1]] for r in rows[120:]}


def test_snapshot_equals_history_cut_at_any_point(spark):
    rows = sorted(random_events(7), key=sequential.event_place)
    history = folds.user_history(log_of(spark, rows))
    cut = sequential.event_place(rows[150])
    early = {r.name: r.aggregate_version for r in folds.user_snapshot(
        history.filter(f"struct(ts, event_rank, seq) <= struct(timestamp_ntz '{cut[0]}', {cut[1]}, {cut[2]}L)")).collect()}
    again = {r.name: r.aggregate_version for r in folds.user_snapshot(
        folds.user_history(log_of(spark, rows[:151]))).collect()}
    assert early == again


def invitation_rows():
    made, order = [], ("GroupInvitationCreated", "GroupInvitationAccepted", "GroupInvitationRejected")
    states = dict(zip(order, ("PENDING", "ACCEPTED", "REJECTED")))
    rng = random.Random(8)
    for seq in range(120):
        name = f"users/{'hot1' if seq % 3 else 'c%d' % (seq % 5)}/groupInvitations/i{rng.randrange(6)}"
        kind = rng.choice(order)
        made.append((START + timedelta(minutes=rng.randrange(30)), seq, name, kind, f"g{seq % 4}", states[kind]))
    return made


def test_invitation_history_snapshot_and_index(either):
    rows = invitation_rows()
    log = conform(either.createDataFrame(
        rows, "ts timestamp_ntz, seq long, name string, event_type string, group_name string, state string"), INVITATION_EVENT)
    want, version, names = {}, {}, {}
    order = ["GroupInvitationCreated", "GroupInvitationAccepted", "GroupInvitationRejected"]
    for _, seq, name, kind, group, state in sorted(rows, key=lambda r: (r[0], order.index(r[3]), r[1])):
        if kind == "GroupInvitationCreated":
            version[name] = 1
            names.setdefault("/".join(name.split("/")[:2]), []).insert(0, name)
        elif name in version:
            version[name] += 1
        want[seq] = (version.get(name), group, state)
    history = folds.invitation_history(log)
    assert {r.seq: (r.aggregate_version, r.group_name, r.state) for r in history.collect()} == want
    snapshot = {r.name: r.etag for r in folds.invitation_snapshot(history).collect()}
    assert snapshot == {n: sequential.invitation_etag(n, v) for n, v in version.items()}
    listed = {}
    created = log.filter("event_type = 'GroupInvitationCreated'")
    for r in folds.invitation_index(created).orderBy("parent", "position").collect():
        listed.setdefault(r.parent, []).append(r.name)
    assert listed == names


def test_names_without_a_parent_are_kept_apart(spark):
    log = spark.createDataFrame([(START, 1, 1, "", "odd"), (START, 1, 2, "", "users/a/groupInvitations/b")],
                                "ts timestamp_ntz, event_rank int, seq long, request_id string, name string")
    assert [r.parent for r in folds.invitation_index(log).collect()] == ["users/a"]
    assert [r.name for r in folds.unnamed_parents(log).collect()] == ["odd"]


def test_last_writer_wins_in_the_uid_map(spark):
    rows = spark.createDataFrame([("u", "old", 1, 1), ("u", "new", 1, 2), ("v", "only", 5, 1)],
                                 "uid string, name string, ts int, seq int")
    assert {r.uid: r.name for r in folds.uid_names(rows, ["ts", "seq"]).collect()} == {"u": "new", "v": "only"}


def test_the_log_of_asked_users(either):
    rows = random_events(3)
    requests = either.createDataFrame([(n, rows[0][0], name, "g1") for n, name in enumerate(["users/hot1", "users/hot1", "users/c1", "users/none"])],
                                      "request_id long, ts timestamp_ntz, user_name string, group_name string")
    log = log_of(either, rows)
    some = users.log_of_asked(log, requests)
    assert some.columns == log.columns
    assert sorted((r.name, r.seq) for r in some.collect()) == sorted((row[2], row[1]) for row in rows if row[2] in ("users/hot1", "users/c1"))
    outcomes = [{tuple(map(str, r)) for r in users.remove_groups(requests, folds.user_snapshot(folds.user_history(events)), folds.user_groups(events)).collect()}
                for events in (log, some)]
    assert outcomes[0] == outcomes[1] and len(outcomes[0]) == 4
