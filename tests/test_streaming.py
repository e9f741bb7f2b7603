import random
from datetime import datetime

from pyspark.sql import functions as F

import sequential
from rosterfold.operators import folds, summaries
from rosterfold.plans import directory, removals
from rosterfold.plans.users import remove_groups
from rosterfold.sources import tables
from rosterfold.streaming import jobs, stateful
from rosterfold.streaming.tables import BatchTable
from rosterfold.schemas import CREATE_USER_REQUEST, USER_EVENT, conform
from test_allocate import random_requests, requests_of
from test_folds import log_of, random_events
from test_invitations import decisions_of, stored_of


def test_user_fold_in_batches_equals_one_fold(spark, tmp_path):
    rows = sorted(random_events(11), key=sequential.event_place)
    want = {r.name: r for r in folds.user_snapshot(folds.user_history(log_of(spark, rows))).collect()}
    for parts in (1, 3):
        root = str(tmp_path / f"p{parts}")
        work, changes, state = jobs.user_fold(spark, root)
        for part in range(parts):
            stretch = rows[part * len(rows) // parts:(part + 1) * len(rows) // parts]
            log_of(spark, stretch).write.mode("append").parquet(f"{root}/in")
            jobs.run_to_end(tables.read_stream(spark, f"{root}/in", USER_EVENT), f"{root}/progress", work)
        got = {r.name: r for r in state.current(["name"]).collect()}
        assert {n: (r.aggregate_version, r.display_name, r.etag) for n, r in got.items()} == {
            n: (r.aggregate_version, r.display_name, r.etag) for n, r in want.items()}
        assert changes.rows().count() == sum(v is not None for v, _ in sequential.fold_users(rows)[0].values())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = sorted(random_events(12, size=80), key=sequential.event_place)
    work, changes, state = jobs.user_fold(spark, str(tmp_path))
    work(log_of(spark, rows[:40]), 0)
    work(log_of(spark, rows[40:]), 1)
    before = sorted(map(repr, changes.rows().collect())), sorted(map(repr, state.current(["name"]).collect()))
    work(log_of(spark, rows[40:]), 1)
    assert before == (sorted(map(repr, changes.rows().collect())), sorted(map(repr, state.current(["name"]).collect())))


def test_compacted_state_reads_the_same(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "name string, v int")
    for number in range(4):
        table.write(spark.createDataFrame([(f"k{n}", number) for n in range(number + 1)], "name string, v int"), number)
        if number == 1:
            table.compact(["name"], number)

    def state(*args):
        return {r.name: r.v for r in table.current(["name"], *args).collect()}

    assert state() == {"k0": 3, "k1": 3, "k2": 3, "k3": 3} and state(2) == {"k0": 1, "k1": 1} and state(1) == {"k0": 0}
    assert state(None, spark.createDataFrame([("k1",), ("zz",)], "name string")) == {"k1": 3}


def test_create_requests_in_batches_equal_one_run(spark, tmp_path):
    rows = sorted(random_requests(13), key=lambda r: (r[1], r[0]))
    work, outcomes, held = jobs.user_requests(spark, str(tmp_path))
    for number in range(3):
        work(requests_of(spark, rows[number * 50:(number + 1) * 50]), number)
    want = sequential.create_users(rows)
    assert {r.request_id: r.gate for r in outcomes.rows().collect()} == want
    assert held.current(["uid"]).count() == sum(gate is None for gate in want.values())


def test_tables_by_type_and_changelog(spark, tmp_path):
    rows = random_events(14, size=60)
    log = log_of(spark, rows)
    for _ in range(2):  # a repeated run leaves the same rows
        tables.write_events(log, str(tmp_path / "events"), "r1")
    back = tables.read_events(spark, {kind: str(tmp_path / "events" / f"event_type={kind}")
                                      for kind in {r[3] for r in rows}}, USER_EVENT)
    assert sorted(map(repr, back.drop("display_name").collect())) == sorted(map(repr, log.drop("display_name").collect()))
    tables.write_table(folds.user_history(log), str(tmp_path / "history"))
    current = tables.current_state(spark.read.parquet(str(tmp_path / "history")))
    want = {r.name: r.aggregate_version for r in folds.user_snapshot(folds.user_history(log)).collect()}
    assert {r.name: r.aggregate_version for r in current.collect()} == want


def test_old_batches_are_deleted_and_unfinished_ones_not_read(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "name string, v int")
    for number in range(60):
        table.write(spark.createDataFrame([(f"k{number % 7}", number)], "name string, v int").coalesce(1), number)
        if (number + 1) % 20 == 0:
            table.compact(["name"], number)
    assert {r.name: r.v for r in table.current(["name"]).collect()} == {f"k{n % 7}": n for n in range(53, 60)}
    assert {r.name: r.v for r in table.current(["name"], 59).collect()} == {f"k{n % 7}": n for n in range(52, 59)}
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "t").iterdir())
    assert left == list(range(40, 60)) and sorted(p.name for p in (tmp_path / "t-compacted").iterdir()) == ["upto=39", "upto=59"]
    (tmp_path / "t" / "batch_id=60").mkdir()
    (tmp_path / "t" / "batch_id=60" / "part-0.parquet").write_bytes(b"unfinished")
    assert {r.name for r in table.current(["name"]).collect()} == {f"k{n}" for n in range(7)}


def test_malformed_records_are_kept_apart(spark):
    records = spark.createDataFrame(
        [("a", '{"request_id": 1, "uid": "u"}', datetime(2024, 1, 1)), ("b", "not json", datetime(2024, 1, 1)), ("c", None, datetime(2024, 1, 1))],
        "key string, value string, timestamp timestamp")
    assert [(r.request_id, r.uid, r.ts is None) for r in tables.well_formed(records, CREATE_USER_REQUEST).collect()] == [(1, "u", False)]
    assert sorted((r.key, r.value) for r in tables.malformed(records, CREATE_USER_REQUEST).collect()) == [("b", "not json"), ("c", "")]


def test_an_absent_table_is_empty(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "none"), "name string")
    assert table.rows().count() == 0 and table.current(["name"]).columns == ["name"]
    table.write(spark.createDataFrame([("a",)], "name string").withColumn("at", F.lit(datetime(2024, 1, 1))), 3)
    assert table.before(3).count() == 0 and table.rows().count() == 1


def test_a_split_table_opens_only_the_parts_of_wanted_keys(spark, tmp_path):
    plain, split = BatchTable(spark, str(tmp_path / "a"), "name string, v int"), BatchTable(spark, str(tmp_path / "b"), "name string, v int", split="name")
    for number in range(6):
        rows = spark.createDataFrame([(f"k{n}", 100 * number + n) for n in range(number, 60)], "name string, v int")
        for table in (plain, split):
            table.write(rows, number)
            if number == 3:
                table.compact(["name"], number)
    wanted = spark.createDataFrame([("k7",), ("k8",), ("zz",)], "name string")
    for before in (None, 5, 3):
        for keys in (None, wanted):
            rows = [sorted(map(tuple, table.current(["name"], before, keys).collect())) for table in (plain, split)]
            assert rows[0] == rows[1] and len(rows[0]) == (60 if keys is None else 2)
    # The compacted table and the two batches after it, each with the parts of at most three keys.
    opened, every = split.stored(["name"], None, wanted).inputFiles(), split.stored(["name"]).inputFiles()
    assert 0 < len(opened) <= 9 < len(every)
    parts = {r["part"] for r in wanted.select(split._part().alias("part")).collect()}
    assert {int(f.split("part=")[1].split("/")[0]) for f in opened} <= parts
    split.write(rows_of_no_key(spark), 6)
    assert split.current(["name"], None, wanted).count() == 2


def rows_of_no_key(spark):
    return spark.createDataFrame([], "name string, v int")


def test_create_requests_open_the_parts_of_their_keys(spark, tmp_path, monkeypatch):
    work, _, held = jobs.user_requests(spark, str(tmp_path))
    many = [(n, datetime(2024, 1, 1), f"uid-{n}", f"user-{n}", "Some name", "m@x") for n in range(200)]
    work(requests_of(spark, many), 0)
    opened = []
    read = BatchTable._read

    def counted(self, base, folders, parts=None):
        rows = read(self, base, folders, parts)
        if parts is not None:
            opened.append(len(rows.inputFiles()))
        return rows

    monkeypatch.setattr(BatchTable, "_read", counted)
    work(requests_of(spark, [(900, datetime(2024, 1, 2), "uid-3", "user-new", "Some name", "m@x"), (901, datetime(2024, 1, 2), "uid-new", "user-5", "Some name", "m@x")]), 1)
    assert opened and max(opened) <= 2
    monkeypatch.undo()
    assert held.stored(["uid"]).select("uid").distinct().count() == 200


def test_index_is_kept_incrementally(spark, tmp_path):
    rng = random.Random(5)
    rows = [(datetime(2024, 1, 1 + k // 20), k, f"users/{rng.choice('aab')}/groupInvitations/i{k}", "GroupInvitationCreated", f"r{k}") for k in range(90)]
    frame = lambda part: conform_invitations(spark, part)
    work, index = jobs.invitation_index(spark, str(tmp_path))
    for number, start in enumerate(range(0, 90, 30)):
        work(frame(rows[start:start + 30]), number)
        work(frame(rows[start:start + 30]), number)  # repeated
    want = sorted(map(tuple, folds.invitation_index(frame(rows)).collect()))
    assert sorted(map(tuple, index().collect())) == want
    one = spark.createDataFrame([("users/b",)], "parent string")
    assert sorted(map(tuple, index(one).collect())) == [r for r in want if r[0] == "users/b"]
    # A batch writes rows of its own parents only, and no ordinal changes.
    work(frame([(datetime(2024, 2, 1), 99, "users/b/groupInvitations/last", "GroupInvitationCreated", "r99")]), 3)
    assert [p.name for p in (tmp_path / "index_counts" / "batch_id=3").glob("part=*")] == [p.name for p in (tmp_path / "index_entries" / "batch_id=3").glob("part=*")]
    assert [r.name for r in index(one).filter("position = 1").collect()] == ["users/b/groupInvitations/last"]


def conform_invitations(spark, rows):
    from rosterfold.schemas import INVITATION_EVENT, conform

    return conform(spark.createDataFrame(rows, "ts timestamp_ntz, seq long, name string, event_type string, request_id string"), INVITATION_EVENT)


def plain(df):
    return sorted(map(repr, df.collect()))


def test_summaries_merge_in_any_order(spark):
    rng, rows = random.Random(21), random_events(21, size=240)
    want = plain(folds.user_groups(log_of(spark, rows)))
    for parts in (2, 5):
        rng.shuffle(rows)
        pieces = [summaries.summary(log_of(spark, rows[k::parts])) for k in range(parts)]
        forward = pieces[0]
        for piece in pieces[1:]:
            forward = summaries.merged(forward.unionByName(piece))
        backward = pieces[-1]
        for piece in reversed(pieces):  # the last one twice
            backward = summaries.merged(piece.unionByName(backward))
        assert plain(forward) == plain(backward)
        assert plain(summaries.lists(forward)) == want
        assert forward.count() < len(rows)


def test_group_lists_read_compacted_summaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    rows = sorted(random_events(22, size=120), key=sequential.event_place)
    work, read, table = jobs.user_group_lists(spark, str(tmp_path))
    for number in range(5):
        work(log_of(spark, rows[number * 24:(number + 1) * 24]), number)
    work(log_of(spark, rows[96:]), 4)
    want = folds.user_groups(log_of(spark, rows))
    assert plain(read()) == plain(want)
    one = spark.createDataFrame([("users/hot1",)], "name string")
    assert plain(read(one)) == plain(want.filter("name = 'users/hot1'"))
    # Batches before the compaction before last are gone, so nothing reads the whole log.
    assert sorted(p.name for p in (tmp_path / "group_summaries").glob("batch_id=*")) == ["batch_id=2", "batch_id=3", "batch_id=4"]
    assert table.current(["name"]).count() > 0


def test_counts_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    rows = sorted(random_requests(31), key=lambda r: (r[1], r[0]))
    counted, work, table = stateful.counts(spark, str(tmp_path), "uid")
    for number in range(3):
        requests_of(spark, rows[number * 50:(number + 1) * 50]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tables.read_stream(spark, str(tmp_path / "in"), CREATE_USER_REQUEST)
        stateful.run_to_end(counted(stream), str(tmp_path / "progress"), work)  # a new query each time
    want = {}
    for row in rows[:150]:
        want[row[2]] = want.get(row[2], 0) + 1
    assert {r.uid: r.value for r in table.current(["uid"]).collect()} == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").count("RocksDB") == 0


def test_keyed_state_equals_the_fold(spark, tmp_path):
    rows = sorted(random_events(33), key=sequential.event_place)
    folded, work, table = stateful.user_state(spark, str(tmp_path))
    for number in range(3):
        log_of(spark, rows[number * 100:(number + 1) * 100]).write.mode("append").parquet(str(tmp_path / "in"))
        stateful.run_to_end(folded(tables.read_stream(spark, str(tmp_path / "in"), USER_EVENT)), str(tmp_path / "progress"), work)
    want = {r.name: (r.aggregate_version, r.display_name, r.etag) for r in folds.user_snapshot(folds.user_history(log_of(spark, rows))).collect()}
    assert {r.name: (r.aggregate_version, r.display_name, r.etag) for r in table.current(["name"]).collect()} == want
    assert any(r.before for r in [table.before(1).groupBy().agg(F.count("*").alias("before")).first()])


def test_one_call_of_the_processor_folds_many_users(spark, tmp_path):
    rows = sorted(random_events(34), key=sequential.event_place)

    class Value:
        state = None

        def get(self):
            return self.state

        def update(self, state):
            self.state = state

    fold, got = stateful.UserFold(), {}
    fold.users = Value()
    for number in range(3):
        events = log_of(spark, rows[number * 100:(number + 1) * 100]).toPandas()
        for changed in fold.handleInputRows((0,), iter([events[:40], events[40:]]), None):
            got.update({r.name: (r.aggregate_version, r.display_name) for r in changed.itertuples()})
    want = folds.user_snapshot(folds.user_history(log_of(spark, rows))).collect()
    assert got == {r.name: (r.aggregate_version, r.display_name) for r in want} and len(got) > 1
    assert sorted(fold.users.state[0]) == sorted(got)


def test_decisions_in_batches_send_the_state_once(spark, tmp_path, monkeypatch):
    rng = random.Random(35)
    names = [f"users/a/groupInvitations/i{n}" for n in range(20)]
    states = {n: (rng.choice(["PENDING", "PENDING", "ACCEPTED"]), rng.choice([1, 3])) for n in names}
    rows = []
    for n in range(150):
        name = rng.choice([*names, "users/a/groupInvitations/none"])
        tag = sequential.invitation_etag(name, states.get(name, ("", 1))[1] + rng.choice([0, 0, 1]))
        rows.append((f"r{n:03}", datetime(2024, 1, 1 + n // 10), name, tag, rng.choice(["ACCEPTED", "REJECTED"])))
    start = stored_of(spark, states)

    def unwanted(df, label):
        raise AssertionError(label)

    monkeypatch.setattr(jobs, "pinned", unwanted)
    work, outcomes, _ = jobs.decision_requests(spark, str(tmp_path), lambda: start)
    for number in (0, 1, 1, 2):
        work(decisions_of(spark, rows[number * 50:(number + 1) * 50]), number)
    assert {r.request_id: r.gate for r in outcomes.rows().collect()} == sequential.replay_decisions(states, rows)


def test_rows_arrive_in_stretches(spark, tmp_path):
    from rosterfold.checks.registry import _replayed

    rows = sorted(random_events(36), key=sequential.event_place)
    seen = []
    _replayed(log_of(spark, rows), str(tmp_path), USER_EVENT, lambda batch, number: seen.append(sorted((r.ts, r.seq) for r in batch.select("ts", "seq").collect())))
    assert sorted(sum(seen, [])) == sorted((r.ts, r.seq) for r in log_of(spark, rows).collect())
    assert len(seen) > 1 and all(a[-1][0] < b[0][0] for a, b in zip(seen, seen[1:]))
    assert not list(tmp_path.glob("arriving/*/*.parquet"))


def test_ordered_removals_in_batches(either, tmp_path):
    rng = random.Random(21)
    rows = sorted(random_events(21), key=sequential.event_place)
    times = [row[0] for row in rows]
    asked = [(n, rng.choice(times), rng.choice(["users/hot1", "users/c1", "users/c2", "users/none"]), rng.choice(["g0", "g1", "g2", "g9"])) for n in range(1000, 1120)]
    requests = either.createDataFrame(asked, "request_id long, ts timestamp_ntz, user_name string, group_name string")
    events = log_of(either, rows)
    shown = ["request_id", "gate", "groups_left", "aggregate_version", "display_name", "etag"]
    want = {tuple(r) for r in directory.replay_removals(requests, events).select(*shown).collect()}
    assert {gate for _, gate, *_ in want} == {None, "user", "group"}
    asks = requests.select("ts", F.col("user_name").alias("name"), "group_name", F.col("request_id").alias("asked_id"), F.lit(jobs.REMOVE_ASKED).alias("event_type"))
    log = events.unionByName(asks, allowMissingColumns=True)
    work, outcomes, _ = jobs.ordered_removals(either, str(tmp_path))
    places = sorted(set(times))
    cuts = [places[0], places[len(places) // 3], places[2 * len(places) // 3], datetime(2999, 1, 1)]
    for batch_id in (0, 1, 1, 2):
        work(log.filter((F.col("ts") >= cuts[batch_id]) & (F.col("ts") < cuts[batch_id + 1])), batch_id)
    assert {tuple(r) for r in outcomes.rows().select(*shown).collect()} == want


def test_ordered_removals_keep_a_number_for_each_group(spark, tmp_path):
    at = [datetime(2024, 1, 1, hour) for hour in range(5)]
    event = "ts timestamp_ntz, seq long, name string, event_type string, group_name string, display_name string, groups array<string>, asked_id long"

    def batch(*rows):
        return conform(spark.createDataFrame(rows, event), jobs.MEMBER_LOG, keep_null=("groups",))

    work, outcomes, _ = jobs.ordered_removals(spark, str(tmp_path))
    work(batch((at[0], 1, "users/abcd", "UserCreated", None, "Name", ["g1"] * 50 + ["g2"] * 3 + ["g3"], None)), 0)
    held = lambda: spark.read.parquet(f"{tmp_path}/ordered_groups/batch_id=*")
    assert {(r.group_name, r.n) for r in held().collect()} == {("g1", 50), ("g2", 3), ("g3", 1)} and held().count() == 3
    work(batch((at[1], 2, "users/abcd", "GroupCreated", "g3", None, None, None), (at[2], 0, "users/abcd", jobs.REMOVE_ASKED, "g1", None, None, 7)), 1)
    work(batch((at[3], 3, "users/abcd", "UserUpdated", None, "New", ["g3"], None), (at[4], 0, "users/abcd", jobs.REMOVE_ASKED, "g2", None, None, 8),
               (at[4], 0, "users/abcd", jobs.REMOVE_ASKED, "g3", None, None, 9)), 2)
    assert {(r.request_id, r.gate, r.groups_left, r.aggregate_version) for r in outcomes.rows().collect()} == {
        (7, None, 5, 3), (8, "group", None, None), (9, None, 0, 5)}


def test_steps_of_ordinary_users_are_sent_once(spark):
    rows = log_of(spark, random_events(22))
    requests = spark.createDataFrame([], "request_id long, ts timestamp_ntz, user_name string, group_name string")
    done = removals.walked(removals.steps_of(rows, requests), spark.createDataFrame([], "name string, uid string, display_name string, email string, aggregate_version int"),
                           spark.createDataFrame([], "name string, group_name string, n long"), rows.select("name"))
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_removals_against_a_log(spark, tmp_path):
    rows = random_events(23, size=60)
    log = log_of(spark, rows)
    requests = spark.createDataFrame([(n, rows[0][0], name, f"g{n % 4}") for n, name in enumerate(["users/hot1", "users/none"] * 4)],
                                     "request_id long, ts timestamp_ntz, user_name string, group_name string")
    work, outcomes = jobs.remove_requests_of_log(spark, str(tmp_path), lambda: log)
    work(requests, 0)
    want = remove_groups(requests, folds.user_snapshot(folds.user_history(log)), folds.user_groups(log))
    shown = ["request_id", "gate", "groups_left", "aggregate_version", "etag"]
    assert {tuple(r) for r in outcomes.rows().select(*shown).collect()} == {tuple(r) for r in want.select(*shown).collect()}
