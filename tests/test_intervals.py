import random

import pytest
from pyspark.sql import functions as F

from rosterfold.operators import folds
from rosterfold.operators.intervals import open_at
from rosterfold.schemas import USER_EVENT_ORDER
from test_folds import log_of, random_events


def frames(spark, points, spans):
    return (spark.createDataFrame(points, "key string, at int, id int"), spark.createDataFrame(spans, "key string, since int, until int, label int"))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_with_all(either, seed):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
    points = [(key(), rng.randrange(60), n) for n in range(150)]
    spans = []
    for n in range(150):
        since = rng.randrange(-3, 63)
        spans.append((key(), since, rng.choice([None, since, since + rng.randrange(40)]), n))
    got = sorted((r.key, r.id, r.label) for r in open_at(*frames(either, points, spans), ["key"], "at", "since", "until").collect())
    want = sorted((k, i, n) for k, at, i in points for k2, since, until, n in spans if k == k2 and since <= at and (until is None or at < until))
    assert got == want and len(want) > 300


def test_short_spans_of_one_key_are_not_paired_with_all_its_points(spark):
    n = 3000  # all pairs would be nine million
    points, spans = frames(spark, [("hot", k, k) for k in range(n)], [("hot", k, k + 2, k) for k in range(n)])
    rows = open_at(points, spans, ["key"], "at", "since", "until")
    assert rows.count() == 2 * n - 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_points_and_no_spans(spark):
    for points, spans in (([], [("a", 1, 2, 3)]), ([("a", 1, 1)], [])):
        assert open_at(*frames(spark, points, spans), ["key"], "at", "since", "until").collect() == []


def test_state_at_takes_the_last_state(either):
    rows = random_events(41)
    log = log_of(either, rows)
    history = folds.user_history(log)
    places = log.select("name", *USER_EVENT_ORDER, F.col("seq").alias("id"))
    want = {r.seq: (r.aggregate_version, r.display_name) for r in history.collect()}
    got = {r.id: (r.aggregate_version, r.display_name) for r in folds.state_at(history, places, ["aggregate_version", "display_name"]).collect()}
    assert got == want
