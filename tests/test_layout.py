"""Folds and joins by the key of a laid-out table need no exchange."""

from pyspark.sql import functions as F

from rosterfold.checks import registry
from rosterfold.operators import folds
from rosterfold.schemas import USER_EVENT_ORDER
from rosterfold.sources import layout
from test_folds import log_of, random_events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = registry.laid_out_state(spark, "/root/testdata/sf0.001")
        assert "Exchange" not in plan(state) and "SortMergeJoin" in plan(state)
        assert state.count() > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_the_same_and_one_file_holds_a_bucket(spark, tmp_path):
    log = log_of(spark, random_events(51))
    table = layout.laid_out(log, "events", "name", USER_EVENT_ORDER, 4, str(tmp_path / "t"))
    assert sorted(map(repr, table.collect())) == sorted(map(repr, log.collect()))
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 4
    history = folds.user_history(table)
    assert "Exchange" not in plan(history) and "Exchange" in plan(folds.user_history(log))
    assert sorted(map(repr, history.collect())) == sorted(map(repr, folds.user_history(log).collect()))
    assert table.groupBy("name").agg(F.count("*")).count() == log.select("name").distinct().count()
