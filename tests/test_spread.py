"""Joins and running values give the same rows whether or not keys are treated as heavy."""

import random

import pytest
from pyspark.sql import Window, functions as F

from rosterfold.operators.ordered import CHUNK, OrderedRows, numbered, with_minimum
from rosterfold.operators.skew import heavy_keys, lookup


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        data.append((key, rng.randrange(40), i, rng.choice([None, 1, 2]), rng.choice([None, f"v{i}"])))
    return spark.createDataFrame(data, "key string, ts int, seq int, amount int, word string").repartition(4)


def plain(df):
    return sorted(map(repr, df.collect()))


def test_heavy_keys_are_found_with_their_pieces(heavy, rows):
    found = heavy_keys(rows, ["key"])
    pieces = {r.key: r._pieces for r in found.table.collect()}
    assert pieces["hot"] >= 20 and found.pieces == sum(pieces.values())
    assert all(rows.filter(F.col("key") == k).count() > 6 for k in pieces)


def test_small_inputs_are_not_looked_at(spark, rows):
    assert heavy_keys(rows, ["key"]) is None


def test_heavy_rows_are_cut_into_several_chunks(heavy, rows):
    chunked = OrderedRows.of(rows, ["key"], ["ts", "seq"]).df
    sizes = [r["count"] for r in chunked.filter("key = 'hot'").groupBy(CHUNK).count().collect()]
    assert len(sizes) > 5 and sum(sizes) == 134 and max(sizes) < 60


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_equals_join(heavy, spark, rows, how):
    right = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("k1", "uno"), ("none", "x")], "key string, label string")
    if how == "left":
        assert "_salt" in lookup(rows, right, ["key"], ["seq"])._jdf.queryExecution().toString()
    assert plain(lookup(rows, right, ["key"], ["seq"], how)) == plain(rows.join(F.broadcast(right), "key", how))


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_equal_a_window(either, rows, descending):
    got = OrderedRows.of(rows, ["key"], ["ts", "seq"], descending).running(
        sums={"total": F.col("amount"), "place": F.lit(1)}, lasts={"word_now": F.col("word")}).rows()
    order = [F.desc("ts"), F.desc("seq")] if descending else ["ts", "seq"]
    window = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({
        "total": F.coalesce(F.sum("amount").over(window), F.lit(0)), "place": F.sum(F.lit(1)).over(window),
        "word_now": F.last("word", ignorenulls=True).over(window)})
    assert plain(got.withColumn("total", F.coalesce("total", F.lit(0)))) == plain(want)


def test_columns_keep_their_order(heavy, rows):
    got = OrderedRows.of(rows.select("seq", "ts", "key"), ["key"], ["ts", "seq"]).running(sums={"n": F.lit(1)}).rows()
    assert got.columns == ["seq", "ts", "key", "n"]


def test_values_run_on_top_of_running_values(either, rows):
    scan = OrderedRows.of(rows, ["key"], ["ts", "seq"]).running(sums={"place": F.lit(1)})
    got = scan.running(lasts={"mark": F.when(F.col("amount") == 2, F.col("place"))}).rows()
    window = Window.partitionBy("key").orderBy("ts", "seq")
    want = rows.withColumn("place", F.sum(F.lit(1)).over(window)).withColumn(
        "mark", F.last(F.when(F.col("amount") == 2, F.col("place")), ignorenulls=True).over(window))
    assert plain(got) == plain(want)


def test_numbers_without_gaps(either, rows):
    got = numbered(rows, ["key"], ["ts", "seq"], "n").groupBy("key").agg(F.max("n").alias("top"), F.count("n").alias("c"))
    assert got.filter("top <> c").count() == 0


def test_minimum_per_key(either, rows):
    value = F.when(F.col("amount") == 2, F.struct("ts", "seq"))
    got = with_minimum(rows, ["key"], value, "least", ["seq"])
    want = rows.withColumn("least", F.min(value).over(Window.partitionBy("key")))
    assert plain(got) == plain(want)
