"""Places, running sums and percentiles by buckets against one window or percentile over the whole group."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ioloom.operators import order, prepare

HARD = [0.0, -0.0, 1e-320, -1e-320, 5e-300, 1.0, 1.0 + 1e-15, 1.0 - 1e-15, -1.0, 1e15, 1e15 + 1, 1.6e9, 1.6e9 + 1, 1e308, -1e308, math.inf, -math.inf]


@pytest.fixture(scope="module")
def rows(spark):
    made = [("hard", v) for v in HARD * 3] + [("none", None), (None, 2.0), (None, 3.0), ("one", 7.0), ("nan", math.nan), ("nan", 1.0)]
    made += [("times", 1.6e9 + (i * 7919) % 3001) for i in range(3000)] + [("hot", float(i % 3)) for i in range(3000)] + [("dense", 1 + i * 1e-9) for i in range(3000)]
    return spark.createDataFrame(made, "g string, v double").withColumn("id", F.monotonically_increasing_id()).persist()


@pytest.mark.parametrize("few", [False, True])
def test_percentiles_are_those_of_the_whole_group(spark, rows, few):
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r.g: r.q for r in order.percentiles(rows, ["g"], "v", shares, few).collect()}
    assert set(want) - set(got) == {"none"}
    assert {g: list(map(repr, q)) for g, q in got.items()} == {g: [repr(x + 0.0) for x in want[g]] for g in got}
    assert order.percentiles(rows.limit(0), ["g"], "v", shares, few).count() == 0


def test_steps_never_fall(spark, rows):
    steps = rows.filter("g = 'hard' or g = 'times'").select("v", order.step(F.col("v")).alias("s")).orderBy("v").collect()
    assert all(a.s <= b.s for a, b in zip(steps, steps[1:]))


def test_running_sums_are_those_of_one_window(spark, rows):
    counts = rows.filter("g is not null and g <> 'nan'").groupBy("g", "v").agg(F.count("*").alias("n"))
    whole = counts.withColumn("w", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = order.running(counts, "g", "v", ["n"])
    assert got.join(whole, ["g", "v", "n"]).filter("n_below <> w").count() == 0 and got.count() == counts.count()


def test_places_are_those_of_one_window(spark, rows):
    got = order.placed(rows, ["g"], prepare.hash_bucket("id"), [prepare.hash_order("id"), "id"])
    w = Window.partitionBy("g")
    both = got.withColumn("p", F.row_number().over(w.orderBy(prepare.hash_order("id"), "id")) - 1).withColumn("n", F.count("*").over(w))
    assert both.filter("_place <> p or _size <> n").count() == 0 and both.count() == rows.count()
