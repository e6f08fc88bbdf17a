"""The band join of points and intervals against all pairs, with one key, bins of few seconds and intervals longer than a bin."""

import random

import pytest

from ioloom.operators import relate


@pytest.mark.parametrize("width", [7, 86_400])
def test_nearest_interval_equals_all_pairs(spark, width):
    rng = random.Random(width)
    points = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([rng.randint(-50, 400), None])) for i in range(150)]
    steps = [(rng.choice(["hot", "b"]), s := rng.randint(-60, 380), s + rng.choice([0, 3, 40, 200, -30])) for _ in range(40)] + [("hot", None, 5)]
    got = relate.nearest_interval(spark.createDataFrame(points, "id int, k string, t bigint"), spark.createDataFrame(steps, "k string, s bigint, e bigint"), "k", "t", "s", "e", 5, "id", width)
    want = {}
    for i, k, t in points:
        fits = [(abs(t - e), s, e) for key, s, e in steps if key == k and t is not None and s is not None and s - 5 <= t <= e + 5]
        if fits:
            gap, s, _ = min(fits)
            want[i] = (gap, s)
    assert {r.id: (abs(r.t - r.step_end), r.step_start) for r in got.collect()} == want and len(want) > 30
