"""Shapley values of trees against their definition, and confident learning on planted flips."""

import itertools
import random
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ioloom.operators import attribution, models, noise


def known_value(nodes, x, known, at=0):
    prediction, rows, left, right, feature, threshold = nodes[at]
    if left < 0:
        return prediction
    if feature in known:
        return known_value(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][1] / rows * known_value(nodes, x, known, c) for c in (left, right))


def by_definition(trees, x, n):
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                w = factorial(k) * factorial(n - k - 1) / factorial(n)
                out[i] += w * sum(weight * (known_value(t, x, {*s, i}) - known_value(t, x, set(s))) for t, weight in trees)
    return out


def grown(rng, depth, n, rows=64):
    """A random tree as node arrays; features repeat along paths."""
    nodes = {}

    def go(rows, depth):
        at = len(nodes)
        nodes[at] = None
        if depth == 0 or rows < 2 or rng.random() < 0.1:
            nodes[at] = (rng.uniform(-2, 2), rows, -1, -1, -1, 0.0)
            return at
        some = rng.randint(1, rows - 1)
        feature, threshold = rng.randrange(n), rng.choice([-1.0, 0.0, 0.5, 1.0])
        left, right = go(some, depth - 1), go(rows - some, depth - 1)
        nodes[at] = (0.0, rows, left, right, feature, threshold)
        return at

    go(rows, depth)
    return nodes


def test_contributions_equal_the_definition_on_a_small_forest():
    rng = random.Random(4)
    trees = [(grown(rng, 4, 4), w) for w in (1.0, 0.1, 0.3)]
    leaves = [leaf for t, w in trees for leaf in attribution.leaves_of(t, w)]
    x = np.array([[rng.choice([-2.0, -1.0, 0.0, 0.25, 0.5, 2.0, float("nan"), float("inf")]) for _ in range(4)] for _ in range(40)])
    phi, base = attribution.contributions(x, leaves)
    for row, got in zip(x, phi, strict=True):
        assert got == pytest.approx(by_definition(trees, row, 4), abs=1e-12)
        assert base + got.sum() == pytest.approx(sum(w * known_value(t, row, set(range(4))) for t, w in trees), abs=1e-12)


def test_margins_are_those_of_the_fitted_trees(spark):
    rng = random.Random(1)
    rows = [(i, *(x := [rng.uniform(-1, 1) for _ in range(4)]), int((x[0] > 0) != (x[1] > 0.3)) if rng.random() < 0.95 else 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y int")
    fitted = models.fit(df, ["a", "b", "c", "d"], ["y"])
    forests = {"y": attribution.forest_of(fitted["y"], spark)}
    raw = {r.id: r.m for r in fitted["y"].transform(df).select("id", models.vector_to_array("r_y")[1].alias("m")).collect()}
    got = attribution.explain(df, "id", forests, ["a", "b", "c", "d"], 2).collect()
    assert len(got) == 600 and all(r.margin == pytest.approx(raw[r.id], abs=1e-9) for r in got)
    assert all(len(r.top) == 2 and abs(r.top[0].contribution) >= abs(r.top[1].contribution) for r in got)
    assert all((t.direction == "increases_risk") == (t.contribution > 0) for r in got for t in r.top if t.contribution)
    some = attribution.explain(df.withColumn("on", F.when(F.col("id") < 5, F.array(F.lit("y"))).otherwise(F.array(F.lit("z")))), "id", forests, ["a", "b", "c", "d"], detected="on")
    assert sorted(r.id for r in some.collect()) == list(range(5))
    ranked = attribution.mean_contributions(df, forests, ["a", "b", "c", "d"])
    assert {r.feature for r in ranked.filter("place <= 2").collect()} == {"a", "b"}
    rates = {r.dimension: (r.n_expected, r.n_matched, r.match_rate) for r in attribution.match_rate(ranked, 2, {"y": ["a", "b", "x"], "z": ["a"]}).collect()}
    assert rates == {"y": (3, 2, 2 / 3)}


def test_planted_flips_are_found_and_ties_are_not(spark):
    rng = random.Random(2)
    rows, flipped = [], set()
    for i in range(400):
        truth = i % 4 == 0
        p = min(max((0.9 if truth else 0.1) + rng.uniform(-0.08, 0.08), 0), 1)
        if i % 37 == 5:
            flipped.add(i)
            p = 0.99 if truth else 0.01
        rows += [(i, "d", int(truth) ^ (i in flipped), p), (i, "one class", 1, 0.2 + i / 1000)]
    got = noise.judged(spark.createDataFrame(rows, "id bigint, dimension string, label int, prob double"))
    assert {r.id for r in got.filter("noisy and dimension = 'd'").collect()} == flipped
    told = {r.dimension: (r.total, r.noisy, r.clean) for r in noise.report(got).collect()}
    assert told == {"d": (400, len(flipped), 400 - len(flipped)), "one class": (400, 0, 400), None: (400, len(flipped), 400 - len(flipped))}
    assert sum(r.estimated for r in noise.joint(got).filter("dimension = 'd'").collect()) == pytest.approx(1)
    tie = noise.judged(spark.createDataFrame([(1, "d", 1, 0.5), (2, "d", 0, 0.5)], "id bigint, dimension string, label int, prob double")).collect()
    assert all(r.confident == r.label and not r.noisy for r in tie)


def test_tables_give_what_direct_sums_give_and_only_detected_is_computed(spark, monkeypatch):
    rng = np.random.default_rng(3)
    leaves = [attribution.Leaf(float(v), (0, 2), (-np.inf, 0.2), (0.6, np.inf), (0.4, 0.7)) for v in rng.normal(size=3)] + [attribution.Leaf(1.5, (2,), (0.5,), (0.9,), (0.3,))]
    x = rng.random((50, 4))
    x[0, 0] = x[1, 2] = np.nan
    tabled = attribution.contributions(x, leaves)
    seen, direct = [], attribution._of_leaf
    monkeypatch.setattr(attribution, "TABLED", 0)
    monkeypatch.setattr(attribution, "_of_leaf", lambda leaf, passed: seen.append(len(passed)) or direct(leaf, passed))
    assert np.array_equal(tabled[0], attribution.contributions(x, leaves)[0]) and seen == [50] * 4
    # Features 1 and 3 are asked for by no tree; the first of them still fills a place of the top, and no dimension but the detected ones appears.
    df = spark.createDataFrame([(1, ["p"], 0.1, 5.0, 0.8, 7.0), (2, [], 0.1, 5.0, 0.8, 7.0), (3, ["q", "p"], 0.9, 6.0, 0.1, 7.0), (4, None, 0.1, 5.0, 0.8, 7.0)], "id bigint, on array<string>, a double, b double, c double, d double")
    out = attribution.explain(df, "id", {"p": leaves, "q": leaves[:1]}, ["a", "b", "c", "d"], 3, "on")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.dimension): [t.feature for t in r.top] for r in out.collect()}
    assert set(got) == {(1, "p"), (3, "q"), (3, "p")} and all(set(f) == {"a", "b", "c"} for f in got.values())
