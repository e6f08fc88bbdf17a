"""Forests grown side by side: splits against a plain search, bags, the same forests however rows are dealt, and Spark ML's importances."""

import numpy as np
from pyspark.sql import functions as F

from ioloom.operators import forest, models

FEATURES, DIMS = ["a", "b", "c", "d", "e", "f"], ["p", "q", "none"]


def _rows(spark, n=3000):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 10 for i in range(len(FEATURES) - 1)]
    df = spark.range(n).select("id", *[v.alias(f) for v, f in zip(x, FEATURES[:-1], strict=True)], F.lit(7.0).alias("f"), F.lit("rules").alias("label_source"))
    return df.select("*", ((F.col("a") > 60) & (F.col("b") < 50)).cast("int").alias("p"), (F.col("c") + F.col("a") / 4 > 80).cast("int").alias("q"), F.lit(0).alias("none"))


def test_forests_are_the_same_however_rows_are_dealt(spark):
    df, got = _rows(spark), []
    for dealt in (df.coalesce(1), df.repartition(7, "a")):
        fitted = forest.fit(dealt, "id", FEATURES, DIMS, trees=6, depth=4)
        assert list(fitted) == ["p", "q"]  # no model where a class is missing
        got.append({d: [t.splits for t in trees] for d, trees in fitted.items()})
    assert got[0] == got[1]


def test_importances_are_near_those_of_spark_ml(spark):
    df = _rows(spark).persist()
    ours = forest.importances(forest.fit(df, "id", FEATURES, DIMS))
    theirs = {d: m.stages[-1].featureImportances.toArray() for d, m in models.fit(df, FEATURES, DIMS, "forest").items()}
    for d in ("p", "q"):
        assert np.isclose(ours[d].sum(), 1) and ours[d][5] == 0 and np.abs(ours[d] - theirs[d]).max() < 0.1, (d, ours[d], theirs[d])
        assert list(np.argsort(-ours[d])[:2]) == list(np.argsort(-theirs[d])[:2])
    df.unpersist()


def test_a_tree_is_the_one_that_a_plain_search_grows(spark):
    df = _rows(spark, 400)
    rows = df.select(F.xxhash64("id").alias("h"), "q", *FEATURES).toPandas()
    cuts = [forest.edges(rows[f].to_numpy()) for f in FEATURES]
    bins = np.stack([np.searchsorted(c, rows[f]) for c, f in zip(cuts, FEATURES, strict=True)])
    y, times = rows["q"].to_numpy(), forest.bags(rows["h"].to_numpy(), 3)
    weight = min((len(y) - y.sum()) / y.sum(), 100.0)
    gini = lambda w, k: 1 - sum((w[(y == c) & k].sum() / w[k].sum()) ** 2 for c in (0, 1))
    for t, tree in enumerate(forest.fit(df, "id", FEATURES, ["q"], trees=3, depth=3)["q"]):
        w, todo, seen = times[t] * np.where(y == 1, weight, 1.0), [(1, times[t] > 0)], 0
        while todo:
            i, here = todo.pop()
            gains = {}
            for f in np.random.default_rng([forest.SEED, t, i]).choice(6, 3, replace=False):
                for cut in range(len(cuts[f])):
                    left, right = here & (bins[f] <= cut), here & (bins[f] > cut)
                    if left.any() and right.any():
                        gains[int(f), cut] = gini(w, here) - (w[left].sum() * gini(w, left) + w[right].sum() * gini(w, right)) / w[here].sum()
            best = max(gains.values(), default=0)
            if i in tree.splits:
                f, cut, gain, total = tree.splits[i]
                assert np.isclose(gain, best) and np.isclose(gains[f, cut], best) and np.isclose(total, w[here].sum())
                seen += 1
                todo += [(2 * i, here & (bins[f] <= cut)), (2 * i + 1, here & (bins[f] > cut))]
            else:
                assert best < 1e-12 or i >= 8 or gini(w, here) < 1e-12
        assert seen == len(tree.splits) > 1


def test_edges_and_bags():
    assert list(forest.edges(np.array([3.0, 1.0, 1.0, np.nan, 2.0]))) == [1.5, 2.5] and not len(forest.edges(np.zeros(9)))
    v = np.random.default_rng(1).normal(size=5000)
    sizes = np.bincount(np.searchsorted(forest.edges(v), v))
    assert len(sizes) == forest.BINS and sizes.min() > 140 and sizes.max() < 172
    heavy = np.concatenate([np.zeros(9000), np.arange(1.0, 1001.0)])
    assert len(forest.edges(heavy)) == forest.BINS - 1  # a frequent value takes no bins from the others
    times = np.stack(forest.bags(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 200_000), 7))
    assert times.shape == (7, 200_000) and np.allclose(times.mean(axis=1), 1, atol=0.02) and np.allclose(times.var(axis=1), 1, atol=0.03)
    assert np.abs(np.corrcoef(times) - np.eye(7)).max() < 0.02


def test_a_feature_is_pruned_where_both_leaves_say_the_same():
    tree = forest.Tree(0, 4)
    tree.splits, tree.said = {1: (0, 3, 0.2, 10.0), 2: (1, 3, 0.1, 6.0), 3: (2, 1, 0.1, 4.0)}, {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    assert np.allclose(tree.importances(), [2 / 2.4, 0, 0.4 / 2.4, 0])
