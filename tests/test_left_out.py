"""Thresholds for a left-out row, by step and label."""

from pyspark.sql import functions as F

from ioloom.operators import metrics


def test_left_out_thresholds_by_step_equal_their_definition(spark):
    rows = [(i, i * 7 % 3 % 2, (i * 37 % 100) / 100 if i % 9 else 0.5) for i in range(60)]
    df = spark.createDataFrame([(i, g, 0, p) for i, g, p in rows], "job_id long, gt_x int, pred_x int, prob_x double")
    grid = [0.2, 0.5, 0.8]
    got = {r.job_id: r.threshold for r in metrics.left_out_thresholds(df, ["x"], grid).collect()}
    for i, *_ in rows:
        others = [(g, p) for j, g, p in rows if j != i]
        f1 = lambda t: 2 * sum(g and p >= t for g, p in others) / ((sum(p >= t for _, p in others) + sum(g for g, _ in others)) or 1)  # noqa: E731, B023
        assert got[i] == min(grid, key=lambda t: (-f1(t), t))


def test_steps_of_a_grid(spark):
    values = [None, 0.1, 0.2, 0.25, 0.5, 0.8, 0.9, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(metrics._steps(F.col("v"), [0.2, 0.5, 0.8])).collect()] == [None, 0, 1, 1, 2, 3, 3, 3]
