"""Counts of a validation by column."""

from pyspark.sql import functions as F

from ioloom.operators import features


def test_validation_counts_every_column(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.0, None), (2, float("inf"), 0.0, None), (3, 1.0, 0.0, None)], "a long, b double, c double, d double").repartition(2)
    got = {r.feature: tuple(r)[1:] for r in features.validate(df, 3).collect()}
    assert got == {"a": (0, 0, False, True), "b": (1, 1, False, True), "c": (0, 0, True, True), "d": (3, 0, True, True)}
    assert {tuple(r)[1:] for r in features.validate(df.filter(F.lit(False)), 1).collect()} == {(0, 0, True, False)}
    assert next(features._column_counts([], ["a"])).column(1).to_pylist() == [0]
