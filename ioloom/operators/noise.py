"""Label noise by confident learning: labels that confident out-of-fold probabilities contradict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholds(given: DataFrame) -> DataFrame:
    """dimension, t0, t1: the mean probability of a class over the rows that carry it, its self-confidence. given: id, dimension, label (0/1), prob (of 1)."""
    return given.groupBy("dimension").agg(F.avg(F.when(F.col("label") == 0, 1 - F.col("prob"))).alias("t0"), F.avg(F.when(F.col("label") == 1, F.col("prob"))).alias("t1"))


def judged(given: DataFrame) -> DataFrame:
    """given with confident: the class whose probability reaches its threshold (of both, the likelier; a tie goes to the label; null if
    neither does), and noisy: whether that class isn't the label. A class without rows has no threshold and is never confident.

    The thresholds are a row a dimension, joined back by dimension.
    """
    p1, p0 = F.col("prob"), 1 - F.col("prob")
    one, zero = F.coalesce(p1 >= F.col("t1"), F.lit(False)), F.coalesce(p0 >= F.col("t0"), F.lit(False))
    both = F.when(p1 > p0, 1).when(p1 < p0, 0).otherwise(F.col("label"))
    confident = F.when(one & zero, both).when(one, 1).when(zero, 0)
    out = given.join(F.broadcast(thresholds(given)), "dimension").withColumn("confident", confident)
    return out.select(*given.columns, "confident", F.coalesce(F.col("confident") != F.col("label"), F.lit(False)).alias("noisy"))


def joint(judgements: DataFrame) -> DataFrame:
    """dimension, label, confident, n, estimated: the confident joint counts, and the joint distribution estimated from them.

    A label's counts are scaled to all its rows, then all to a sum of 1.
    """
    rows = judgements.groupBy("dimension", "label").agg(F.count("*").alias("n_label"), F.count("confident").alias("n_confident"))
    cells = judgements.filter("confident is not null").groupBy("dimension", "label", "confident").agg(F.count("*").alias("n"))
    total = rows.filter("n_confident > 0").groupBy("dimension").agg(F.sum("n_label").alias("total"))
    return cells.join(rows, ["dimension", "label"]).join(total, "dimension").select("dimension", "label", "confident", "n", (F.col("n") / F.col("n_confident") * F.col("n_label") / F.col("total")).alias("estimated"))


def report(judgements: DataFrame) -> DataFrame:
    """dimension, total, noisy, clean, rate: a row a dimension, and one (dimension null) for rows that any dimension marks."""
    each = judgements.groupBy("dimension").agg(F.count("*").alias("total"), F.count_if("noisy").alias("noisy"))
    rows = judgements.groupBy("id").agg(F.max("noisy").alias("noisy")).agg(F.lit(None).cast("string").alias("dimension"), F.count("*").alias("total"), F.count_if("noisy").alias("noisy"))
    return each.unionByName(rows).select("dimension", "total", "noisy", (F.col("total") - F.col("noisy")).alias("clean"), F.round(F.col("noisy") / F.greatest("total", F.lit(1)), 4).alias("rate"))
