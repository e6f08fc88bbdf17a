"""Normalization, splits and samples."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ioloom.functions.counters import group_of
from ioloom.operators.order import percentiles, placed
from ioloom.operators.stats import values

#: How each group is scaled.
METHODS = {"volume": "log1p_robust", "count": "log1p_robust", "histogram": "log1p", "top4": "log1p", "timing": "log1p_robust", "timestamp": "log1p", "conditional_size": "log1p", "ratio_unbounded": "log1p", "derived_absolute": "log1p", "metadata": "log1p", "ratio": "none", "indicator": "none", "categorical": "none", "rank_id": "none"}


def method_of(feature: str) -> str:
    return METHODS[group_of(feature)]


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def log10_clipped(c: Column) -> Column:
    return F.log10(F.greatest(c, F.lit(0.0)) + 1)


def fit_robust(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, center (median), scale (interquartile range, 1 where it is 0) of log1p of the training rows."""
    held = train.select(*columns).persist(StorageLevel.DISK_ONLY)  # read three times
    fitted = percentiles(values(held, columns).withColumn("value", log1p_clipped(F.col("value"))), ["feature"], "value", [0.25, 0.5, 0.75], few=True)
    held.unpersist()
    width = F.col("q")[2] - F.col("q")[0]
    return fitted.select("feature", F.col("q")[1].alias("center"), F.when(width == 0, 1.0).otherwise(width).alias("scale"))


def normalize(df: DataFrame, columns: list[str], scalers: DataFrame | None = None) -> DataFrame:
    """df with each column scaled by its group's method. scalers has a row per feature, so it is collected."""
    fitted = {r.feature: (r.center, r.scale) for r in scalers.collect()} if scalers is not None else {}

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        method = method_of(c)
        if method == "none":
            return x
        if method == "log1p" or c not in fitted:
            return log1p_clipped(x)
        center, scale = fitted[c]
        return (log1p_clipped(x) - center) / scale

    return df.select(*[one(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def temporal_split(df: DataFrame, time: str, key: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """df with split: the last share by time is test, the one before val. Counts are floors of n * share.

    Rows are counted by day and by minute of the day first; running sums go over days, then over a day's minutes, and
    rows are ordered within a minute only. A null time comes first, as in Spark's order.
    """
    n = F.sum("n").over(Window.partitionBy())
    day = F.floor(F.col(time) / 86400)
    per_day = df.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before_day = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = per_day.select("day", before_day.alias("before_day"), n.alias("total"))
    n_test, n_val = F.floor(F.col("total") * test), F.floor(F.col("total") * val)
    days = days.select("day", "before_day", (F.col("total") - n_test - n_val).alias("val_from"), (F.col("total") - n_test).alias("test_from"))
    minute = F.floor((F.col(time) - day * 86400) / 60)
    rows = placed(df.withColumn("_day", day), ["_day"], F.coalesce(minute, F.lit(-1)), [time, key]).join(days, F.col("_day").eqNullSafe(F.col("day")))
    place = F.col("before_day") + F.col("_place")
    split = F.when(place < F.col("val_from"), "train").when(place < F.col("test_from"), "val").otherwise("test")
    return rows.withColumn("split", split).select(*df.columns, "split")


def hash_order(key: str, seed: int = 42) -> Column:
    """A text whose order is as good as random, and the same in other engines: md5 of the key and the seed."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def hash_bucket(key: str, seed: int = 42) -> Column:
    """The first of 4096 buckets of hash_order, in its order."""
    return F.substring(hash_order(key, seed), 1, 3)


def random_split(df: DataFrame, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split by the rank of a hash of the key; the shares are floors of n * share."""
    rows = placed(df, [], hash_bucket(key, seed), [hash_order(key, seed), key])
    n_test, n_val = F.floor(F.col("_size") * test), F.floor(F.col("_size") * val)
    split = F.when(F.col("_place") < n_test, "test").when(F.col("_place") < n_test + n_val, "val").otherwise("train")
    return rows.withColumn("split", split).select(*df.columns, "split")


def stratified_split(df: DataFrame, dims: list[str], key: str, train: float = 0.3, seed: int = 42) -> DataFrame:
    """df with split: each combination of labels is cut at the share; those of one row go to test."""
    rows = placed(df, dims, hash_bucket(key, seed), [hash_order(key, seed), key])
    first = (F.col("_size") > 1) & (F.col("_place") < F.round(F.col("_size") * train))
    return rows.withColumn("split", F.when(first, "train").otherwise("test")).select(*df.columns, "split")


def stratified_sample(df: DataFrame, dims: list[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """About n rows, strata in proportion, at least one of each, the rest by hash order."""
    total = df.count() or 1
    alloc = F.greatest(F.floor(F.col("_size") * n / total), F.lit(1))
    rows = placed(df, dims, hash_bucket(key, seed), [hash_order(key, seed), key])
    return rows.withColumn("_over", F.col("_place") >= alloc).orderBy("_over", hash_order(key, seed), key).limit(n).select(*df.columns)


def sample_per(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each value of by, first by hash. Spark keeps n of a value in each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(key, seed), key))
    return df.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") % k)


def leave_one_out(df: DataFrame, by: str, value: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(~F.col(by).eqNullSafe(F.lit(value))), df.filter(F.col(by) == value)


def diverse_pick(df: DataFrame, dims: list[str], scenario: str, order: str, per_dim: int = 1) -> DataFrame:
    """The first jobs of each dimension in order, a base scenario (its first three parts) being claimed by its lowest dimension."""
    base = F.substring_index(F.col(scenario), "_", 3)
    rank = F.coalesce(*[F.when(F.col(d) == 1, F.lit(i)) for i, d in enumerate(dims)])
    rows = df.withColumn("_base", base).withColumn("dim", rank).filter("dim is not null")
    first = F.row_number().over(Window.partitionBy("_base").orderBy("dim", order))
    rows = rows.withColumn("_f", first).filter("_f = 1")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("dim").orderBy(order))).filter(F.col("_k") <= per_dim).drop("_base", "_f", "_k")
