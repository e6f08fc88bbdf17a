"""Per-feature statistics: profiles, correlation, shift and audits. Wide rows are unpivoted to
(feature, value); percentiles and running sums go through buckets of values, so no task holds a feature."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ioloom.functions.counters import group_of
from ioloom.operators.columns import Columns
from ioloom.operators.order import percentiles, running, settled

QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def values(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, feature, value: a row per row and column."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def _groups(columns: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for c in columns for x in (c, group_of(c))])[F.col("feature")]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, count, mean, std, min, max, quantiles, bias-corrected skewness and kurtosis, shares of zeros and negatives, group."""
    v, n = F.col("value"), F.col("count")
    held = df.select(*columns).persist(StorageLevel.DISK_ONLY)
    rows = values(held, columns)
    at = rows.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.count_if(v != 0).alias("nonzero_count"),
    )
    at = at.join(percentiles(rows, ["feature"], "value", list(QUANTILES.values()), few=True), "feature", "left")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    out = at.select(
        "feature", "count", "mean", "std", "min", "max", *[F.col("q")[i].alias(q) for i, q in enumerate(QUANTILES)], skew.alias("skewness"), kurt.alias("kurtosis"),
        (F.col("zeros") / n).alias("zero_fraction"), (F.col("negatives") / n).alias("negative_fraction"), "nonzero_count", _groups(columns).alias("feature_group"),
    )
    return settled(out, held)


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, rho for every pair a < b in column order; only the features-by-features matrix reaches the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vectors = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df.select(*columns)).select("v")
    m = Correlation.corr(vectors, "v", method).first()[0].toArray()
    rows = [(columns[i], columns[j], None if math.isnan(m[i, j]) else float(m[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def redundant(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter(F.abs("rho") >= threshold).orderBy(F.desc(F.abs("rho")), "a", "b")


def zero_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, zero_fraction of its values that are there."""
    return values(df, columns).groupBy("feature").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_fraction"))


def sparse(profiled: DataFrame, threshold: float = 0.99) -> DataFrame:
    return profiled.filter(F.col("zero_fraction") > threshold).select("feature", "zero_fraction").orderBy(F.desc("zero_fraction"), "feature")


def group_summary(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("feature_group").agg(F.count("*").alias("n_features"), F.median("skewness").alias("median_skewness"), F.median("kurtosis").alias("median_kurtosis"), F.avg("zero_fraction").alias("mean_zero_fraction"))


def constants(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose standard deviation over df is 0."""
    row = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or row[c] == 0]


def feature_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [c for c in df.columns if not c.startswith(("_", "drishti_")) and c not in exclude]


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature and flags: skewed (> 10), heavy (kurtosis > 100), wide or narrow std (> 50, < 0.001), far (|max| > 100), constant."""
    return profile(df, columns).select(
        "feature", (F.abs("skewness") > 10).alias("skewed"), (F.col("kurtosis") > 100).alias("heavy"), (F.col("std") > 50).alias("wide"), (F.col("std") < 0.001).alias("narrow"), (F.greatest(F.abs("min"), F.abs("max")) > 100).alias("far"), (F.col("std") == 0).alias("constant")
    )


def skew_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """feature, skewness before and after, improvement of its absolute value."""
    return before.select("feature", F.col("skewness").alias("before")).join(after.select("feature", F.col("skewness").alias("after")), "feature").withColumn("improvement", F.abs("before") - F.abs("after"))


def covariate_shift(train: DataFrame, test: DataFrame, columns: list[str], limit: float = 0.5) -> DataFrame:
    """feature, shift (difference of means over the training std), shifted."""
    a = values(train, columns).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    b = values(test, columns).groupBy("feature").agg(F.avg("value").alias("m2"))
    shift = F.abs(F.col("m") - F.col("m2")) / (F.col("s") + 1e-10)
    return a.join(b, "feature").select("feature", shift.alias("shift"), (shift > limit).alias("shifted"))


def ks_statistic(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """feature, ks (largest gap of the two distribution functions), p_value (asymptotic), largest first.

    Values are counted first; running sums go over buckets of values, then over the distinct values of a bucket. Nulls count for neither.
    """
    both = values(a, columns).withColumn("one", F.lit(1)).unionAll(values(b, columns).withColumn("one", F.lit(0))).filter("value is not null")
    at = both.groupBy("feature", "value").agg(F.sum("one").alias("n1"), F.sum(1 - F.col("one")).alias("n0")).persist(StorageLevel.DISK_ONLY)
    share = lambda s: F.try_divide(F.col(f"{s}_below") + F.col(s), F.col(f"{s}_all"))
    gaps = running(at, "feature", "value", ["n1", "n0"]).select("feature", F.abs(share("n1") - share("n0")).alias("gap"), F.col("n1_all").alias("a"), F.col("n0_all").alias("b"))
    d = settled(gaps.groupBy("feature").agg(F.max("gap").alias("ks"), F.first("a").alias("a"), F.first("b").alias("b")), at)
    en = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    tail = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)) * 2
    return d.select("feature", "ks", F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).alias("p_value")).orderBy(F.desc("ks"), "feature")


def mad_outliers(df: DataFrame, columns: list[str], z: float = 3.0) -> DataFrame:
    """feature, share of values over z scaled absolute deviations from the median (std where the MAD is 0, 0 where that is too)."""
    held = Columns(df, columns)
    mids = {c: q[0] for c, q in held.percentiles([0.5]).items()}
    mads = {c: q[0] for c, q in held.percentiles([0.5], mids).items()}
    limits = {c: (mids[c], 1.4826 * mad, z) for c, mad in mads.items() if not mad <= 1e-10}
    limits |= {c: (mean, std, z) for c, (n, mean, std) in held.moments([c for c in mads if c not in limits]).items() if n > 1 and not std <= 1e-10}
    far = held.shares(limits)
    rows = [(feature, far.get(c, 0.0)) for c, feature in enumerate(columns)] if held.rows() else []
    held.release()
    return df.sparkSession.createDataFrame(rows, "feature string, outlier_ratio double")


def correlation_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row over the pairs of two correlation tables: mean, max and median difference, counts over .01, .05, .10."""
    gap = before.join(after.withColumnRenamed("rho", "rho2"), ["a", "b"]).select(F.abs(F.col("rho") - F.col("rho2")).alias("gap"))
    return gap.agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"), *[F.count_if(F.col("gap") > t).alias(f"over_{int(t * 100):02d}") for t in (0.01, 0.05, 0.10)])


def range_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, whether p05 and p95 lie in [-10, 10] and the interquartile range in [0.1, 10]."""
    held = Columns(df, columns)
    found = held.percentiles([QUANTILES[q] for q in ("p05", "p25", "p75", "p95")])
    rows = [(feature, *found.get(c, [None] * 4)) for c, feature in enumerate(columns)] if held.rows() else []
    held.release()
    p = df.sparkSession.createDataFrame(rows, "feature string, p05 double, p25 double, p75 double, p95 double")
    return p.select("feature", ((F.col("p05") >= -10) & (F.col("p95") <= 10)).alias("in_range"), (F.col("p75") - F.col("p25")).between(0.1, 10).alias("iqr_ok"))
