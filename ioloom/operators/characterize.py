"""What a collection of jobs looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basic_stats(df: DataFrame) -> DataFrame:
    bytes_ = F.col("POSIX_BYTES_READ") + F.col("POSIX_BYTES_WRITTEN")
    pct = lambda c: F.avg(c.cast("double")) * 100
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("_jobid").alias("n_jobs"), F.min("_start_time").alias("first_start"), F.max("_start_time").alias("last_start"), F.avg("nprocs").alias("mean_nprocs"), F.median("nprocs").alias("median_nprocs"), F.max("nprocs").alias("max_nprocs"),
        pct(F.col("nprocs") == 1).alias("single_pct"), F.median("runtime_seconds").alias("median_runtime"), F.sum("POSIX_BYTES_READ").alias("bytes_read"), F.sum("POSIX_BYTES_WRITTEN").alias("bytes_written"), pct(bytes_ == 0).alias("zero_io_pct"),
    )


def module_combos(df: DataFrame, k: int = 15) -> DataFrame:
    return df.groupBy("_modules").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_modules").limit(k)


def workload_types(df: DataFrame) -> DataFrame:
    """df with workload; a later rule overrides earlier ones, so the last is tested first."""
    total = F.col("POSIX_BYTES_READ") + F.col("POSIX_BYTES_WRITTEN") + F.col("STDIO_BYTES_READ") + F.col("STDIO_BYTES_WRITTEN")
    minimal, mpi = total < 1e6, F.col("has_mpiio") == 1
    metadata = (F.col("POSIX_OPENS") > 1000) & (total < 1e8) & ~minimal
    learning = (F.col("has_stdio") == 1) & ~mpi & (F.col("nprocs") >= 1) & ~minimal
    return df.withColumn("workload", F.when(metadata, "metadata_heavy").when(mpi & (total > 1e6), "traditional_hpc").when(learning, "likely_ai_ml").when(minimal, "minimal_io").otherwise("other"))


def per_month(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.date_format(F.timestamp_seconds(time), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """bin, n: counts of log1p of a column by bins of the width."""
    return df.groupBy(F.floor(F.log1p(F.greatest(F.col(column), F.lit(0))) / width).alias("bin")).agg(F.count("*").alias("n"))


def co_occurrence(labels: DataFrame, dims: list[str]) -> DataFrame:
    """dim_a, dim_b, n (jobs with both), p_b_given_a. Jobs are first counted by their labels, so pairs are made of patterns, not of jobs."""
    patterns = labels.groupBy(*dims).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), (F.col(a) * F.col(b) * F.col("n")).alias("n"), (F.col(a) * F.col("n")).alias("of_a")) for a in dims for b in dims]))
    return patterns.select(each.alias("x")).select("x.*").groupBy("dim_a", "dim_b").agg(F.sum("n").alias("n"), F.sum("of_a").alias("of_a")).select("dim_a", "dim_b", "n", F.coalesce(F.try_divide("n", "of_a"), F.lit(0.0)).alias("p_b_given_a"))


def cardinality(labels: DataFrame, dims: list[str]) -> DataFrame:
    return labels.groupBy(sum((F.col(d) for d in dims[1:]), F.col(dims[0])).alias("n_labels")).agg(F.count("*").alias("n"))


def facility_rates(labels: DataFrame, dims: list[str]) -> DataFrame:
    row = labels.agg(F.count("*").alias("total"), *[F.sum(d).alias(d) for d in dims])
    return row.unpivot(["total"], dims, "dimension", "n").select("dimension", "n", (F.col("n") / F.col("total")).alias("rate"))
