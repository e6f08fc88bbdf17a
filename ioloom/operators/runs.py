"""Before-and-after pairs and iterative optimization runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["workload", "model", "run_id"]


def pair_speedups(runs: DataFrame, pair: str, kind: str, bandwidth: str) -> DataFrame:
    """pair, bad, good, speedup (rounded to 2; a bandwidth of 0 counts as 0.001), status: one row per pair."""
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col(bandwidth)))
    rows = runs.groupBy(pair).agg(of("bad").alias("bad"), of("good").alias("good"))
    some = lambda c: F.when(F.col(c) == 0, 0.001).otherwise(F.col(c))
    speedup = F.round(some("good") / some("bad"), 2)
    return rows.select(pair, "bad", "good", speedup.alias("speedup"), F.when(speedup.isNull(), "incomplete").otherwise("validated").alias("status"))


def flatten(history: DataFrame) -> DataFrame:
    """One row per iteration of runs that hold an array of them, runs without any kept."""
    return history.select("*", F.posexplode_outer("iterations").alias("position", "step")).select(*[c for c in history.columns if c != "iterations"], "position", "step.*")


def progress(steps: DataFrame) -> DataFrame:
    """Iterations with best (so far, above 1), is_new_best, regressed (bandwidth under 0.9 of the first and no new best) and plateau."""
    run = Window.partitionBy(*RUN).orderBy("iteration")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.greatest(F.coalesce(F.max("speedup").over(before), F.lit(1.0)), F.lit(1.0))
    rows = steps.select("*", best_before.alias("_best"), F.lag("speedup").over(run).alias("_last"), F.first("bandwidth").over(run).alias("_base"))
    new = F.col("speedup") > F.col("_best")
    # A run without a speedup yet counts as unchanged.
    last, now = F.coalesce("_last", F.lit(1.0)), F.coalesce("speedup", F.lit(1.0))
    plateau = (F.col("iteration") > 0) & F.col("executed") & ~F.col("rollback") & (F.abs(now - last) / F.greatest(last, F.lit(0.001)) < 0.05)
    return rows.select(*steps.columns, F.greatest("_best", F.coalesce("speedup", F.lit(1.0))).alias("best"), F.coalesce(new, F.lit(False)).alias("is_new_best"), (F.coalesce(F.col("bandwidth") < 0.9 * F.col("_base"), F.lit(False)) & ~F.coalesce(new, F.lit(False))).alias("regressed"), F.coalesce(plateau, F.lit(False)).alias("plateau"))


def outcomes(steps: DataFrame) -> DataFrame:
    """Per run: best speedup, the first iteration that reached it, status (by the first of converged, plateau) and iterations."""
    rows = progress(steps)
    stop = F.when(F.col("open_dims") == 0, "converged").when(F.col("plateau"), "plateau")
    return rows.groupBy(*RUN).agg(F.max("best").alias("best_speedup"), F.min(F.when(F.col("is_new_best"), F.struct((-F.col("speedup")).alias("s"), "iteration")))["iteration"].alias("best_iteration"), F.coalesce(F.min_by(stop, F.when(stop.isNotNull(), F.col("iteration"))), F.lit("max_iterations")).alias("status"), F.count("*").alias("iterations"))


def summarize(runs: DataFrame, *by: str) -> DataFrame:
    """By the columns: n, mean, std (population), median, min, max, geometric mean (from 0.01 up), harmonic mean and improved count of best_speedup."""
    v = F.col("best_speedup")
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.exp(F.avg(F.log(F.greatest(v, F.lit(0.01))))).alias("geo_mean"), (F.count(v) / F.sum(1 / F.greatest(v, F.lit(0.01)))).alias("harmonic_mean"), F.count_if(v > 1).alias("improved"),
    )


def size_bytes(text):
    """'4k', '1.5M', '2g' or plain digits as bytes, rounded down; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d*)?)([kmg]?)\s*$", i)
    unit = F.lower(part(2))
    power = F.when(unit == "k", 10).when(unit == "m", 20).when(unit == "g", 30).otherwise(0)
    return F.when(part(1) != "", F.floor(part(1).try_cast("double") * F.pow(F.lit(2.0), power)).cast("bigint"))


def category(file_name):
    """sweep, ablation, smoke or other, by a result file's prefix."""
    return F.when(file_name.startswith("sweep_"), "sweep").when(file_name.startswith("ablation_"), "ablation").when(file_name.startswith("trackc_"), "smoke").otherwise("other")


def ablation_condition(file_name):
    """The condition in ablation_<condition>_<workload>.json; no_<what> and single_shot are of two words."""
    parts = F.split(F.replace(F.replace(file_name, F.lit("ablation_"), F.lit("")), F.lit(".json"), F.lit("")), "_")
    first = parts[0]
    return F.when(F.size(parts) < 2, "unknown").when(first == "no", F.concat(F.lit("no_"), F.get(parts, F.lit(1)))).when(first == "single", "single_shot").otherwise(first)


#: What a run's status says when it holds no result.
FAILED = ["baseline_failed", "not_started"]


def workload_metrics(runs: DataFrame) -> DataFrame:
    """workload, model, n_valid, n_total, mean, std, median, min, max and geometric mean of best_speedup over valid runs, mean_iterations, mean_cost, total_cost, statuses (of the valid runs, or of all if none is: an array of status and n)."""
    ok = ~F.col("status").isin(FAILED)
    v, some = F.when(ok, F.coalesce("best_speedup", F.lit(1.0))), lambda c: F.coalesce(c, F.lit(0.0))
    valid = lambda c: F.when(ok, F.col(c))
    out = runs.groupBy("workload", "model").agg(
        F.count_if(ok).alias("n_valid"), F.count("*").alias("n_total"), some(F.avg(v)).alias("mean"), some(F.stddev_pop(v)).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.exp(F.avg(F.when(ok, F.log(F.greatest(v, F.lit(0.01)))))).alias("geo_mean"), some(F.avg(valid("iterations"))).alias("mean_iterations"), some(F.avg(valid("cost"))).alias("mean_cost"), F.sum(valid("cost")).alias("total_cost"),
    )
    # A status and how many runs have it, as the runs themselves would be a list without bound.
    counts = runs.groupBy("workload", "model", "status").agg(F.count("*").alias("n")).withColumn("s", F.struct("status", "n"))
    told = counts.groupBy("workload", "model").agg(F.array_sort(F.collect_list(F.when(ok, F.col("s")))).alias("valid"), F.array_sort(F.collect_list("s")).alias("every"))
    return out.join(told.select("workload", "model", F.when(F.size("valid") > 0, F.col("valid")).otherwise(F.col("every")).alias("statuses")), ["workload", "model"])


def model_summary(runs: DataFrame) -> DataFrame:
    """model, n_workloads, geometric mean, mean and std of best_speedup over all valid runs; iterations and cost averaged over workloads; total_cost, the sum of workloads' mean costs."""
    valid = runs.filter(~F.col("status").isin(FAILED)).withColumn("v", F.coalesce("best_speedup", F.lit(1.0)))
    # Sums of workloads add up, so the second grouping is over workloads, not runs.
    each = valid.groupBy("model", "workload").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.sum(F.log(F.greatest("v", F.lit(0.01)))).alias("sl"), F.avg("iterations").alias("i"), F.avg("cost").alias("c"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return each.groupBy("model").agg(F.count("*").alias("n_workloads"), F.exp(F.sum("sl") / n).alias("geo_mean"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("std"), F.avg("i").alias("mean_iterations"), F.avg("c").alias("mean_cost"), F.sum("c").alias("total_cost"))


def ablation_metrics(runs: DataFrame) -> DataFrame:
    """condition, n_runs, mean, std (population) and geometric mean of best_speedup over valid runs. runs: file_name, status, best_speedup."""
    valid = runs.filter(~F.col("status").isin(FAILED)).select(ablation_condition(F.col("file_name")).alias("condition"), F.coalesce("best_speedup", F.lit(1.0)).alias("v"))
    return valid.groupBy("condition").agg(F.count("*").alias("n_runs"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.exp(F.avg(F.log(F.greatest("v", F.lit(0.01))))).alias("geo_mean"))
