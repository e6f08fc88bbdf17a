"""Evaluation of multi-label predictions; everything is a sum of true and false positives and negatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ioloom.operators.order import percentiles, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def long_form(predictions: DataFrame, dims: list[str], keep: list[str] = ()) -> DataFrame:
    """keep columns, dim, gt, pred, prob: a row per job and dimension."""
    prob = lambda d: F.col(f"prob_{d}") if f"prob_{d}" in predictions.columns else F.lit(None).cast("double")
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"gt_{d}").alias("gt"), F.col(f"pred_{d}").alias("pred"), prob(d).alias("prob")) for d in dims])
    return predictions.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def counted(rows: DataFrame, *by: str, predicted: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn of rows with gt and pred, by the given columns."""
    gt, pred = F.col("gt") == 1, F.col("pred") == 1 if predicted is None else predicted
    return rows.groupBy(*by).agg(F.count_if(gt & pred).alias("tp"), F.count_if(~gt & pred).alias("fp"), F.count_if(gt & ~pred).alias("fn"), F.count_if(~gt & ~pred).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support beside tp, fp, fn, tn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def per_label(predictions: DataFrame, dims: list[str]) -> DataFrame:
    return scores(counted(long_form(predictions, dims), "dim"))


def overall(predictions: DataFrame, dims: list[str], by: list[str] = ()) -> DataFrame:
    """by columns, micro precision, recall and f1, macro_f1 over all dims and over dims with support."""
    each = scores(counted(long_form(predictions, dims, list(by)), *by, "dim"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return each.groupBy(*by).agg(ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.avg("f1").alias("macro_f1"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1_supported"))


def _sets(dims: list[str]) -> tuple[Column, Column]:
    pick = lambda kind: F.array_compact(F.array(*[F.when(F.col(f"{kind}_{d}") == 1, F.lit(d)) for d in dims]))
    return pick("gt"), pick("pred")


def set_scores(predictions: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    """Each job's tp, fp, fn as sets of dims, with precision and recall, 1 for an empty denominator."""
    gt, pred = _sets(dims)
    rows = predictions.select(*keep, gt.alias("gt"), pred.alias("pred")).select(*keep, F.array_intersect("gt", "pred").alias("tp"), F.array_except("pred", "gt").alias("fp"), F.array_except("gt", "pred").alias("fn"))
    one = lambda a, b: F.coalesce(F.try_divide(F.size(a).cast("double"), F.size(a) + F.size(b)), F.lit(1.0))
    return rows.select("*", one("tp", "fp").alias("precision"), one("tp", "fn").alias("recall"))


def row_scores(predictions: DataFrame, dims: list[str]) -> DataFrame:
    """One row: hamming_loss, subset_accuracy, partial_match (a hit, or both empty) and samples_f1."""
    wrong = sum((F.col(f"gt_{d}") != F.col(f"pred_{d}")).cast("int") for d in dims)
    tp = sum(F.col(f"gt_{d}") * F.col(f"pred_{d}") for d in dims)
    both = sum(F.col(f"gt_{d}") + F.col(f"pred_{d}") for d in dims)
    return predictions.agg((F.sum(wrong) / (F.count("*") * len(dims))).alias("hamming_loss"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"), F.avg(((tp > 0) | (both == 0)).cast("double")).alias("partial_match"), F.avg(ratio(2 * tp, both)).alias("samples_f1"))


def agreement(predictions: DataFrame, dims: list[str]) -> DataFrame:
    """dim, agreement rate, Cohen's kappa (0 if the truth has one class), trivial (no positives on either side)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    seen, chance = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    single = (tp + fn == 0) | (fp + tn == 0)
    return counted(long_form(predictions, dims), "dim").select("dim", seen.alias("agreement"), F.when(single | (chance == 1), 0.0).otherwise(F.try_divide(seen - chance, 1 - chance)).alias("kappa"), ((tp + fn == 0) & (tp + fp == 0)).alias("trivial"))


def threshold_sweep(predictions: DataFrame, dims: list[str], thresholds: list[float], by_dim: bool = False) -> DataFrame:
    """threshold (and dim), tp, fp, fn, tn, precision, recall, f1: each row meets every threshold in one pass."""
    rows = long_form(predictions, dims).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return scores(counted(rows, "threshold", *["dim"] * by_dim, predicted=F.col("prob") >= F.col("threshold")))


def best_thresholds(predictions: DataFrame, dims: list[str]) -> DataFrame:
    """dim, threshold of the highest f1 over 0.01 to 0.99, the lowest of equals."""
    swept = threshold_sweep(predictions, dims, [i / 100 for i in range(1, 100)], by_dim=True)
    return swept.groupBy("dim").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def left_out_thresholds(predictions: DataFrame, dims: list[str], grid: list[float], key: str = "job_id") -> DataFrame:
    """key, dim, threshold best on all other rows: totals less the row's own part, never all pairs of rows.

    A row counts by its step, the number of thresholds that its probability reaches, and its label: totals are sums over the
    counts of steps, and the best threshold is found once for each step and label.
    """
    grid = sorted(set(grid))
    rows = long_form(predictions, dims, [key]).withColumn("step", _steps(F.col("prob"), grid)).select(key, "dim", "gt", "step")
    counts = rows.groupBy("dim", "gt", "step").agg(F.count("*").alias("n"))  # two labels and as many steps as thresholds
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("t")) for i, x in enumerate(grid, 1)])).alias("x")
    hit = lambda i: F.col("step") >= i
    each = counts.select("*", t).select("*", F.col("x.i").alias("i"), F.col("x.t").alias("t"))
    totals = each.groupBy("dim", "i", "t").agg(F.sum(F.when(hit(F.col("i")) & (F.col("gt") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(hit(F.col("i")), F.col("n")).otherwise(0)).alias("p"), F.sum(F.col("gt") * F.col("n")).alias("g"))
    table = totals.groupBy("dim").agg(F.collect_list(F.struct("i", "t", "tp", "p", "g")).alias("grid"))
    f1 = lambda x: ratio(2 * (x["tp"] - F.when(hit(x["i"]) & (F.col("gt") == 1), 1).otherwise(0)), x["p"] - hit(x["i"]).cast("int") + x["g"] - F.col("gt"))
    best = F.array_max(F.transform("grid", lambda x: F.struct(f1(x).alias("f1"), (-x["t"]).alias("t"))))
    found = counts.join(F.broadcast(table), "dim").select(F.col("dim").alias("_dim"), F.col("gt").alias("_gt"), F.col("step").alias("_step"), (-best["t"]).alias("threshold"))
    same = (F.col("dim") == F.col("_dim")) & F.col("gt").eqNullSafe(F.col("_gt")) & F.col("step").eqNullSafe(F.col("_step"))
    return rows.join(F.broadcast(found), same).select(key, "dim", "threshold")


def _steps(value, grid: list[float], first: int = 0):
    """How many of grid's ascending thresholds value reaches, null for null, by halving."""
    if not grid:
        return F.lit(first)
    half = len(grid) // 2
    above, below = _steps(value, grid[half + 1 :], first + half + 1), _steps(value, grid[:half], first)
    return F.when(value.isNull(), None).when(value >= grid[half], above).otherwise(below)


def ranking(predictions: DataFrame, dims: list[str]) -> DataFrame:
    """dim, auc_roc (average ranks), auc_pr (steps at distinct scores), mean probability by class, signal.

    Scores are counted first; running sums go over buckets of scores, then over the distinct scores of a bucket.
    """
    at = long_form(predictions, dims).groupBy("dim", "prob").agg(F.count("*").alias("n"), F.sum("gt").alias("pos"))
    at = running(at, "dim", "prob", ["n", "pos"]).select("dim", "prob", "n", "pos", F.col("n_below").alias("below"), (F.col("n_all") - F.col("n_below")).alias("taken"), (F.col("pos_all") - F.col("pos_below")).alias("hits"))
    out = at.groupBy("dim").agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("pos") * F.col("hits") / F.col("taken")).alias("steps"), F.sum(F.col("prob") * F.col("pos")).alias("s1"), F.sum(F.col("prob") * (F.col("n") - F.col("pos"))).alias("s0"))
    p, neg = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    auc = F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * neg)
    signal = F.when(auc > 0.7, "STRONG").when(auc > 0.5, "PARTIAL").otherwise("INVERSE")
    return out.select("dim", auc.alias("auc_roc"), F.try_divide(F.col("steps"), p).alias("auc_pr"), F.try_divide(F.col("s1"), p).alias("mean_positive"), F.try_divide(F.col("s0"), neg).alias("mean_negative"), signal.alias("signal"))


def latency(df: DataFrame, column: str, *by: str) -> DataFrame:
    """mean, std (population), p50, p95, p99, min, max of a timing column, of each group if by is given."""
    keys = {f"_k{i}": F.col(b) for i, b in enumerate(by)} or {"_k0": F.lit(0)}
    rows = df.select(*by, *[c.alias(k) for k, c in keys.items()], column)
    q = percentiles(rows, list(keys), column, [0.5, 0.95, 0.99]).select(F.struct(*keys).alias("_k"), "q")
    rows = rows.groupBy(*by, F.struct(*keys).alias("_k")).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return rows.join(q, "_k", "left").select(*by, "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "min", "max")


#: Draws of one block of replicates.
CELLS = 1 << 21


def _f1s(n: np.ndarray, tp: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(micro, macro) f1 of each replicate; n: replicates by patterns, tp and miss: patterns by dimensions."""
    hits, wrong = 2.0 * (n @ tp), n @ miss
    share = lambda x, y: np.divide(x, x + y, out=np.zeros_like(x), where=x + y > 0)
    return share(hits.sum(axis=1), wrong.sum(axis=1)), share(hits, wrong).mean(axis=1)


def bootstrap(predictions: DataFrame, dims: list[str], replicates: int = 10_000, seed: int = 0, other: str | None = None) -> DataFrame:
    """metric (micro_f1, macro_f1), its mean over replicates, 95 % percentile interval, share not above 0 and mean over std.

    With other, the metric is the difference to the predictions other_<dim>. Rows are first counted by their pattern of
    hits and misses, of which there are at most 3 for a dimension, 7 with other, to the power of the dimensions, whatever the number of
    rows; a replicate draws a Poisson number of each pattern from its own seed, so no draw depends on partitions.
    """
    kinds = ["pred", *([other] if other else [])]
    marks = {f"{k}_{d}": F.when((F.col(f"gt_{d}") == 1) & (F.col(f"{k}_{d}") == 1), 2).when(F.col(f"gt_{d}") != F.col(f"{k}_{d}"), 1).otherwise(0) for k in kinds for d in dims}
    found = predictions.groupBy(*[c.alias(n) for n, c in marks.items()]).agg(F.count("*").alias("n")).orderBy(*marks).toPandas()
    counts, codes = found["n"].to_numpy(), found[list(marks)].to_numpy().reshape(len(found), len(kinds), len(dims))
    tp, miss = (codes == 2).astype(float), (codes == 1).astype(float)

    def drawn(batches):
        some = max(1, CELLS // max(1, len(counts)))
        for batch in (whole.slice(i, some) for whole in batches for i in range(0, whole.num_rows, some)):
            reps = batch.column(0).to_pylist()
            n = np.stack([np.random.default_rng((seed, r)).poisson(counts) for r in reps]).astype(float)
            each = [_f1s(n, tp[:, k], miss[:, k]) for k in range(len(kinds))]
            micro, macro = (each[0][i] - each[1][i] if other else each[0][i] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(["micro_f1"] * len(reps) + ["macro_f1"] * len(reps)), pa.array(np.concatenate([micro, macro]))], names=["metric", "v"])

    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    each = predictions.sparkSession.range(replicates).mapInArrow(drawn, "metric string, v double").groupBy("metric")
    out = each.agg(F.avg("v").alias("mean"), q.alias("q"), F.avg((F.col("v") <= 0).cast("double")).alias("p_not_above"), F.coalesce(F.try_divide(F.avg("v"), F.stddev_samp("v")), F.lit(0.0)).alias("effect"))
    return out.select("metric", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_not_above", "effect")


def compare_runs(old: DataFrame, new: DataFrame, key: str, metric: str) -> DataFrame:
    """key, old and new value of metric and their difference, keys of either run kept."""
    return old.select(key, F.col(metric).alias("old")).join(new.select(key, F.col(metric).alias("new")), key, "full_outer").select(key, "old", "new", (F.col("new") - F.col("old")).alias("delta"))


def agreement_buckets(df: DataFrame, rule_healthy: str, detected: str) -> DataFrame:
    """rule_bottleneck, model_bottleneck, n: jobs by whether the rules and the model (an array of dimensions) see any bottleneck."""
    seen = F.exists(detected, lambda d: d != "healthy")
    return df.select((~F.col(rule_healthy)).alias("rule_bottleneck"), seen.alias("model_bottleneck")).groupBy("rule_bottleneck", "model_bottleneck").agg(F.count("*").alias("n"))


def leaderboard(predictions: DataFrame, dims: list[str], system: str, run: str) -> DataFrame:
    """One row per system, its newest run: micro and macro F1, Hamming loss, subset accuracy, n. Runs of a system are never mixed."""
    newest = predictions.groupBy(system).agg(F.max(run).alias(run))
    last = predictions.join(newest, [system, run], "left_semi")
    wrong = sum((F.col(f"gt_{d}") != F.col(f"pred_{d}")).cast("int") for d in dims)
    rows = last.groupBy(system).agg(F.count("*").alias("n"), (F.sum(wrong) / (F.count("*") * len(dims))).alias("hamming_loss"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"))
    return overall(last, dims, [system]).select(system, "micro_f1", "macro_f1").join(rows, system)
