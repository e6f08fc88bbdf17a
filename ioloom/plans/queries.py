"""The registered queries and the SQL that they are held against. Names are the survey's operator ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ioloom.functions.counters import DERIVED, DIMENSIONS, MODULE_OF, TOP4, of_rule, rule_of, top4_columns
from ioloom.operators import features, rules
from ioloom.operators.records import aggregate_records
from ioloom.plans import sql
from ioloom.plans.core import ORACLES, QUERIES, r6, register, rounded
from ioloom.plans.stages import engineered, labelled, raw
from ioloom.sources import surrogate

_GROUPS = {"B1_sum_clamp": ["sum_clamp"], "B2_sum": ["sum"], "B3_max": ["max"], "B4_min_nonzero": ["min_nonzero"], "B5_last_value": ["last"], "B7_shared_last": ["shared_last"], "B8_shared_extremes": ["shared_min", "shared_max"], "B9_argmax_companion": ["argmax"], "B10_zeroed": ["zero"]}
for _name, _rules in _GROUPS.items():
    _columns = [c for r in _rules for c in of_rule(r)]
    _needs = [c.replace("MAX_", "F_MAX_").replace("_TIME_SIZE", "_TIME") for c in _columns] if "argmax" in _rules else []

    @register(_name, f"WITH {sql.MERGED} SELECT jobid, {', '.join(_columns)} FROM merged")
    def _merge(spark, sf_dir, columns=tuple(_columns), needs=tuple(_needs)):
        return aggregate_records(surrogate.records(spark, sf_dir, [*columns, *needs])).select("jobid", *columns)


_PLACES = [c for g in TOP4 for pair in top4_columns(g) for c in pair]


@register("B6_top4_merge", f"WITH {sql.MERGED} SELECT jobid, {', '.join(_PLACES)} FROM merged")
def b6(spark, sf_dir):
    return aggregate_records(surrogate.records(spark, sf_dir, _PLACES)).select("jobid", *_PLACES)


@register("B11_shared_file", f"WITH {sql.MERGED} SELECT jobid, shared_posix, num_files, n_records FROM merged")
def b11(spark, sf_dir):
    return aggregate_records(surrogate.records(spark, sf_dir, ["POSIX_READS"])).select("jobid", "shared_posix", "num_files", "n_records")


_RAW = ["_jobid", "_uid", "_start_time", "_modules", "nprocs", "runtime_seconds", "has_posix", "has_mpiio", "has_stdio", "is_shared_file", "num_files", "POSIX_READS", "MPIIO_COLL_READS", "STDIO_READS"]


@register("C1_C2_raw_rows", f"WITH {sql.RAW} SELECT {', '.join(_RAW)} FROM raw")
def c1(spark, sf_dir):
    return raw(spark, sf_dir).select(*_RAW)


@register("C3_C8_clean", f"WITH {sql.CLEAN} SELECT _jobid, POSIX_MMAPS, POSIX_FASTEST_RANK, POSIX_SLOWEST_RANK, POSIX_SLOWEST_RANK_BYTES, {sql.r6('runtime_seconds')} AS runtime_seconds FROM clean")
def c3(spark, sf_dir):
    return features.clean(raw(spark, sf_dir)).select("_jobid", "POSIX_MMAPS", "POSIX_FASTEST_RANK", "POSIX_SLOWEST_RANK", "POSIX_SLOWEST_RANK_BYTES", *rounded("runtime_seconds"))


_STEPS = ["require_posix", "min_runtime", "min_bytes", "min_ops", "valid_times"]
_KEPT = ["count(*)"] + [f"count(*) FILTER ({' AND '.join(f'({p})' for p in sql.PASSES[:i])})" for i in range(1, 6)]


@register("C9_cleaning_report", f"WITH {sql.RAW} " + " UNION ALL ".join(f"SELECT '{s}' AS step, {_KEPT[i + 1]} AS surviving, {_KEPT[i]} - {_KEPT[i + 1]} AS removed, {sql.r6(f'coalesce(100.0 * ({_KEPT[i]} - {_KEPT[i + 1]}) / nullif({_KEPT[i]}, 0), 0)')} AS pct FROM raw" for i, s in enumerate(_STEPS)))
def c9(spark, sf_dir):
    return features.cleaning_report(raw(spark, sf_dir)).select("step", "surviving", "removed", *rounded("pct"))


@register("D1_D39_derived", f"WITH {sql.ENGINEERED} SELECT _jobid, {sql.rounded(DERIVED)} FROM engineered")
def d1(spark, sf_dir):
    return engineered(spark, sf_dir).select("_jobid", *rounded(*DERIVED))


@register("E1_E24_codes", f"WITH {sql.LABELS} SELECT _jobid, {', '.join(rules.CODES)} FROM labels_")
def e1(spark, sf_dir):
    return labelled(spark, sf_dir).select("_jobid", *rules.CODES)


@register("E25_E27_labels", f"WITH {sql.LABELS} SELECT _jobid, {', '.join(DIMENSIONS)}, {sql.r6('confidence')} AS confidence, label_source FROM labels_ WHERE confidence >= 0.5")
def e25(spark, sf_dir):
    return rules.labelled(engineered(spark, sf_dir), 0.5).select("_jobid", *DIMENSIONS, *rounded("confidence"), "label_source")


@register("E28_label_summary", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST(sum({d}) AS BIGINT) AS n, {sql.r6(f'100.0 * sum({d}) / count(*)')} AS pct FROM labels_" for d in DIMENSIONS))
def e28(spark, sf_dir):
    return rules.label_summary(labelled(spark, sf_dir)).select("dimension", "n", *rounded("pct"))


@register("I11_code_rates", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{c}' AS code, '{rules.SEVERITY[c]}' AS severity, CAST(sum({c}) AS BIGINT) AS n, {sql.r6(f'sum({c}) / CAST(count(*) AS DOUBLE)')} AS rate FROM labels_" for c in rules.CODES))
def i11(spark, sf_dir):
    return rules.code_rates(labelled(spark, sf_dir)).select("code", "severity", "n", *rounded("rate"))


@register("label_rates", f"WITH {sql.LABELS} SELECT _benchmark AS benchmark, count(*) AS jobs, {', '.join(f'{sql.r6(f"avg({d})")} AS {d}' for d in DIMENSIONS)} FROM labels_ GROUP BY _benchmark")
def label_rates(spark, sf_dir):
    """Flagship: label rates per benchmark."""
    return labelled(spark, sf_dir).groupBy(F.col("_benchmark").alias("benchmark")).agg(F.count("*").alias("jobs"), *[r6(F.avg(d)).alias(d) for d in DIMENSIONS])


assert all(rule_of(c) != "top4" or c in _PLACES for c in MODULE_OF)

# The other query modules register theirs on import.
from ioloom.plans import claim_queries, diagnosis_queries, evidence_queries, feature_queries, file_queries, label_queries, metric_queries, model_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
