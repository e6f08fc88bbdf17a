"""Job rows: raw assembly, cleaning, validation and derived features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ioloom.functions.counters import ALL_COUNTERS, DERIVED

EPS = 1e-9


@dataclass(frozen=True)
class CleanRules:
    """Thresholds of the cleaning filters."""

    require_posix: bool = True
    min_runtime: float = 1.0
    min_bytes: int = 1024
    min_ops: int = 1
    rank_sentinel: int = 0


def ensure_columns(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """df with exactly these columns in this order; missing ones hold default."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def assemble(merged: DataFrame, jobs: DataFrame) -> DataFrame:
    """Merged records and job headers as one raw row per job, counters as doubles, missing ones 0."""
    return assembled(merged.join(jobs, "jobid"), merged.columns)


def assembled(joined: DataFrame, counters: list[str]) -> DataFrame:
    """assemble for merged records that have their job's header beside them; counters: the columns of the records."""
    has = lambda column, *names: f"CAST(arrays_overlap(modules, array({', '.join(repr(n) for n in names)})) AS INT) AS {column}"
    number = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0D) AS {c}" if c in counters else f"0D AS {c}"
    return joined.selectExpr(
        "jobid AS _jobid", "uid AS _uid", "start_time AS _start_time", "array_join(modules, ',') AS _modules", *[f"{c} AS _{c}" for c in ("benchmark", "scenario") if c in joined.columns],
        "CAST(greatest(coalesce(nprocs, 1), 1) AS DOUBLE) AS nprocs", "greatest(coalesce(CAST(runtime AS DOUBLE), 0D), 0D) AS runtime_seconds", *map(number, ALL_COUNTERS),
        has("has_posix", "POSIX"), has("has_mpiio", "MPI-IO"), has("has_stdio", "STDIO"), has("has_hdf5", "H5F", "H5D"), has("has_pnetcdf", "PNETCDF_FILE", "PNETCDF_VAR", "PNETCDF"), has("has_apmpi", "APMPI"), has("has_heatmap", "HEATMAP"),
        "coalesce(CAST(shared_posix AS INT), 0) AS is_shared_file", "CAST(num_files AS DOUBLE) AS num_files",
    )


def clean_steps(rules: CleanRules = CleanRules()) -> dict[str, Column]:
    """The filters in their order, by name."""
    c = F.col
    return {
        "require_posix": (c("has_posix") == 1) if rules.require_posix else F.lit(True),
        "min_runtime": c("runtime_seconds") >= rules.min_runtime,
        "min_bytes": c("POSIX_BYTES_READ") + c("POSIX_BYTES_WRITTEN") >= rules.min_bytes,
        "min_ops": c("POSIX_READS") + c("POSIX_WRITES") >= rules.min_ops,
        "valid_times": (c("POSIX_F_READ_TIME") >= 0) & (c("POSIX_F_WRITE_TIME") >= 0) & (c("POSIX_F_META_TIME") >= 0),
    }


def clean(raw: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Rows that pass every filter, sentinels of rank counters and MMAPS replaced."""
    rows = raw
    for condition in clean_steps(rules).values():
        rows = rows.filter(condition)
    to = {c: float(rules.rank_sentinel) for c in ("POSIX_FASTEST_RANK", "POSIX_SLOWEST_RANK", "POSIX_FASTEST_RANK_BYTES", "POSIX_SLOWEST_RANK_BYTES")} | {"POSIX_MMAPS": 0.0}
    return rows.withColumns({c: F.when(F.col(c) == -1, F.lit(v)).otherwise(F.col(c)) for c, v in to.items()})


def cleaning_report(raw: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """step, surviving, removed, pct of the rows before the step; all counted in one pass."""
    steps, passed = clean_steps(rules), F.lit(True)
    counts = [F.count("*").alias("n0")]
    for i, condition in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    row = raw.agg(*counts)
    steps_array = F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"n{i}").alias("surviving"), (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("removed"), F.coalesce(F.try_divide((F.col(f"n{i - 1}") - F.col(f"n{i}")) * 100.0, F.col(f"n{i - 1}")), F.lit(0.0)).alias("pct")) for i, name in enumerate(steps, 1)])
    return row.select(F.explode(steps_array).alias("x")).select("x.*")


def numeric_columns(df: DataFrame) -> list[str]:
    """Feature columns: numbers whose name doesn't begin with an underscore."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")]


def validate(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """feature, nan_count, inf_count, all_zero, enough_rows; tasks count by column in batches."""
    columns = numeric_columns(df)
    sums = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(lambda batches: _column_counts(batches, columns), "feature string, n bigint, nan bigint, inf bigint, nonzero bigint")
    out = sums.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "nan", "inf", "nonzero")])
    # Tables without rows have no counts.
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    got = names.join(F.broadcast(out), "feature", "left").fillna(0, ["n", "nan", "inf", "nonzero"])
    return got.select("feature", F.col("nan").alias("nan_count"), F.col("inf").alias("inf_count"), (F.col("nonzero") == 0).alias("all_zero"), (F.col("n") >= min_rows).alias("enough_rows"))


def _column_counts(batches, columns: list[str]):
    """A row a column: rows, missing values, infinite ones, and those that aren't zero (NaN included)."""
    totals = np.zeros((4, len(columns)), np.int64)
    for batch in batches:
        for i, c in enumerate(batch.columns):
            v = c.to_numpy(zero_copy_only=False)
            totals[:, i] += len(v), np.count_nonzero(np.isnan(v)), np.count_nonzero(np.isinf(v)), np.count_nonzero(v) - c.null_count
    yield pa.RecordBatch.from_arrays([pa.array(columns, pa.string()), *map(pa.array, totals)], names=["feature", "n", "nan", "inf", "nonzero"])


def signed_log(c: Column) -> Column:
    """sign(x) * log1p(|x|), missing and infinite values as 0."""
    x = F.signum(c) * F.log1p(F.abs(c))
    return F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def derived_columns() -> dict[str, Column]:
    """The 39 derived features, in their order, over columns without sentinels."""
    c = lambda name: F.col(f"POSIX_{name}")
    m = lambda *names: sum((F.col(f"MPIIO_{n}") for n in names[1:]), F.col(f"MPIIO_{names[0]}"))
    at_least = lambda x, low: F.greatest(x, F.lit(low))
    bins = lambda way, names: sum((c(f"SIZE_{way}_{n}") for n in names[1:]), c(f"SIZE_{way}_{names[0]}"))
    small, medium, large = ("0_100", "100_1K"), ("1K_10K", "10K_100K", "100K_1M"), ("1M_4M", "4M_10M", "10M_100M", "100M_1G", "1G_PLUS")
    reads, writes, br, bw = c("READS"), c("WRITES"), c("BYTES_READ"), c("BYTES_WRITTEN")
    rt, wt, mt = c("F_READ_TIME"), c("F_WRITE_TIME"), c("F_META_TIME")
    per_read, per_write, per_op = at_least(reads, 1.0), at_least(writes, 1.0), at_least(reads + writes, 1.0)
    total, time, procs = br + bw, rt + wt + mt, at_least(F.col("nprocs"), 1.0)
    coll, indep, nb = m("COLL_READS", "COLL_WRITES"), m("INDEP_READS", "INDEP_WRITES"), m("NB_READS", "NB_WRITES")
    mpi = at_least(coll + indep + nb, 1.0)
    return {
        "read_ratio": br / at_least(total, 1.0),
        "read_bw_mb_s": br / at_least(rt, EPS) / 1e6, "write_bw_mb_s": bw / at_least(wt, EPS) / 1e6, "total_bw_mb_s": total / at_least(rt + wt, EPS) / 1e6,
        "avg_read_size": br / per_read, "avg_write_size": bw / per_write,
        "small_read_ratio": bins("READ", small) / per_read, "small_write_ratio": bins("WRITE", small) / per_write, "small_io_ratio": (bins("READ", small) + bins("WRITE", small)) / per_op,
        "medium_read_ratio": bins("READ", medium) / per_read, "medium_write_ratio": bins("WRITE", medium) / per_write,
        "large_read_ratio": bins("READ", large) / per_read, "large_write_ratio": bins("WRITE", large) / per_write,
        "seq_read_ratio": c("SEQ_READS") / per_read, "seq_write_ratio": c("SEQ_WRITES") / per_write, "consec_read_ratio": c("CONSEC_READS") / per_read, "consec_write_ratio": c("CONSEC_WRITES") / per_write,
        "rw_ratio": reads / per_write, "rw_switch_ratio": c("RW_SWITCHES") / per_op,
        "mem_misalign_ratio": c("MEM_NOT_ALIGNED") / per_op, "file_misalign_ratio": c("FILE_NOT_ALIGNED") / per_op,
        "metadata_time_ratio": mt / at_least(time, EPS), "read_time_fraction": rt / at_least(time, EPS), "write_time_fraction": wt / at_least(time, EPS),
        "opens_per_op": c("OPENS") / per_op, "stats_per_op": c("STATS") / per_op, "seeks_per_op": c("SEEKS") / per_op, "fsync_ratio": c("FSYNCS") / per_write, "opens_per_mb": c("OPENS") / at_least(total / 1e6, EPS),
        "rank_bytes_cv": F.sqrt(at_least(c("F_VARIANCE_RANK_BYTES"), 0.0)) / at_least(total / procs, EPS), "rank_time_cv": F.sqrt(at_least(c("F_VARIANCE_RANK_TIME"), 0.0)) / at_least(time / procs, EPS),
        "byte_imbalance": (c("SLOWEST_RANK_BYTES") - c("FASTEST_RANK_BYTES")) / at_least(total, EPS), "time_imbalance": (c("F_SLOWEST_RANK_TIME") - c("F_FASTEST_RANK_TIME")) / at_least(time, EPS),
        "collective_ratio": coll / mpi, "nonblocking_ratio": nb / mpi,
        "io_duration": at_least(c("F_CLOSE_END_TIMESTAMP") - c("F_OPEN_START_TIMESTAMP"), 0.0), "io_active_fraction": time / at_least(F.col("runtime_seconds"), EPS),
        "access_size_concentration": c("ACCESS1_COUNT") / per_op, "dominant_access_size": c("ACCESS1_ACCESS"),
    }


def engineer(cleaned: DataFrame) -> DataFrame:
    """cleaned with -1 replaced by 0 in every feature and the derived features added: two projections."""
    features = set(numeric_columns(cleaned))
    whole = cleaned.selectExpr(*[f"CAST(CASE WHEN {c} = -1 THEN 0D ELSE {c} END AS DOUBLE) AS {c}" if c in features else c for c in cleaned.columns])
    made = derived_columns()
    return whole.select("*", *[made[c].alias(c) for c in DERIVED])


#: Features that stand for a job in a signature.
SIGNATURE = ["nprocs", "runtime_seconds", "POSIX_BYTES_READ", "POSIX_BYTES_WRITTEN", "POSIX_READS", "POSIX_WRITES", "read_ratio", "total_bw_mb_s", "avg_read_size", "avg_write_size", "small_io_ratio", "seq_read_ratio", "seq_write_ratio", "metadata_time_ratio", "byte_imbalance", "collective_ratio", "is_shared_file"]


def signature(columns: list[str] | None = None) -> Column:
    """map of feature -> value rounded to 4 places, missing values left out."""
    names = columns or SIGNATURE
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.round(F.col(c).cast("double"), 4) for c in names]))
    return F.map_filter(values, lambda _, v: v.isNotNull() & ~F.isnan(v))
