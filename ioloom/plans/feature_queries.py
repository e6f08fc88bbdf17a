"""Queries of statistics, normalization, splits, characterization and joins (survey 2.G to 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.functions.counters import ALL_COUNTERS, DERIVED, DIMENSIONS, INDICATORS, group_of
from ioloom.operators import characterize, prepare, relate, stats
from ioloom.plans import sql
from ioloom.plans.core import r6, register, rounded
from ioloom.plans.sql import r6 as q6
from ioloom.plans.stages import engineered, engineered_whole, labelled
from ioloom.sources import surrogate

COLS = ["nprocs", "runtime_seconds", "POSIX_BYTES_READ", "POSIX_READS", "POSIX_F_META_TIME", "read_ratio", "avg_read_size", "metadata_time_ratio", "has_hdf5"]
_E = f"WITH {sql.ENGINEERED}"


def _long(where: str = "", table: str = "engineered") -> str:
    return " UNION ALL ".join(f"SELECT _jobid, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table} {where}" for c in COLS)


def feats(spark, sf_dir):
    return engineered(spark, sf_dir).select("_jobid", "_start_time", "_uid", "_benchmark", "_scenario", *COLS)


#: All feature columns, as stats.feature_columns finds them in engineered rows, and them as SQL rows.
FEATURES = ["nprocs", "runtime_seconds", *ALL_COUNTERS, *INDICATORS, "num_files", *DERIVED]
_EM = _E.replace("engineered AS (", "engineered AS MATERIALIZED (")


def _all(where: str = "true") -> str:
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    return f"SELECT _jobid, feature, value FROM (SELECT _jobid, {columns} FROM engineered WHERE {where}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)}))"


_Q = ", ".join(f"{q6(f'quantile_cont(value, {q})')} AS {n}" for n, q in stats.QUANTILES.items())


@register("G1_G2_profile", f"""{_E}, long AS ({_long()}) SELECT feature, count(value) AS count, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max, {_Q},
round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis, {q6('avg(CAST(value = 0 AS INT))')} AS zero_fraction, {q6('avg(CAST(value < 0 AS INT))')} AS negative_fraction, count(*) FILTER (value <> 0) AS nonzero_count,
CASE feature {' '.join(f"WHEN '{c}' THEN '{group_of(c)}'" for c in COLS)} END AS feature_group FROM long WHERE feature <> 'has_hdf5' GROUP BY feature""")
def g1(spark, sf_dir):
    out = stats.profile(feats(spark, sf_dir), COLS[:-1])
    return out.select("feature", "count", *rounded("mean", "std"), "min", "max", *rounded(*stats.QUANTILES), F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"), *rounded("zero_fraction", "negative_fraction"), "nonzero_count", "feature_group")


_PAIRS = [(a, b) for i, a in enumerate(COLS[:-1]) for b in COLS[i + 1 : -1]]


@register("G4_pearson", f"{_E} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM engineered" for a, b in _PAIRS))
def g4(spark, sf_dir):
    return stats.correlation(feats(spark, sf_dir), COLS[:-1]).select("a", "b", F.round("rho", 6).alias("rho"))


_RANKED = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLS[:-1]) + " FROM engineered)"


@register("G3_spearman", f"{_E}, {_RANKED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM ranked" for a, b in _PAIRS))
def g3(spark, sf_dir):
    return stats.correlation(feats(spark, sf_dir), COLS[:-1], "spearman").select("a", "b", F.round("rho", 6).alias("rho"))


@register("G5_redundant_pairs", f"{_E}, {_RANKED}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM ranked" for a, b in _PAIRS) + ") SELECT * FROM c WHERE abs(rho) >= 0.5")
def g5(spark, sf_dir):
    return stats.redundant(stats.correlation(feats(spark, sf_dir), COLS[:-1], "spearman"), 0.5).select("a", "b", F.round("rho", 6).alias("rho"))


@register("G6_sparse_features", f"{_EM}, long AS ({_all()}) SELECT feature, {q6('avg(CAST(value = 0 AS INT))')} AS zero_fraction FROM long GROUP BY feature HAVING avg(CAST(value = 0 AS INT)) > 0.99")
def g6(spark, sf_dir):
    df = engineered(spark, sf_dir)
    return stats.sparse(stats.zero_fractions(df, stats.feature_columns(df))).select("feature", *rounded("zero_fraction"))


@register("G7_group_summary", f"""{_E}, long AS ({_long()}), p AS (SELECT CASE feature {' '.join(f"WHEN '{c}' THEN '{group_of(c)}'" for c in COLS)} END AS feature_group, skewness(value) AS s, kurtosis(value) AS k, avg(CAST(value = 0 AS INT)) AS z FROM long WHERE feature <> 'has_hdf5' GROUP BY feature)
SELECT feature_group, count(*) AS n_features, round(median(s), 4) AS median_skewness, round(median(k), 4) AS median_kurtosis, {q6('avg(z)')} AS mean_zero_fraction FROM p GROUP BY feature_group""")
def g7(spark, sf_dir):
    out = stats.group_summary(stats.profile(feats(spark, sf_dir), COLS[:-1]))
    return out.select("feature_group", "n_features", F.round("median_skewness", 4).alias("median_skewness"), F.round("median_kurtosis", 4).alias("median_kurtosis"), *rounded("mean_zero_fraction"))


@register("G8_G9_drop_constants", f"{_EM}, long AS ({_all()}) SELECT feature FROM long GROUP BY feature HAVING stddev_samp(value) <> 0")
def g8(spark, sf_dir):
    df = engineered(spark, sf_dir)
    kept = stats.feature_columns(df.drop(*stats.constants(df, stats.feature_columns(df))))
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@register("G8_drop_constants", f"{_E} SELECT _jobid, {', '.join(q6(c) + ' AS ' + c for c in COLS[:-1])} FROM engineered")
def g8_table(spark, sf_dir):
    df = feats(spark, sf_dir).select("_jobid", *COLS)
    return df.drop(*stats.constants(df, COLS)).select("_jobid", *rounded(*COLS[:-1]))


@register("G10_audit", f"{_E}, long AS ({_long()}) SELECT feature, abs(skewness(value)) > 10 AS skewed, kurtosis(value) > 100 AS heavy, stddev_samp(value) > 50 AS wide, stddev_samp(value) < 0.001 AS narrow, greatest(abs(min(value)), abs(max(value))) > 100 AS far, stddev_samp(value) = 0 AS constant FROM long WHERE feature <> 'has_hdf5' GROUP BY feature")
def g10(spark, sf_dir):
    return stats.audit(feats(spark, sf_dir), COLS[:-1])


@register("G12_covariate_shift", f"{_EM}, long AS ({_all('_jobid % 3 = 0')}), other AS ({_all('_jobid % 3 <> 0')}), a AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY feature), b AS (SELECT feature, avg(value) AS m2 FROM other GROUP BY feature) SELECT a.feature, {q6('abs(m - m2) / (s + 1e-10)')} AS shift, abs(m - m2) / (s + 1e-10) > 0.05 AS shifted FROM a JOIN b ON a.feature = b.feature")
def g12(spark, sf_dir):
    df = engineered(spark, sf_dir)
    return stats.covariate_shift(df.filter("_jobid % 3 = 0"), df.filter("_jobid % 3 <> 0"), stats.feature_columns(df), 0.05).select("feature", *rounded("shift"), "shifted")


@register("G13_ks", f"""{_EM}, both_ AS (SELECT feature, value, CAST(_jobid % 3 = 0 AS INT) AS one FROM ({_all()})), at_ AS (SELECT feature, value, sum(one) AS n1, sum(1 - one) AS n0 FROM both_ GROUP BY feature, value),
g AS (SELECT feature, abs(CAST(sum(n1) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(n1) OVER (PARTITION BY feature) - CAST(sum(n0) OVER (PARTITION BY feature ORDER BY value) AS DOUBLE) / sum(n0) OVER (PARTITION BY feature)) AS gap FROM at_) SELECT feature, {q6('max(gap)')} AS ks FROM g GROUP BY feature""")
def g13(spark, sf_dir):
    df = engineered(spark, sf_dir)
    return stats.ks_statistic(df.filter("_jobid % 3 = 0"), df.filter("_jobid % 3 <> 0"), stats.feature_columns(df)).select("feature", *rounded("ks"))


@register("G14_mad_outliers", f"""{_EM}, long AS ({_all()}), m AS (SELECT feature, quantile_cont(value, 0.5) AS mid, avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY feature),
d AS (SELECT l.feature, value, mid, mean, sd, abs(value - mid) AS dev FROM long l JOIN m ON l.feature = m.feature), k AS (SELECT feature, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY feature)
SELECT d.feature, {q6('avg(CASE WHEN mad > 1e-10 THEN CAST(dev / (1.4826 * mad) > 3 AS INT) WHEN sd > 1e-10 THEN CAST(abs(value - mean) / sd > 3 AS INT) ELSE 0 END)')} AS outlier_ratio FROM d JOIN k ON d.feature = k.feature GROUP BY d.feature""")
def g14(spark, sf_dir):
    df = engineered_whole(spark, sf_dir)
    return stats.mad_outliers(df, stats.feature_columns(df)).select("feature", *rounded("outlier_ratio"))


@register("G16_range_check", f"{_EM}, long AS ({_all()}) SELECT feature, quantile_cont(value, 0.05) >= -10 AND quantile_cont(value, 0.95) <= 10 AS in_range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) BETWEEN 0.1 AND 10 AS iqr_ok FROM long GROUP BY feature")
def g16(spark, sf_dir):
    df = engineered_whole(spark, sf_dir)
    return stats.range_check(df, stats.feature_columns(df))


# ---- normalization and splits


@register("H1_H4_normalize", f"""{_E}, s AS (SELECT {', '.join(f"quantile_cont(ln(1 + greatest({c}, 0)), 0.5) AS m_{c}, quantile_cont(ln(1 + greatest({c}, 0)), 0.75) - quantile_cont(ln(1 + greatest({c}, 0)), 0.25) AS w_{c}" for c in COLS)} FROM engineered WHERE _jobid % 4 <> 0)
SELECT _jobid, {', '.join(q6({'none': c, 'log1p': f'ln(1 + greatest({c}, 0))', 'log1p_robust': f'(ln(1 + greatest({c}, 0)) - m_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END'}[prepare.method_of(c)]) + f' AS {c}' for c in COLS)} FROM engineered, s""")
def h1(spark, sf_dir):
    df = feats(spark, sf_dir)
    return prepare.normalize(df, COLS, prepare.fit_robust(df.filter("_jobid % 4 <> 0"), COLS)).select("_jobid", *rounded(*COLS))


@register("H5_temporal_split", f"WITH {sql.JOBS}, o AS (SELECT jobid, row_number() OVER (ORDER BY start_time, jobid) - 1 AS k, count(*) OVER () AS n FROM jobs) SELECT jobid, CASE WHEN k < n - CAST(floor(n * 0.15) AS BIGINT) - CAST(floor(n * 0.15) AS BIGINT) THEN 'train' WHEN k < n - CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM o")
def h5(spark, sf_dir):
    return prepare.temporal_split(surrogate.jobs(spark, sf_dir), "start_time", "jobid").select("jobid", "split")


_STRATA = {k: ", ".join(f"gt_{d}" for d in dims) for k, dims in (("all", surrogate.PREDICTION_DIMS), ("two", ["access_granularity", "access_pattern"]))}


def _hash(key: str) -> str:
    """prepare.hash_order in SQL, and the key."""
    return f"md5(CAST({key} AS VARCHAR) || ':42'), {key}"


@register("H6_random_split", f"WITH {sql.JOBS}, o AS (SELECT jobid, row_number() OVER (ORDER BY {_hash('jobid')}) - 1 AS k, CAST(floor(count(*) OVER () * 0.15) AS BIGINT) AS part FROM jobs) SELECT jobid, CASE WHEN k < part THEN 'test' WHEN k < 2 * part THEN 'val' ELSE 'train' END AS split FROM o")
def h6(spark, sf_dir):
    return prepare.random_split(surrogate.jobs(spark, sf_dir), "jobid").select("jobid", "split")


@register("H7_stratified_split", f"WITH p AS ({surrogate.predictions_sql()}), o AS (SELECT job_id, row_number() OVER (PARTITION BY {_STRATA['all']} ORDER BY {_hash('job_id')}) AS k, count(*) OVER (PARTITION BY {_STRATA['all']}) AS n FROM p) SELECT job_id, CASE WHEN n > 1 AND k <= round(n * CAST(0.3 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM o")
def h7(spark, sf_dir):
    return prepare.stratified_split(surrogate.predictions(spark, sf_dir), [f"gt_{d}" for d in surrogate.PREDICTION_DIMS], "job_id").select("job_id", "split")


@register("H8_stratified_sample", f"WITH p AS ({surrogate.predictions_sql()}), o AS (SELECT job_id, {_STRATA['two']}, row_number() OVER (PARTITION BY {_STRATA['two']} ORDER BY {_hash('job_id')}) AS k, count(*) OVER (PARTITION BY {_STRATA['two']}) AS c, count(*) OVER () AS n FROM p) SELECT job_id, {_STRATA['two']} FROM o ORDER BY k > greatest(floor(c * 200 / CAST(n AS DOUBLE)), 1), {_hash('job_id')} LIMIT 200")
def h8(spark, sf_dir):
    return prepare.stratified_sample(surrogate.predictions(spark, sf_dir), ["gt_access_granularity", "gt_access_pattern"], 200, "job_id").select("job_id", "gt_access_granularity", "gt_access_pattern")


@register("H9_H10_sample_per_class", f"WITH p AS ({surrogate.predictions_sql()}) SELECT job_id, benchmark FROM p QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY {_hash('job_id')}) <= 25")
def h9(spark, sf_dir):
    return prepare.sample_per(surrogate.predictions(spark, sf_dir), "benchmark", 25, "job_id").select("job_id", "benchmark")


@register("H11_folds", f"WITH {sql.JOBS} SELECT CAST('0x' || substr({_hash('jobid').split(', ')[0]}, 1, 8) AS BIGINT) % 5 AS fold, count(*) AS n FROM jobs GROUP BY 1")
def h11(spark, sf_dir):
    return prepare.folds(surrogate.jobs(spark, sf_dir), "jobid").groupBy("fold").agg(F.count("*").alias("n"))


@register("H12_leave_one_out", f"WITH {sql.JOBS} SELECT 'test' AS part, count(*) AS n FROM jobs WHERE benchmark = '5-LOW' UNION ALL SELECT 'train', count(*) FROM jobs WHERE benchmark <> '5-LOW'")
def h12(spark, sf_dir):
    train, test = prepare.leave_one_out(surrogate.jobs(spark, sf_dir), "benchmark", "5-LOW")
    return test.agg(F.lit("test").alias("part"), F.count("*").alias("n")).unionAll(train.agg(F.lit("train").alias("part"), F.count("*").alias("n")))


# ---- characterization


@register("I1_I2_basic_stats", f"{_E} SELECT count(*) AS n_rows, count(DISTINCT _jobid) AS n_jobs, min(_start_time) AS first_start, max(_start_time) AS last_start, {q6('avg(nprocs)')} AS mean_nprocs, {q6('median(nprocs)')} AS median_nprocs, max(nprocs) AS max_nprocs, {q6('100.0 * avg(CAST(nprocs = 1 AS INT))')} AS single_pct, {q6('median(runtime_seconds)')} AS median_runtime, sum(POSIX_BYTES_READ) AS bytes_read, sum(POSIX_BYTES_WRITTEN) AS bytes_written, {q6('100.0 * avg(CAST(POSIX_BYTES_READ + POSIX_BYTES_WRITTEN = 0 AS INT))')} AS zero_io_pct FROM engineered")
def i1(spark, sf_dir):
    return characterize.basic_stats(engineered(spark, sf_dir)).select("n_rows", "n_jobs", "first_start", "last_start", *rounded("mean_nprocs", "median_nprocs"), "max_nprocs", *rounded("single_pct", "median_runtime"), "bytes_read", "bytes_written", *rounded("zero_io_pct"))


@register("I3_module_combos", f"WITH {sql.RAW} SELECT _modules, count(*) AS n FROM raw GROUP BY _modules ORDER BY n DESC, _modules LIMIT 15")
def i3(spark, sf_dir):
    from ioloom.plans.stages import raw

    return characterize.module_combos(raw(spark, sf_dir))


@register("I5_workload_types", f"""{_E} SELECT CASE WHEN POSIX_OPENS > 1000 AND total < 1e8 AND total >= 1e6 THEN 'metadata_heavy' WHEN has_mpiio = 1 AND total > 1e6 THEN 'traditional_hpc' WHEN has_stdio = 1 AND has_mpiio = 0 AND nprocs >= 1 AND total >= 1e6 THEN 'likely_ai_ml' WHEN total < 1e6 THEN 'minimal_io' ELSE 'other' END AS workload, count(*) AS n FROM (SELECT *, POSIX_BYTES_READ + POSIX_BYTES_WRITTEN + STDIO_BYTES_READ + STDIO_BYTES_WRITTEN AS total FROM engineered) t GROUP BY 1""")
def i5(spark, sf_dir):
    return characterize.workload_types(engineered(spark, sf_dir)).groupBy("workload").agg(F.count("*").alias("n"))


@register("I6_jobs_per_month", f"WITH {sql.JOBS} SELECT strftime(to_timestamp(start_time), '%Y-%m') AS month, count(*) AS n FROM jobs GROUP BY 1")
def i6(spark, sf_dir):
    return characterize.per_month(surrogate.jobs(spark, sf_dir), "start_time")


@register("I8_histogram", f"WITH {sql.JOBS} SELECT CAST(floor(ln(1 + greatest(runtime, 0)) / 0.5) AS BIGINT) AS bin, count(*) AS n FROM jobs GROUP BY 1")
def i8(spark, sf_dir):
    return characterize.log_histogram(surrogate.jobs(spark, sf_dir), "runtime", 0.5)


_LAB = f"WITH {sql.LABELS}"
_CO = " UNION ALL ".join(f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, CAST(sum({a} * {b}) AS BIGINT) AS n, CASE WHEN sum({a}) > 0 THEN {q6(f'sum({a} * {b}) / CAST(sum({a}) AS DOUBLE)')} ELSE 0 END AS p_b_given_a FROM labels_" for a in DIMENSIONS for b in DIMENSIONS)


@register("I9_co_occurrence", f"{_LAB} {_CO}")
def i9(spark, sf_dir):
    return characterize.co_occurrence(labelled(spark, sf_dir), DIMENSIONS).select("dim_a", "dim_b", "n", *rounded("p_b_given_a"))


@register("I10_cardinality", f"{_LAB} SELECT {' + '.join(DIMENSIONS[:-1])} AS n_labels, count(*) AS n FROM labels_ GROUP BY 1")
def i10(spark, sf_dir):
    return characterize.cardinality(labelled(spark, sf_dir), DIMENSIONS[:-1])


@register("I12_facility_rates", f"{_LAB} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST(sum({d}) AS BIGINT) AS n, {q6(f'avg({d})')} AS rate FROM labels_" for d in DIMENSIONS))
def i12(spark, sf_dir):
    return characterize.facility_rates(labelled(spark, sf_dir), DIMENSIONS).select("dimension", "n", *rounded("rate"))


@register("I13_scenario_signature", f"{_E} SELECT _scenario, {', '.join(q6(f'avg({c})') + f' AS {c}' for c in COLS)} FROM engineered GROUP BY _scenario")
def i13(spark, sf_dir):
    return feats(spark, sf_dir).groupBy("_scenario").agg(*[r6(F.avg(c)).alias(c) for c in COLS])


# ---- joins


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


@register("J1_features_labels", "SELECT d.doc_id, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j1(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@register("J2_occurrence_join", """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS occurrence FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS other_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS occurrence FROM events WHERE event_type = 'view')
SELECT a.user_id, a.occurrence, event_id, other_id FROM a JOIN b ON a.user_id = b.user_id AND a.occurrence = b.occurrence""")
def j2(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a, b = e.filter("event_type = 'click'").select("user_id", "event_id"), e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("other_id"))
    return relate.occurrence_join(a, b, ["user_id"], "event_id", "other_id").select("user_id", "occurrence", "event_id", "other_id")


@register("J3_nearest_interval", """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_, event_type FROM events), s AS (SELECT user_id AS u, at_ - 600 AS step_start, at_ + 900 AS step_end FROM e WHERE event_type = 'purchase'),
j AS (SELECT event_id, user_id, step_start, step_end, row_number() OVER (PARTITION BY event_id ORDER BY abs(at_ - step_end), step_start) AS k FROM e JOIN s ON user_id = u AND at_ BETWEEN step_start - 60 AND step_end + 60 WHERE event_type <> 'purchase') SELECT event_id, user_id, step_start, step_end FROM j WHERE k = 1""")
def j3(spark, sf_dir):
    e = _events(spark, sf_dir)
    steps = e.filter("event_type = 'purchase'").select("user_id", (F.col("at") - 600).alias("s"), (F.col("at") + 900).alias("t"))
    return relate.nearest_interval(e.filter("event_type <> 'purchase'"), steps, "user_id", "at", "s", "t", 60, "event_id").select("event_id", "user_id", "step_start", "step_end")


@register("J4_unmapped", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY o_custkey")
def j4(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return relate.unmapped(_orders(spark, sf_dir), known, "o_custkey")


@register("J5_longest_prefix", """WITH k AS (SELECT DISTINCT substr(p_name, 1, CAST(2 + p_partkey % 6 AS INT)) AS label FROM part), n AS (SELECT DISTINCT p_name FROM part),
j AS (SELECT p_name, label, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN label IS NULL THEN 0 WHEN label = p_name THEN 0 ELSE 1 END, length(label) DESC NULLS LAST, label) AS r FROM n LEFT JOIN k ON starts_with(p_name, label) OR starts_with(label, p_name)) SELECT p_name, label FROM j WHERE r = 1""")
def j5(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keys = part.select(F.expr("substring(p_name, 1, cast(2 + p_partkey % 6 as int))").alias("key")).distinct()
    return relate.longest_prefix(part.select("p_name").distinct(), "p_name", keys, "key")


@register("J8_pending", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority AND d.o_orderstatus <> 'F')")
def j8(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return relate.pending(o.select("o_custkey", "o_orderpriority").distinct(), o, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F")


@register("J10_union_all", "SELECT n_name AS name, n_regionkey AS key, NULL AS comment FROM nation UNION ALL SELECT r_name, r_regionkey, 'region' FROM region")
def j10(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    return relate.union_all(n, spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), F.lit("region").alias("comment")))


@register("J13_top_k", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def j13(spark, sf_dir):
    return relate.top_k(_orders(spark, sf_dir), 5, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", "o_totalprice")


@register("J14_chunks", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ceil(count(*) OVER () / 7.0)) AS BIGINT) AS chunk FROM orders")
def j14(spark, sf_dir):
    return relate.chunks(_orders(spark, sf_dir), "o_orderkey", 7).select("o_orderkey", "chunk")
