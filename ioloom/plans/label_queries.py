"""Queries of labelling, log paths, recommendation scoring and small transforms (survey 2.A, 2.C, 2.E to 2.H, 2.J to 2.N in part).

The SQL spells its tables of words and bounds out, so that it doesn't share them with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.functions.counters import DIMENSIONS
from ioloom.operators import features, groundtruth, knowledge, metrics, models, prepare, relate, rules, runs, stats
from ioloom.plans import sql
from ioloom.plans.core import r6, register, rounded
from ioloom.plans.sql import r6 as q6
from ioloom.plans.stages import engineered, labelled, raw
from ioloom.sources import surrogate, text_logs

DIMS = ", ".join(DIMENSIONS)

# ---- labels from names and counters

_FORMS = "IOR_small_posix_t|ior_random_small_r|mdtest_meta_shared_n|x_interface_posix_shared_|custom_balanced_|h5b_indep_small_n|unknown_|y_fpp_explosion_|custom_imbalance_|dlio_shuffled_|z_checkpoint_|h5bench_healthy_"
_NAME = "concat('/logs/', CASE {id} % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FORMS.split("|"))) + " END, {id} + 1000, '_', {id} % 7, '.darshan')"
_INFERRED = """CASE WHEN contains(n, 'small_posix') OR contains(n, 'small_direct') OR contains(n, 'misaligned') THEN 'access_granularity' WHEN contains(n, 'random_small') THEN 'access_granularity,access_pattern' WHEN contains(n, 'random_posix') THEN 'access_pattern'
WHEN contains(n, 'interface_posix_shared') OR contains(n, 'interface_mpiio_indep') THEN 'interface_choice' WHEN contains(n, 'file_explosion') THEN 'file_strategy' WHEN contains(n, 'fsync_per_write') THEN 'throughput_utilization' WHEN contains(n, 'healthy') THEN 'healthy'
WHEN contains(n, 'meta_shared') OR contains(n, 'meta_unique') OR contains(n, 'meta_cross') OR contains(n, 'deep_tree') THEN 'metadata_intensity' WHEN contains(n, 'fpp_explosion') THEN 'file_strategy' WHEN contains(n, 'dlio_small') THEN 'access_granularity'
WHEN contains(n, 'dlio_ckpt') OR contains(n, 'checkpoint') THEN 'throughput_utilization' WHEN contains(n, 'shuffle') THEN 'access_pattern' WHEN contains(n, 'imbalance') THEN 'parallelism_efficiency' WHEN contains(n, 'balanced') THEN 'healthy' ELSE '' END"""
_TYPE = """CASE WHEN contains(n, 'hacc_io') THEN 'hacc_io' WHEN contains(n, 'h5bench') OR contains(n, 'h5b_') THEN 'h5bench' WHEN contains(n, 'mdtest') THEN 'mdtest' WHEN starts_with(n, 'ior_') OR contains(n, '_ior_') OR contains(n, '_ior ') THEN 'ior'
WHEN contains(n, 'dlio') THEN 'dlio' WHEN contains(n, 'custom_') OR contains(n, 'imbalance') OR contains(n, 'balanced') THEN 'custom' ELSE 'unknown' END"""


@register("F2_F7_inferred_labels", f"WITH {sql.JOBS}, a AS (SELECT jobid, lower(replace({_NAME.format(id='jobid')}, '/logs/', '')) AS n FROM jobs) SELECT jobid, {_INFERRED} AS dims, {_TYPE} AS benchmark, regexp_replace(regexp_replace(n, '_\\d{{4,}}_\\d+.*\\.darshan$', ''), '\\.darshan$', '') AS scenario FROM a")
def f2(spark, sf_dir):
    named = surrogate.jobs(spark, sf_dir).select("jobid", F.expr(_NAME.format(id="jobid")).alias("name"))
    base = F.element_at(F.split("name", "/"), -1)
    return named.select("jobid", F.array_join(F.array_sort(groundtruth.inferred_dims(F.col("name"))), ",").alias("dims"), groundtruth.benchmark_of(base).alias("benchmark"), groundtruth.scenario_of(F.col("name")).alias("scenario"))


_SHOWN = {
    "access_granularity": "small_io_ratio > 0.5", "metadata_intensity": "metadata_time_ratio > 0.3", "parallelism_efficiency": "rank_bytes_cv > 0.3", "access_pattern": "seq_write_ratio < 0.5 AND seq_read_ratio < 0.5",
    "interface_choice": "is_shared_file = 1 AND nprocs > 4 AND (has_mpiio = 0 OR MPIIO_COLL_WRITES = 0)", "file_strategy": "num_files > 100", "throughput_utilization": "write_bw_mb_s < 10 AND POSIX_BYTES_WRITTEN > 1e6",
}
_SHOWN_SQL = f"shown AS (SELECT *, {', '.join(f'CAST(({c}) AS INT) AS {d}' for d, c in _SHOWN.items())} FROM engineered)"


@register("F4_F5_relabelled", f"WITH {sql.ENGINEERED}, {_SHOWN_SQL} SELECT _jobid, {', '.join(_SHOWN)}, CAST({' + '.join(_SHOWN)} = 0 AS INT) AS healthy FROM shown")
def f4(spark, sf_dir):
    return groundtruth.relabelled(engineered(spark, sf_dir)).select("_jobid", *DIMENSIONS)


_KNOWN = {"access_granularity": "0, 1", "access_pattern": "1", "metadata_intensity": "2", "interface_choice": "5", "parallelism_efficiency": "8", "healthy": "4"}
_RANGES = [("access_granularity", "small_io_ratio BETWEEN 0.3 AND 1"), ("metadata_intensity", "metadata_time_ratio BETWEEN 0.05 AND 1"), ("parallelism_efficiency", "rank_bytes_cv BETWEEN 0.2 AND 100"), ("access_pattern", "seq_write_ratio BETWEEN 0 AND 0.7"), ("healthy", "small_io_ratio BETWEEN 0 AND 0.3"), ("interface_choice", "(has_mpiio = 0 OR MPIIO_COLL_WRITES = 0)")]
_ASSIGNED = f"""{sql.ENGINEERED}, {_SHOWN_SQL},
t AS (SELECT *, {', '.join(f"CAST(_jobid % 12 IN ({_KNOWN.get(d, '-1')}) AS INT) AS t_{d}" for d in DIMENSIONS)}, _jobid % 12 IN (0, 1, 2, 4, 5, 8) AS known, lower(replace({_NAME.format(id='_jobid')}, '/logs/', '')) AS n FROM shown),
v AS (SELECT *, runtime_seconds >= 5 AND POSIX_BYTES_READ + POSIX_BYTES_WRITTEN >= 10240 AND POSIX_READS + POSIX_WRITES >= 100 AND ({' + '.join(f'CAST(t_{d} = 1 AND {c} AS INT)' for d, c in _RANGES)}) >= 0.8 * ({' + '.join(f't_{d}' for d, _ in _RANGES)}) AS ok, {_INFERRED} AS words FROM t),
s AS (SELECT *, CASE WHEN NOT known THEN 'inferred' WHEN ok THEN 'construction' ELSE 'relabeled' END AS label_source FROM v),
l AS (SELECT _jobid, label_source, {', '.join(f"CASE label_source WHEN 'construction' THEN t_{d} WHEN 'inferred' THEN CAST(contains(words, '{d}') AS INT) ELSE {d} END AS {d}" for d in DIMENSIONS[:-1])} FROM s),
assigned AS (SELECT *, CAST({' + '.join(DIMENSIONS[:-1])} = 0 AS INT) AS healthy FROM l)"""


def _assigned(spark, sf_dir):
    named = engineered(spark, sf_dir).withColumn("name", F.expr(_NAME.format(id="_jobid").replace("'/logs/', ", "")))
    return groundtruth.assigned(named, "name")


@register("F6_assigned_labels", f"WITH {_ASSIGNED} SELECT _jobid, {DIMS}, label_source, label_source <> 'relabeled' AS label_verified FROM assigned")
def f6(spark, sf_dir):
    return _assigned(spark, sf_dir).select("_jobid", *DIMENSIONS, "label_source", "label_verified")


@register("F12_label_statistics", f"WITH {_ASSIGNED} " + " UNION ALL ".join(f"SELECT label_source, '{d}' AS dimension, CAST(sum({d}) AS BIGINT) AS n, {q6(f'100.0 * sum({d}) / count(*)')} AS pct FROM assigned GROUP BY label_source" for d in DIMENSIONS))
def f12(spark, sf_dir):
    return groundtruth.label_statistics(_assigned(spark, sf_dir)).select("label_source", "dimension", "n", *rounded("pct"))


@register("F8_label_strings", "SELECT p_partkey, CAST(p_partkey % 2 AS INT) AS metadata_intensity, CAST(p_size % 2 AS INT) AS file_strategy FROM part")
def f8(spark, sf_dir):
    text = F.concat(F.lit("metadata_intensity = "), (F.col("p_partkey") % 2).cast("string"), F.lit(", file_strategy="), (F.col("p_size") % 2).cast("string"))
    parsed = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", groundtruth.parse_label_string(text).alias("m"))
    return parsed.select("p_partkey", *[F.col("m")[d].alias(d) for d in ("metadata_intensity", "file_strategy")])


# ---- rules of other tools

_FLAG = {"small_reads": "q % 2 = 0", "small_writes": "q % 5 = 0", "excessive_metadata_access": "q % 3 = 0", "operation_imbalance": "q % 7 = 0", "size_imbalance": "q % 11 = 0", "random_operations": "q % 13 = 0"}


@register("E30_rule_flags", "WITH f AS (SELECT o_orderkey AS jobid, o_orderkey + o_custkey AS q FROM orders), d AS (SELECT jobid, CAST(q % 2 = 0 OR q % 5 = 0 AS INT) AS access_granularity, CAST(q % 3 = 0 AS INT) AS metadata_intensity, CAST(q % 7 = 0 OR q % 11 = 0 AS INT) AS parallelism_efficiency, CAST(q % 13 = 0 AS INT) AS access_pattern, 0 AS interface_choice, 0 AS file_strategy, 0 AS throughput_utilization FROM f) SELECT *, CAST(access_granularity + metadata_intensity + parallelism_efficiency + access_pattern = 0 AS INT) AS healthy FROM d")
def e30(spark, sf_dir):
    flags = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("jobid"), (F.col("o_orderkey") + F.col("o_custkey")).alias("q")).select("jobid", *[F.expr(e).alias(n) for n, e in _FLAG.items()])
    return rules.from_flags(flags, "jobid")


_RULE_CODES = "S01 P01 P02 P03 P04 P05 P06 P07 P08 P09 P10 P11 P12 P13 P14 P15 P16 P17 P18 P19 P21 P22 M01 M02 M03 M04 M05 M06 M07 M08 M09 M10".split()


@register("E29_code_agreement", f"WITH {sql.LABELS}, s AS (SELECT * FROM labels_ WHERE _jobid % 5 = 1 AND _jobid % 7 <> 2), a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER ({c} = 1 AND _jobid % 3 <> 0) AS n_both, count(*) FILTER ({c} = 1 AND _jobid % 3 = 0) AS n_ours, count(*) FILTER ({c} = 0 AND _jobid % 50 = 1) AS n_theirs FROM s" for c in _RULE_CODES) + f") SELECT *, {q6('n_both / CAST(n_both + n_ours + n_theirs AS DOUBLE)')} AS agreement FROM a WHERE n_both + n_ours + n_theirs > 0")
def e29(spark, sf_dir):
    long = labelled(spark, sf_dir).select(F.col("_jobid").alias("jobid"), *_RULE_CODES).unpivot(["jobid"], _RULE_CODES, "code", "on")
    theirs = long.filter("(on = 1 and jobid % 3 <> 0) or (on = 0 and jobid % 50 = 1)")
    sampled = surrogate.jobs(spark, sf_dir).filter("jobid % 5 = 1 and jobid % 7 <> 2").select("jobid")
    compared = sampled.join(surrogate.records(spark, sf_dir, []).select("jobid"), "jobid", "left_semi")
    return rules.code_agreement(long.filter("on = 1"), theirs, compared).select("code", "n_both", "n_ours", "n_theirs", *rounded("agreement"))


# ---- paths and job output

_PATH = "concat('/x/Darshan_Logs/', 2020 + {k} % 5, '/', 1 + {k} % 12, '/', 1 + {k} % 28, CASE {k} % 4 WHEN 0 THEN '/u_lscpu_id' WHEN 1 THEN '/u_a_id' ELSE '/u_b_' END, CASE WHEN {k} % 4 < 2 THEN concat({k}, '-', {k} % 9, '_c.darshan') ELSE concat('t', {k}, '.darshan') END)"


@register("A8_path_columns", "SELECT o_orderkey, (2020 + o_orderkey % 5) || '-' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') AS log_date, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS job_id, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 9 END AS rank FROM orders")
def a8(spark, sf_dir):
    paths = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_PATH.format(k="o_orderkey")).alias("path"))
    return paths.select("o_orderkey", *[c.alias(n) for n, c in text_logs.path_parts(F.col("path")).items()])


@register("B13_logs_by_job", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE 'u_b_t' || o_orderkey || '.darshan' END AS job FROM orders WHERE o_orderkey % 4 <> 0")
def b13(spark, sf_dir):
    paths = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_PATH.format(k="o_orderkey")).alias("path"))
    return text_logs.by_job(paths, "path").select("o_orderkey", "job")


@register("A18_inventory", "WITH f AS (SELECT make_date(CAST(2020 + o_orderkey % 5 AS BIGINT), CAST(1 + o_orderkey % 12 AS BIGINT), CAST(1 + o_orderkey % 28 AS BIGINT)) AS d, o_custkey AS b FROM orders), g AS (SELECT d, count(*) AS n, sum(b) AS b FROM f GROUP BY d), s AS (SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM g) SELECT year(s.d) AS year, month(s.d) AS month, s.d AS log_date, coalesce(n, 0) AS n_files, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM s LEFT JOIN g ON s.d = g.d")
def a18(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(_PATH.format(k="o_orderkey")).alias("path"), F.col("o_custkey").alias("bytes"))
    return text_logs.inventory(files, "path", "bytes")


@register("A18_inventory_totals", "WITH f AS (SELECT make_date(CAST(2020 + o_orderkey % 5 AS BIGINT), CAST(1 + o_orderkey % 12 AS BIGINT), CAST(1 + o_orderkey % 28 AS BIGINT)) AS d, o_custkey AS b FROM orders), s AS (SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM f), a AS (SELECT d, b, 1 AS n FROM f UNION ALL SELECT d, 0, 0 FROM s) SELECT year(d) AS year, month(d) AS month, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(b) AS BIGINT) AS bytes, count(DISTINCT d) FILTER (n = 1) AS n_days, min(d) FILTER (n = 1) AS first_day, max(d) FILTER (n = 1) AS last_day FROM a GROUP BY ROLLUP (year(d), month(d))")
def a18_totals(spark, sf_dir):
    return text_logs.inventory_totals(a18(spark, sf_dir))


_OUTPUT_SQL = "SELECT {k} AS k, 'a=' || ({k} % 2) AS label, {u} % 2 AS exit_code, '2026-01-02 0' || ({k} % 10) || ':00:00' AS start_time, CASE WHEN {k} % 3 <> 0 THEN 'day ' || {k} END AS end_time"


def job_output(k, u):
    """The lines of a job's output, as an array: the last exit code that is a number, the last start and end hold."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.array(
        say("E2E small - other - 1999"), say("  E2E ", k, " - b - 2026-01-02 0", k % 10, ":00:00 "), say("Label: a=", k % 2), say("Label: b=1"), say("note: E2E - no start"), say("done, Exit code: 9"), say("srun: task 0: Exit code: ", u % 2), say("Exit code: none"),
        F.when(k % 3 != 0, say("run Completed: day 0 Completed: day ", k)).otherwise("completed: day 5"), say("exit code: 7"),
    )


@register("A17_A19_job_output", f"SELECT 'ior_small_' || k || '.out' AS file, 'ior_small' AS scenario, label, exit_code, start_time, end_time FROM ({_OUTPUT_SQL.format(k='o_orderkey', u='o_custkey')} FROM orders)")
def a17(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("ior_small_"), F.col("o_orderkey"), F.lit(".out")).alias("file"), F.posexplode(job_output(F.col("o_orderkey"), F.col("o_custkey"))).alias("line_no", "value"))
    return text_logs.job_labels(lines).join(text_logs.run_timing(lines), "file")


@register("A11_missing_chunks", "WITH e AS (SELECT unnest(generate_series(0, 6999)) AS chunk) SELECT chunk FROM e WHERE chunk NOT IN (SELECT o_orderkey % 7001 FROM orders WHERE o_orderkey % 7001 % 13 <> 4)")
def a11(spark, sf_dir):
    chunk = F.col("o_orderkey") % 7001
    return text_logs.missing_chunks(spark.read.parquet(f"{sf_dir}/orders.parquet").filter(chunk % 13 != 4).select(chunk.alias("chunk")), "chunk", 7000)


# ---- small transforms


@register("C10_validation", f"WITH {sql.ENGINEERED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (isnan({c}) OR {c} IS NULL) AS nan_count, count(*) FILTER (isinf({c})) AS inf_count, coalesce(max(abs({c})), 0) = 0 AS all_zero, count(*) >= 10 AS enough_rows FROM engineered" for c in ("nprocs", "runtime_seconds", "POSIX_READS", "POSIX_BYTES_READ", "read_ratio", "STDIO_F_VARIANCE_RANK_TIME", "opens_per_mb")))
def c10(spark, sf_dir):
    return features.validate(engineered(spark, sf_dir), 10).filter(F.col("feature").isin("nprocs", "runtime_seconds", "POSIX_READS", "POSIX_BYTES_READ", "read_ratio", "STDIO_F_VARIANCE_RANK_TIME", "opens_per_mb"))


@register("C11_C12_H3_aligned", f"WITH {sql.ENGINEERED} SELECT CAST(_jobid AS BIGINT) AS _jobid, CAST(0 AS DOUBLE) AS absent, {q6('sign(byte_imbalance) * ln(1 + abs(byte_imbalance))')} AS signed_imbalance, {q6('log10(greatest(POSIX_BYTES_READ, 0) + 1)')} AS log_bytes FROM engineered")
def c11(spark, sf_dir):
    aligned = features.ensure_columns(engineered(spark, sf_dir), ["_jobid", "absent", "byte_imbalance", "POSIX_BYTES_READ"])
    return aligned.select("_jobid", "absent", r6(features.signed_log(F.col("byte_imbalance"))).alias("signed_imbalance"), r6(prepare.log10_clipped(F.col("POSIX_BYTES_READ"))).alias("log_bytes"))


_SIG = ["nprocs", "POSIX_READS", "read_ratio", "seq_read_ratio", "collective_ratio"]


@register("D41_M5_signatures", f"WITH {sql.ENGINEERED}, s AS (SELECT _jobid, _benchmark, {', '.join(f'floor({c} * 10000 + 0.5) / 10000 AS {c}' for c in _SIG)} FROM engineered), f AS (SELECT _benchmark, {', '.join(f'arg_min({c}, _jobid) AS {c}' for c in _SIG)} FROM s GROUP BY _benchmark) SELECT s._jobid, {q6('coalesce((' + ' + '.join(f'CASE WHEN s.{c} <> 0 THEN least(s.{c}, f.{c}) / greatest(s.{c}, f.{c}, 1e-9) ELSE 0 END' for c in _SIG) + ') / nullif(' + ' + '.join(f'CAST(s.{c} <> 0 AS INT)' for c in _SIG) + ', 0), 0)')} AS similarity FROM s JOIN f ON s._benchmark = f._benchmark")
def d41(spark, sf_dir):
    rows = engineered(spark, sf_dir).select("_jobid", "_benchmark", *[(F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in _SIG]).select("_jobid", "_benchmark", features.signature(_SIG).alias("a"))
    first = rows.groupBy("_benchmark").agg(F.min_by("a", "_jobid").alias("b"))
    return rows.join(first, "_benchmark").select("_jobid", r6(knowledge.signed_similarity(F.col("a"), F.col("b"))).alias("similarity"))


_COLS = ["nprocs", "runtime_seconds", "POSIX_BYTES_READ", "POSIX_READS", "read_ratio"]


@register("G9_G11_skew_change", f"WITH {sql.ENGINEERED} " + " UNION ALL ".join(f'SELECT \'{c}\' AS feature, round(skewness({c}), 4) AS "before", round(skewness(ln(1 + greatest({c}, 0))), 4) AS "after", round(abs(skewness({c})) - abs(skewness(ln(1 + greatest({c}, 0)))), 3) AS improvement FROM engineered' for c in _COLS))
def g11(spark, sf_dir):
    e = engineered(spark, sf_dir).select("_jobid", *_COLS)
    chosen = stats.feature_columns(e)
    scaled = e.select(*[prepare.log1p_clipped(F.col(c)).alias(c) for c in chosen])
    out = stats.skew_change(stats.profile(e, chosen), stats.profile(scaled, chosen))
    return out.select("feature", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round("improvement", 3).alias("improvement"))


_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@register("G15_correlation_change", f"WITH {sql.ENGINEERED}, g AS (" + " UNION ALL ".join(f"SELECT abs(corr({a}, {b}) - corr(ln(1 + greatest({a}, 0)), ln(1 + greatest({b}, 0)))) AS gap FROM engineered" for a, b in _PAIRS) + f") SELECT {q6('avg(gap)')} AS mean_gap, {q6('max(gap)')} AS max_gap, {q6('median(gap)')} AS median_gap, count(*) FILTER (gap > 0.01) AS over_01, count(*) FILTER (gap > 0.05) AS over_05, count(*) FILTER (gap > 0.1) AS over_10 FROM g")
def g15(spark, sf_dir):
    e = engineered(spark, sf_dir).select(*_COLS)
    after = e.select(*[prepare.log1p_clipped(F.col(c)).alias(c) for c in _COLS])
    out = stats.correlation_change(stats.correlation(e, _COLS), stats.correlation(after, _COLS))
    return out.select(*rounded("mean_gap", "max_gap", "median_gap"), "over_01", "over_05", "over_10")


@register("J9_mapped_codes", "WITH c AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 5 AS b FROM orders) SELECT o_orderkey, CASE WHEN a = 1 AND b IN (1, 2) THEN 'file_strategy,metadata_intensity' WHEN a = 1 THEN 'metadata_intensity' WHEN b IN (1, 2) THEN 'file_strategy' ELSE 'healthy' END AS dims FROM c")
def j9(spark, sf_dir):
    codes = F.array(F.element_at(F.array(*map(F.lit, ("NOL", "HMD", "XXX", "NOL"))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("NOL", "FPP", "SHF", "YYY", "NOL"))), (F.col("o_custkey") % 5 + 1).cast("int")))
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", codes.alias("codes"))
    table = spark.createDataFrame([("HMD", "metadata_intensity"), ("FPP", "file_strategy"), ("SHF", "file_strategy")], "code string, dim string")
    return relate.mapped_codes(jobs, "o_orderkey", "codes", table).select("o_orderkey", F.array_join("dims", ",").alias("dims"))


@register("K11_seed_runs", f"SELECT o_orderpriority AS model, o_orderstatus AS metric, {q6('avg(o_totalprice)')} AS mean, {q6('stddev_pop(o_totalprice)')} AS std FROM orders GROUP BY 1, 2")
def k11(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").cast("double").alias("value"))
    return models.aggregate_seeds(o).select("model", "metric", *rounded("mean", "std"))


# ---- agreement and leaderboards

_P = f"p AS ({surrogate.predictions_sql()})"
_GT = [f"gt_{d}" for d in surrogate.PREDICTION_DIMS]
_PRED = [f"pred_{d}" for d in surrogate.PREDICTION_DIMS]


@register("L22_agreement_buckets", f"WITH {_P} SELECT {' + '.join(_GT)} > 0 AS rule_bottleneck, {' + '.join(_PRED)} > 0 AS model_bottleneck, count(*) AS n FROM p GROUP BY 1, 2")
def l22(spark, sf_dir):
    p = surrogate.predictions(spark, sf_dir)
    found = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c[5:])) for c in _PRED]))
    rows = p.select((sum(F.col(c) for c in _GT) == 0).alias("rule_healthy"), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("healthy"))).alias("detected"))
    return metrics.agreement_buckets(rows, "rule_healthy", "detected")


_WRONG = " + ".join(f"CAST(gt_{d} <> pred_{d} AS INT)" for d in surrogate.PREDICTION_DIMS)
_F1 = [f"coalesce(2.0 * sum(gt_{d} * pred_{d}) / nullif(sum(gt_{d} + pred_{d}), 0), 0)" for d in surrogate.PREDICTION_DIMS]


@register("L23_leaderboard", f"WITH {_P}, r AS (SELECT *, job_id % 3 AS run FROM p), l AS (SELECT * FROM r WHERE run = (SELECT max(run) FROM r x WHERE x.benchmark = r.benchmark)) SELECT benchmark, {q6(f'2.0 * sum({" + ".join(f"{a} * {b}" for a, b in zip(_GT, _PRED, strict=True))}) / nullif(sum({" + ".join(_GT + _PRED)}), 0)')} AS micro_f1, {q6('(' + ' + '.join(_F1) + f') / {len(_F1)}')} AS macro_f1, count(*) AS n, {q6(f'sum({_WRONG}) / CAST(count(*) * {len(_GT)} AS DOUBLE)')} AS hamming_loss, {q6(f'avg(CAST({_WRONG} = 0 AS INT))')} AS subset_accuracy FROM l GROUP BY benchmark")
def l23(spark, sf_dir):
    out = metrics.leaderboard(surrogate.predictions(spark, sf_dir).withColumn("run", F.col("job_id") % 3), surrogate.PREDICTION_DIMS, "benchmark", "run")
    return out.select("benchmark", *rounded("micro_f1", "macro_f1"), "n", *rounded("hamming_loss", "subset_accuracy"))


# ---- recommendations


@register("M7_canonical_fixes", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, 'fix of {d} in ' || min(_jobid) AS fix FROM labels_ WHERE {d} = 1 HAVING count(*) > 0" for d in DIMENSIONS))
def m7(spark, sf_dir):
    on = F.array_compact(F.array(*[F.when(F.col(d) == 1, F.lit(d)) for d in DIMENSIONS]))
    kb = labelled(spark, sf_dir).select(F.col("_jobid").alias("ordinal"), on.alias("dims"))
    kb = kb.withColumn("fixes", F.transform(F.reverse("dims"), lambda d: F.struct(d.alias("dimension"), F.concat(F.lit("fix of "), d, F.lit(" in "), F.col("ordinal")).alias("fix"))))
    return knowledge.canonical_fixes(kb).select("dimension", F.col("fix.fix").alias("fix"))


@register("M11_groundedness", f"SELECT o_orderpriority AS model, count(*) AS n_recommendations, count(*) FILTER (o_orderkey % 5 IN (1, 2, 3)) AS n_grounded, {q6('avg(CAST(o_orderkey % 5 IN (1, 2, 3) AS INT))')} AS grounded FROM orders GROUP BY 1")
def m11(spark, sf_dir):
    cited = F.element_at(F.array(F.lit(None).cast("string"), F.lit("kb_a"), F.lit("x, kb_b"), F.lit("see kb_a!"), F.lit("kb")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("model"), cited.alias("cited"), F.array(F.lit("kb_a"), F.lit("kb_b")).alias("retrieved"))
    return knowledge.groundedness(rows).select("model", "n_recommendations", "n_grounded", *rounded("grounded"))


_CLAIM = {c: f"o_orderkey % {k} = 0 AND o_custkey % 3 > 0" for c, k in zip(knowledge.CLAIMS, (2, 3, 5, 7, 11), strict=True)}


@register("M15_claim_statistics", "WITH c AS (SELECT o_orderpriority AS model, o_custkey % 3 > 0 AS cited, o_custkey % 3 = 1 AS valid, o_custkey % 3 > 0 AND o_orderkey % 2 = 0 AS dimension_match, o_custkey % 3 > 0 AND o_orderkey % 3 = 0 AS fix_type_match, o_custkey % 3 > 0 AND o_orderkey % 5 = 0 AS code_pattern_match, o_custkey % 3 > 0 AND o_orderkey % 7 = 0 AS api_change_match, o_custkey % 3 > 0 AND o_orderkey % 11 = 0 AS speedup_plausible FROM orders) SELECT model, count(*) AS n_recs_total, count(*) FILTER (cited) AS n_recs_cited, count(*) FILTER (NOT cited) AS n_recs_uncited, round(count(*) FILTER (valid) / CAST(count(*) AS DOUBLE), 4) AS citation_groundedness, " + ", ".join(f"round(count(*) FILTER ({c}) / CAST(greatest(count(*) FILTER (cited), 1) AS DOUBLE), 4) AS {c}_rate" for c in ("dimension_match", "fix_type_match", "code_pattern_match", "api_change_match", "speedup_plausible")) + ", round((count(*) FILTER (dimension_match) + count(*) FILTER (fix_type_match) + count(*) FILTER (code_pattern_match) + count(*) FILTER (api_change_match) + count(*) FILTER (speedup_plausible)) / (5.0 * greatest(count(*) FILTER (cited), 1)), 4) AS claim_groundedness FROM c GROUP BY model")
def m15(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return knowledge.claim_statistics(o.select(F.col("o_orderpriority").alias("model"), F.expr("o_custkey % 3 > 0").alias("has_citation"), F.expr("o_custkey % 3 = 1").alias("citation_valid"), *[F.expr(e).alias(c) for c, e in _CLAIM.items()]))


@register("M23_token_cost", "SELECT o_orderpriority AS model, round((sum(o_custkey) * CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.5 ELSE 1.0 END + sum(o_orderkey) * CASE o_orderpriority WHEN '1-URGENT' THEN 15.0 WHEN '2-HIGH' THEN 10.0 ELSE 3.0 END) / 1e6, 4) AS cost FROM orders GROUP BY 1")
def m23(spark, sf_dir):
    usage = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("tokens_in"), F.col("o_orderkey").alias("tokens_out"))
    return knowledge.token_cost(usage, spark.createDataFrame([("1-URGENT", 3.0, 15.0), ("2-HIGH", 2.5, 10.0)], "model string, rate_in double, rate_out double"))


# ---- runs

_RUN = "SELECT o_orderpriority AS workload, o_orderstatus AS model, CASE WHEN o_orderkey % 6 = 0 THEN 'baseline_failed' WHEN o_orderkey % 6 = 1 THEN 'plateau' ELSE 'converged' END AS status, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 17 / 4.0 END AS DOUBLE) AS best_speedup, o_custkey % 5 AS iterations, CAST(o_orderkey % 100 AS DOUBLE) / 64 AS cost, CASE o_orderkey % 7 WHEN 0 THEN 'sweep_a_b.json' WHEN 1 THEN 'ablation_no_ml_ior.json' WHEN 2 THEN 'ablation_full_ior_x.json' WHEN 3 THEN 'ablation_single_shot_ior.json' WHEN 4 THEN 'ablation_x.json' WHEN 5 THEN 'trackc_a.json' ELSE 'other' END AS file_name FROM {orders}"
_V = "coalesce(best_speedup, 1)"


def _runs(spark, sf_dir):
    return spark.sql(_RUN, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@register("N7_run_categories", f"WITH r AS ({_RUN.format(orders='orders')}) SELECT CASE WHEN starts_with(file_name, 'sweep_') THEN 'sweep' WHEN starts_with(file_name, 'ablation_') THEN 'ablation' WHEN starts_with(file_name, 'trackc_') THEN 'smoke' ELSE 'other' END AS category, count(*) AS n FROM r GROUP BY 1")
def n7(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy(runs.category(F.col("file_name")).alias("category")).agg(F.count("*").alias("n"))


@register("N8_workload_metrics", f"WITH r AS ({_RUN.format(orders='orders')}), v AS (SELECT * FROM r WHERE status <> 'baseline_failed') SELECT workload, model, count(*) AS n_valid, (SELECT count(*) FROM r x WHERE x.workload = v.workload AND x.model = v.model) AS n_total, {q6(f'avg({_V})')} AS mean, {q6(f'stddev_pop({_V})')} AS std, {q6(f'median({_V})')} AS median, min({_V}) AS min, max({_V}) AS max, {q6(f'exp(avg(ln(greatest({_V}, 0.01))))')} AS geo_mean, {q6('avg(iterations)')} AS mean_iterations, {q6('avg(cost)')} AS mean_cost, {q6('sum(cost)')} AS total_cost, (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM v y WHERE y.workload = v.workload AND y.model = v.model GROUP BY status)) AS statuses FROM v GROUP BY workload, model")
def n8(spark, sf_dir):
    return runs.workload_metrics(_runs(spark, sf_dir)).select("workload", "model", "n_valid", "n_total", *rounded("mean", "std", "median"), "min", "max", *rounded("geo_mean", "mean_iterations", "mean_cost", "total_cost"), F.array_join(F.transform("statuses", lambda s: F.concat_ws(":", s["status"], s["n"].cast("string"))), ",").alias("statuses"))


@register("N9_model_summary", f"WITH r AS ({_RUN.format(orders='orders')}), v AS (SELECT * FROM r WHERE status <> 'baseline_failed'), w AS (SELECT model, workload, avg(iterations) AS i, avg(cost) AS c FROM v GROUP BY 1, 2), m AS (SELECT model, count(*) AS n_workloads, avg(i) AS i, avg(c) AS c, sum(c) AS t FROM w GROUP BY 1), a AS (SELECT model, exp(avg(ln(greatest({_V}, 0.01)))) AS g, avg({_V}) AS mean, stddev_pop({_V}) AS std FROM v GROUP BY 1) SELECT m.model, n_workloads, {q6('g')} AS geo_mean, {q6('mean')} AS mean, {q6('std')} AS std, {q6('i')} AS mean_iterations, {q6('c')} AS mean_cost, {q6('t')} AS total_cost FROM m JOIN a ON m.model = a.model")
def n9(spark, sf_dir):
    return runs.model_summary(_runs(spark, sf_dir)).select("model", "n_workloads", *rounded("geo_mean", "mean", "std", "mean_iterations", "mean_cost", "total_cost"))


@register("N9_ablation_metrics", f"WITH r AS ({_RUN.format(orders='orders')}), v AS (SELECT CASE file_name WHEN 'ablation_no_ml_ior.json' THEN 'no_ml' WHEN 'ablation_full_ior_x.json' THEN 'full' WHEN 'ablation_single_shot_ior.json' THEN 'single_shot' ELSE 'unknown' END AS condition, {_V} AS v FROM r WHERE status <> 'baseline_failed' AND starts_with(file_name, 'ablation_')) SELECT condition, count(*) AS n_runs, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS std, {q6('exp(avg(ln(greatest(v, 0.01))))')} AS geo_mean FROM v GROUP BY 1")
def n9b(spark, sf_dir):
    some = _runs(spark, sf_dir).filter(F.col("file_name").startswith("ablation_"))
    return runs.ablation_metrics(some).select("condition", "n_runs", *rounded("mean", "std", "geo_mean"))


@register("C1_D40_log_features", f"WITH {sql.RAW} SELECT _jobid, {q6('log10(greatest(POSIX_BYTES_READ, 0) + 1)')} AS POSIX_BYTES_READ, {q6('log10(nprocs + 1)')} AS nprocs, {q6('log10(greatest(POSIX_SIZE_READ_0_100, 0) + 1)')} AS POSIX_SIZE_READ_0_100 FROM raw")
def d40(spark, sf_dir):
    return raw(spark, sf_dir).select("_jobid", *[r6(prepare.log10_clipped(F.col(c))).alias(c) for c in ("POSIX_BYTES_READ", "nprocs", "POSIX_SIZE_READ_0_100")])
