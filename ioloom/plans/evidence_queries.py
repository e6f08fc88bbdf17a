"""Queries of text scans, ground truth, retrieval, runs, models and streams (survey 2.A, 2.F, 2.K, 2.M, 2.N, 2.P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.functions.counters import DIMENSIONS
from ioloom.operators import groundtruth, knowledge, models, runs
from ioloom.plans import sql
from ioloom.plans.core import r6, register, rounded
from ioloom.plans.sql import r6 as q6
from ioloom.plans.stages import engineered, labelled
from ioloom.sources import surrogate, text_logs
from ioloom.sources.scratch import scratch_path
from ioloom.streaming import ingest

# ---- text scans: the lines of a log are made from the job tables, then read back


def _lines(spark, sf_dir):
    jobs = surrogate.jobs(spark, sf_dir)
    text = F.array(
        F.concat(F.lit("# jobid: "), F.col("jobid")), F.concat(F.lit("# uid: "), F.col("uid")), F.concat(F.lit("# start_time: "), F.col("start_time")), F.concat(F.lit("# start_time_asci: Mon 10:"), F.col("uid")), F.lit("# darshan log version: 3.41"), F.concat(F.lit("# agg_perf_by_slowest: "), F.col("uid"), F.lit(".25 # MiB/s")), F.concat(F.lit("# nprocs: "), F.col("nprocs")), F.concat(F.lit("# nprocs: 999"), F.col("uid")),
        F.concat(F.lit("# run time: "), F.col("runtime")), F.lit("# LUSTRE module: ver=1"), F.lit("POSIX module: x ver=4"), F.lit("POSIX module data"), F.lit("NCMPI module: ver=2"), F.when(F.col("jobid") % 2 == 0, "MPI-IO module data").otherwise("MPI-IO modules"), F.when(F.col("uid") % 3 == 0, "# mount entry:\t/scratch\tlustre").otherwise("# mount entry:\t/home\tnfs"),
        F.concat(F.lit("total_POSIX_READS: "), F.col("uid")), F.concat(F.lit("total_POSIX_F_READ_TIME: 1.5e"), F.col("nprocs") % 3), F.concat(F.lit("total_POSIX_READS: "), F.col("nprocs")), F.concat(F.lit("Max Write: "), F.col("uid"), F.lit(".5 MiB/s")), F.concat(F.lit("done, exit code: "), F.col("uid") % 2),
    )
    # Dealt by log before it becomes lines, as its lines lie together: what groups by file then holds a part of the logs in each task.
    dealt = jobs.withColumn("file", F.concat(F.lit("log"), F.col("jobid"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")  # a number, or few large tasks would be made of them
    return dealt.select("file", F.posexplode(text).alias("line_no", "value"))


@register("A1_headers", f"WITH {sql.JOBS} SELECT 'log' || jobid AS file, jobid, uid, start_time, CAST(0 AS BIGINT) AS end_time, CAST('999' || uid AS BIGINT) AS nprocs, {q6('runtime')} AS run_time, '3.41' AS log_version, 'Mon 10:' || uid AS start_time_str FROM jobs")
def a1(spark, sf_dir):
    return text_logs.headers(_lines(spark, sf_dir)).select("file", "jobid", "uid", "start_time", "end_time", "nprocs", *rounded("run_time"), "log_version", "start_time_str")


@register("A2_A5_totals_pivot", f"WITH {sql.JOBS} SELECT 'log' || jobid AS file, CAST(nprocs AS DOUBLE) AS POSIX_READS, 1.5 * pow(10, nprocs % 3) AS POSIX_F_READ_TIME, uid + 0.25 AS agg_perf_mib_s FROM jobs")
def a2(spark, sf_dir):
    return text_logs.pivot_totals(text_logs.totals(_lines(spark, sf_dir)), ["POSIX_READS", "POSIX_F_READ_TIME", "agg_perf_mib_s"])


@register("A3_A4_modules_mounts", f"WITH {sql.JOBS} SELECT 'log' || jobid AS file, CASE WHEN jobid % 2 = 0 THEN 'POSIX,LUSTRE,MPI-IO' ELSE 'POSIX,LUSTRE' END AS modules, uid % 3 = 0 AS uses_lustre, CASE WHEN uid % 3 = 0 THEN '/scratch' END AS lustre_mount FROM jobs")
def a3(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return text_logs.modules(lines).join(text_logs.mounts(lines), "file").select("file", F.array_join("modules", ",").alias("modules"), "uses_lustre", "lustre_mount")


@register("A16_tool_results", f"WITH {sql.JOBS} SELECT 'log' || jobid AS file, uid + 0.5 AS ior_write_bw_mibs, CASE WHEN uid % 3 = 0 THEN CAST(uid AS DOUBLE) END AS ior_read_bw_mibs, 1.25 + uid AS hacc_write_time_s, uid * 8 AS hacc_total_bytes, CAST(nprocs AS DOUBLE) AS custom_runtime_s, CAST(uid AS DOUBLE) AS h5bench_write_rate, nprocs + 0.5 AS h5bench_read_rate, uid % 2 AS h5bench_write_rc, uid + 0.125 AS dlio_throughput_samples_s, CASE WHEN uid % 5 > 0 THEN uid + 0.75 END AS dlio_epoch_time_s FROM jobs")
def a16(spark, sf_dir):
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    u, n = F.col("uid"), F.col("nprocs")
    text = F.array(
        say("Max Write: 7 MiB/s"), say("  Max Write: ", u, ".5 MiB/s (x)"), F.when(u % 3 == 0, say("Max Read:  ", u, " MiB/s")).otherwise("Max Read: none"), say("Checkpoint WRITE: 1 seconds"), say("Checkpoint write took ", u + 1, ".25 seconds"), say("Total ", u * 8, " bytes moved"), say("Elapsed ", n, " s"),
        say("Write rate: 3 MB/s"), say("write completed, rate ", u, " MiB/s, exit code: ", u % 2), say("Read rate: ", n, ".5 MB/s"), say("Throughput: 2 it/s"), say("Throughput: ", u, ".125 samples/s"), F.when(u % 5 > 0, say("Epoch 3 time ", u, ".75 sec")).otherwise("epoch times unknown"),
    )
    lines = surrogate.jobs(spark, sf_dir).select(F.concat(F.lit("log"), F.col("jobid")).alias("file"), F.posexplode(text).alias("line_no", "value"))
    return text_logs.tool_results(lines)


# ---- ground truth

_NAME = "concat(CASE jobid % 9 WHEN 0 THEN 'IOR_small_posix_t' WHEN 1 THEN 'ior_random_small_r' WHEN 2 THEN 'mdtest_meta_shared_n' WHEN 3 THEN 'ior_interface_posix_shared_' WHEN 4 THEN 'custom_balanced_' WHEN 5 THEN 'h5b_indep_small_n' WHEN 6 THEN 'unknown_' WHEN 7 THEN 'hacc_fpp_small_many_' ELSE 'custom_imbalance_' END, jobid, '.darshan')"
_DIMS_SQL = {"access_granularity": "0, 1, 7", "access_pattern": "1", "metadata_intensity": "2", "interface_choice": "3, 5", "file_strategy": "7", "parallelism_efficiency": "8", "healthy": "4", "throughput_utilization": "-1"}
_INTENDED = ", ".join(f"CAST(_jobid % 9 IN ({_DIMS_SQL[d]}) AS INT) AS {d}" for d in DIMENSIONS)


@register("F1_F7_pattern_labels", f"WITH {sql.JOBS} SELECT jobid, CASE jobid % 9 WHEN 2 THEN 'mdtest' WHEN 4 THEN 'custom' WHEN 5 THEN 'h5bench' WHEN 6 THEN 'unknown' WHEN 7 THEN 'unknown' WHEN 8 THEN 'custom' ELSE 'ior' END AS benchmark, {_INTENDED.replace('_jobid', 'jobid')}, jobid % 9 <> 6 AS pattern_known FROM jobs")
def f1(spark, sf_dir):
    named = surrogate.jobs(spark, sf_dir).select("jobid", F.expr(_NAME).alias("name"))
    return groundtruth.with_labels(named, "name").select("jobid", groundtruth.benchmark_of(F.col("name")).alias("benchmark"), *DIMENSIONS, "pattern_known")


_CH = [(d, f"{f} BETWEEN {lo} AND {hi}") for d, (f, lo, hi) in groundtruth.CHECKS.items()] + [("interface_choice", "(has_mpiio = 0 OR MPIIO_COLL_WRITES = 0)"), ("file_strategy", "(num_files / greatest(nprocs, 1) >= 1 AND num_files >= 50)")]


@register("F3_verification", f"WITH {sql.ENGINEERED}, t AS (SELECT *, {_INTENDED} FROM engineered), c AS (SELECT _jobid, {' + '.join(d for d, _ in _CH)} AS n_checks, {' + '.join(f'CAST({d} = 1 AND {c} AS INT)' for d, c in _CH)} AS n_passed, runtime_seconds >= 5 AND POSIX_BYTES_READ + POSIX_BYTES_WRITTEN >= 10240 AND POSIX_READS + POSIX_WRITES >= 100 AS included FROM t) SELECT *, included AND (n_checks = 0 OR n_passed >= 0.8 * n_checks) AS verified FROM c")
def f3(spark, sf_dir):
    df = engineered(spark, sf_dir).withColumn("name", F.expr(_NAME.replace("jobid", "_jobid")))
    return groundtruth.verified(groundtruth.with_labels(df, "name")).select("_jobid", "n_checks", "n_passed", "included", "verified")


# ---- retrieval


@register("M3_entries_per_dimension", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dim, _benchmark AS benchmark, count(*) AS n FROM labels_ WHERE {d} = 1 GROUP BY _benchmark" for d in DIMENSIONS))
def m3(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("_benchmark", F.explode(F.array_compact(F.array(*[F.when(F.col(d) == 1, F.lit(d)) for d in DIMENSIONS]))).alias("dim"))
    return rows.groupBy("dim", F.col("_benchmark").alias("benchmark")).agg(F.count("*").alias("n"))


@register("M8_cache_keys", "SELECT conv_id, turn, md5(role || coalesce(text, '') || 'model') AS key FROM conversations")
def m8(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", knowledge.cache_key(F.col("role"), F.col("text"), F.lit("model")).alias("key"))


@register("M10_json_in_text", "SELECT event_id, value, CAST(event_id % 3 AS INT) AS form FROM events")
def m10(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_json(F.struct("value")).alias("j"), (F.col("event_id") % 3).cast("int").alias("form"))
    text = F.when(F.col("form") == 0, F.col("j")).when(F.col("form") == 1, F.concat(F.lit("So:\n```json\n"), F.col("j"), F.lit("\n```\nend"))).otherwise(F.concat(F.lit("It is "), F.col("j"), F.lit(" as said")))
    return e.select("event_id", knowledge.json_in_text(text, "value double")["value"].alias("value"), "form")


# ---- runs

_R = f"r AS ({surrogate.RUNS_SQL.format(orders='orders')})"
_W = "PARTITION BY workload, model, run_id ORDER BY iteration"
_PROGRESS = f"""{_R}, b AS (SELECT *, greatest(coalesce(max(speedup) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 1) AS best_, lag(speedup) OVER ({_W}) AS last_, first_value(bandwidth) OVER ({_W}) AS base_ FROM r),
p AS (SELECT workload, model, run_id, iteration, speedup, open_dims, greatest(best_, speedup) AS best, speedup > best_ AS is_new_best, bandwidth < 0.9 * base_ AND NOT speedup > best_ AS regressed, coalesce(iteration > 0 AND executed AND NOT rollback AND abs(speedup - coalesce(last_, 1)) / greatest(coalesce(last_, 1), 0.001) < 0.05, false) AS plateau FROM b)"""


@register("N4_N6_run_progress", f"WITH {_PROGRESS} SELECT workload, model, run_id, iteration, best, is_new_best, regressed, plateau FROM p")
def n4(spark, sf_dir):
    return runs.progress(surrogate.runs(spark, sf_dir)).select("workload", "model", "run_id", "iteration", "best", "is_new_best", "regressed", "plateau")


_OUT = f"""{_PROGRESS}, o AS (SELECT workload, model, run_id, max(best) AS best_speedup, coalesce(arg_min(CASE WHEN open_dims = 0 THEN 'converged' ELSE 'plateau' END, iteration) FILTER (open_dims = 0 OR plateau), 'max_iterations') AS status, count(*) AS iterations FROM p GROUP BY workload, model, run_id)"""


@register("N6_run_outcomes", f"WITH {_OUT} SELECT * FROM o")
def n6(spark, sf_dir):
    return runs.outcomes(surrogate.runs(spark, sf_dir)).select(*runs.RUN, "best_speedup", "status", "iterations")


_SUM = f"count(*) AS n, {q6('avg(best_speedup)')} AS mean, {q6('stddev_pop(best_speedup)')} AS std, {q6('median(best_speedup)')} AS median, min(best_speedup) AS min, max(best_speedup) AS max, {q6('exp(avg(ln(greatest(best_speedup, 0.01))))')} AS geo_mean, {q6('count(*) / sum(1 / greatest(best_speedup, 0.01))')} AS harmonic_mean, count(*) FILTER (best_speedup > 1) AS improved"


@register("N8_N12_run_summary", f"WITH {_OUT} SELECT workload, model, {_SUM} FROM o GROUP BY workload, model")
def n8(spark, sf_dir):
    return runs.summarize(runs.outcomes(surrogate.runs(spark, sf_dir)), "workload", "model").select("workload", "model", "n", *rounded("mean", "std", "median"), "min", "max", *rounded("geo_mean", "harmonic_mean"), "improved")


@register("N1_pair_speedups", """WITH x AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) % 1000 END) AS bad, max(CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice) % 1000 END) AS good FROM orders GROUP BY o_custkey),
y AS (SELECT *, (CASE WHEN good = 0 THEN 0.001 ELSE CAST(good AS DOUBLE) END) / (CASE WHEN bad = 0 THEN 0.001 ELSE CAST(bad AS DOUBLE) END) AS s FROM x)
SELECT o_custkey, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good, round(s, 2) AS speedup, CASE WHEN s IS NULL THEN 'incomplete' ELSE 'validated' END AS status FROM y""")
def n1(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "bad").when(F.col("o_orderstatus") == "O", "good").alias("kind"), (F.floor("o_totalprice") % 1000).alias("bw"))
    return runs.pair_speedups(o, "o_custkey", "kind", "bw")


@register("N3_flatten_runs", f"WITH {_R} SELECT workload, model, run_id, iteration, speedup FROM r")
def n3(spark, sf_dir):
    whole = surrogate.runs(spark, sf_dir).groupBy(*runs.RUN).agg(F.array_sort(F.collect_list(F.struct("iteration", "speedup"))).alias("iterations"))
    return runs.flatten(whole).select(*runs.RUN, "iteration", "speedup")


@register("N14_size_strings", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size WHEN 3 THEN CAST(floor((p_size + 0.3) * 1073741824.0) AS BIGINT) END AS bytes FROM part")
def n14(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("k"), F.lit("M "), F.lit(""), F.lit(".3G"), F.lit("kb")), (F.col("p_partkey") % 5 + 1).cast("int")))
    return part.select("p_partkey", runs.size_bytes(text).alias("bytes"))


# ---- models

@register("K1_class_weights", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {q6(f'CASE WHEN sum({d}) = 0 THEN 1 ELSE least((count(*) - sum({d})) / CAST(sum({d}) AS DOUBLE), 100) END')} AS weight FROM labels_" for d in DIMENSIONS))
def k1(spark, sf_dir):
    return models.class_weights(labelled(spark, sf_dir), DIMENSIONS).select("dimension", *rounded("weight"))


@register("K17_majority", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST(avg({d}) > 0.5 AS INT) AS predicted FROM labels_" for d in DIMENSIONS))
def k17(spark, sf_dir):
    return models.majority_baseline(labelled(spark, sf_dir), DIMENSIONS)


_HIGH = {"access_granularity": "small_io_ratio small_read_ratio small_write_ratio", "metadata_intensity": "metadata_time_ratio opens_per_op stats_per_op", "throughput_utilization": "fsync_ratio total_bw_mb_s"}
_LOWER = {"access_pattern": "seq_read_ratio seq_write_ratio", "interface_choice": "collective_ratio"}
_CUTS = ", ".join(f"quantile_cont({f}, {q}) AS q_{f}" for hints, q in ((_HIGH, 0.9), (_LOWER, 0.1)) for fs in hints.values() for f in fs.split())
_PREDS = ", ".join(f"CAST({' OR '.join(f'{f} {op} q_{f}' for f in fs.split())} AS INT) AS pred_{d}" for hints, op in ((_HIGH, ">"), (_LOWER, "<")) for d, fs in hints.items())


@register("K18_percentile_baseline", f"WITH {sql.ENGINEERED}, q AS (SELECT {_CUTS} FROM engineered WHERE _jobid % 4 <> 0) SELECT _jobid, {_PREDS} FROM engineered, q WHERE _jobid % 4 = 0")
def k18(spark, sf_dir):
    e = engineered(spark, sf_dir)
    return models.percentile_baseline(e.filter("_jobid % 4 <> 0"), e.filter("_jobid % 4 = 0"), "_jobid")


# ---- streams


def _paths(spark):
    path = scratch_path(spark, "stream")
    return f"{path}/rows", f"{path}/state"


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return ingest.stream(spark, sf_dir, "events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))


@register("P1_P2_incremental_ingest", "SELECT event_id, user_id, event_type FROM events")
def p1(spark, sf_dir):
    path, state = _paths(spark)
    rows = ingest.deduplicated(_events(spark, sf_dir), ["event_id"], "at").select("event_id", "user_id", "event_type")
    ingest.append_new(rows, path, state)
    ingest.append_new(rows, path, state)  # nothing new: no row is written twice
    return spark.read.parquet(path)


@register("P3_window_rates", f"SELECT event_type, count(*) AS n, {q6('avg(value)')} AS rate, date_trunc('day', ts) AS start FROM events GROUP BY event_type, date_trunc('day', ts)")
def p3(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return ingest.window_rates(e, "at", "1 day", "event_type", "value").select("event_type", "n", r6(F.col("rate")).alias("rate"), F.col("start").cast("timestamp_ntz").alias("start"))


@register("P4_sessions", """WITH l AS (SELECT user_id, ts, CAST(coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200, true) AS INT) AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def p4(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "at", "user_id", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
