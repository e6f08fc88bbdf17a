"""Queries that write log files from the tables and read them back (survey 2.A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.plans.core import register
from ioloom.plans.label_queries import _OUTPUT_SQL, job_output
from ioloom.sources import log_files, text_logs
from ioloom.sources.scratch import scratch_path

#: A log per supplier: its key, its number of line items and their quantities; every 11th holds a usage error, every 13th nothing.
_LOGS_SQL = """SELECT s_suppkey AS k, count(l_orderkey) AS n, CAST(coalesce(sum(floor(l_quantity)), 0) AS BIGINT) AS q FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey"""


#: Tasks that write logs, for each core.
TASKS = 4


def _logs(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(_LOGS_SQL, supplier=read("supplier"), lineitem=read("lineitem"))


def _written(spark, logs, lines) -> str:
    """The folder in which each log (k) lies as a file of its own, its lines (an array) in order.

    A log is one row until it is written, so no lines are shuffled or sorted. Tasks move their own files into the folder
    (version 2 of the commit), or the driver would move them one by one; it is read only when all are there.
    """
    path = scratch_path(spark, "logs")
    rows = logs.repartition(TASKS * spark.sparkContext.defaultParallelism, "k").select(F.concat(F.lit("log_"), F.col("k")).alias("name"), F.array_join(lines, "\n", "").alias("value"))
    rows.write.partitionBy("name").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def _named(df, file: str = "file"):
    return df.withColumn("k", F.regexp_extract(file, r"/name=log_(\d+)/", 1).cast("bigint"))


@register("A1_A5_A7_A9_log_files", f"""WITH l AS ({_LOGS_SQL.format(supplier="supplier", lineitem="lineitem")})
SELECT k, CASE WHEN k % 11 = 3 THEN 'no log lines: Usage: parse <file> [options]' WHEN k % 13 = 5 THEN 'empty file' END AS error, CASE WHEN ok THEN k END AS jobid, CASE WHEN ok THEN n END AS nprocs, CASE WHEN ok THEN q / 8.0 END AS run_time, CASE WHEN ok THEN CAST(q AS DOUBLE) END AS reads, CASE WHEN ok THEN CAST(n * 1000 AS DOUBLE) END AS read_time,
  CASE WHEN ok THEN CASE WHEN k % 2 = 0 THEN 'POSIX,STDIO' ELSE 'POSIX' END END AS modules, CASE WHEN ok THEN k % 3 = 0 END AS uses_lustre FROM (SELECT *, k % 11 <> 3 AND k % 13 <> 5 AS ok FROM l)""")
def a7(spark, sf_dir):
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, n, q = F.col("k"), F.col("n"), F.col("q")
    text = F.array(say("# darshan log version: 3.41"), say("# jobid: ", k), say("# nprocs: ", n), say("# run time: ", q / 8), say("# mount entry:\t/m\t", F.when(k % 3 == 0, "lustre").otherwise("nfs")), say("POSIX module: ver=4"), F.when(k % 2 == 0, "STDIO module data").otherwise("# end"), say("total_POSIX_READS: 1"), say("total_POSIX_READS: ", q), say("total_POSIX_F_READ_TIME: ", n, "e+3"))
    lines = F.when(k % 11 == 3, F.array(F.lit("Usage: parse <file> [options]"))).when(k % 13 == 5, F.array(F.lit(""), F.lit("  "))).otherwise(text)
    good, bad = log_files.scan(spark, [_written(spark, _logs(spark, sf_dir), lines)], scratch_path(spark, "scan"), "*.txt", must_match=r"^(#|total_)")
    out = text_logs.headers(good).select("file", "jobid", "nprocs", "run_time").join(text_logs.pivot_totals(text_logs.totals(good), ["POSIX_READS", "POSIX_F_READ_TIME"]), "file").join(text_logs.modules(good), "file").join(text_logs.mounts(good), "file")
    out = _named(out).select("k", "jobid", "nprocs", "run_time", F.col("POSIX_READS").alias("reads"), F.col("POSIX_F_READ_TIME").alias("read_time"), F.array_join("modules", ",").alias("modules"), "uses_lustre")
    return out.join(_named(bad, "file_path").select("k", "error"), "k", "full_outer")


@register("A7_capped_files", f"WITH l AS ({_LOGS_SQL.format(supplier='supplier', lineitem='lineitem')}) SELECT k, n AS n_lines FROM l WHERE n > 0 ORDER BY 'log_' || k || '/' LIMIT 7")
def a7_cap(spark, sf_dir):
    lines = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("total_X: "), i.cast("string")))
    good, _ = log_files.scan(spark, [_written(spark, _logs(spark, sf_dir).filter("n > 0"), lines)], scratch_path(spark, "scan"), cap=7)
    return _named(good).groupBy("k").agg(F.count("*").alias("n_lines"))


@register("A17_A19_output_files", f"SELECT k, label, exit_code, start_time, end_time FROM ({_OUTPUT_SQL.format(k='s_suppkey', u='s_nationkey')} FROM supplier)")
def a17_files(spark, sf_dir):
    jobs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("u"))
    good, _ = log_files.scan(spark, [_written(spark, jobs, job_output(F.col("k"), F.col("u")))], scratch_path(spark, "scan"), "*.txt")
    return _named(text_logs.job_labels(good).select("file", "label").join(text_logs.run_timing(good), "file")).select("k", "label", "exit_code", "start_time", "end_time")
