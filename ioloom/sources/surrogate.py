"""Domain tables derived from the general-purpose test tables.

The mapping is SQL text that Spark and other engines read alike: integers from lineitem's columns,
and eighths for times, so that sums are exact. Only this derivation is shared with the reference
SQL of the tests; the operators are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ioloom.functions.counters import FLOATS, MODULE_OF, MODULES, rule_of

MODULE_SQL = "CASE l_returnflag WHEN 'A' THEN 'POSIX' WHEN 'N' THEN 'MPI-IO' ELSE 'STDIO' END"
#: Integers q 1..50, p price, d 0..10, t 0..8, s line number and key mixes of a record.
_BASE = "CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS d, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS t"
_SPECIAL = {
    "POSIX_READS": "q * 60", "POSIX_WRITES": "(51 - q) * 45", "POSIX_BYTES_READ": "p * q", "POSIX_BYTES_WRITTEN": "p * (51 - q) % 900000",
    "POSIX_MAX_BYTE_READ": "p * (d + 20)", "POSIX_MAX_BYTE_WRITTEN": "p * (t + 10)", "POSIX_SEQ_READS": "q * d * 6", "POSIX_SEQ_WRITES": "(51 - q) * t * 5",
    "POSIX_CONSEC_READS": "q * d * 3", "POSIX_CONSEC_WRITES": "(51 - q) * t * 2", "POSIX_MMAPS": "CASE WHEN q % 5 = 0 THEN -1 ELSE q % 3 END",
    "POSIX_FASTEST_RANK": "p % 8 - 1", "POSIX_SLOWEST_RANK": "p % 7", "POSIX_FASTEST_RANK_BYTES": "p % 1000", "POSIX_SLOWEST_RANK_BYTES": "p * d",
    "POSIX_FILE_NOT_ALIGNED": "CASE WHEN t = 8 THEN -1 ELSE q * d END", "MPIIO_INDEP_READS": "q * 40", "MPIIO_INDEP_WRITES": "(51 - q) * 40", "MPIIO_COLL_READS": "CASE WHEN d < 6 THEN 0 ELSE q END",
    "MPIIO_COLL_WRITES": "CASE WHEN t < 5 THEN 0 ELSE q END", "MPIIO_NB_READS": "CASE WHEN d < 8 THEN 0 ELSE q END", "MPIIO_NB_WRITES": "CASE WHEN t < 7 THEN 0 ELSE q END",
    "STDIO_BYTES_READ": "p % 50000", "STDIO_BYTES_WRITTEN": "p % 30000",
    "POSIX_F_META_TIME": "CASE WHEN d = 9 THEN -1.0 ELSE (p % 400) / 8.0 END", "POSIX_F_OPEN_START_TIMESTAMP": "(p % 16) / 8.0", "POSIX_F_CLOSE_END_TIMESTAMP": "(p % 3000) / 8.0",
}


def counter_sql(counter: str) -> str:
    """The value of a counter in a record of its module, NULL in others."""
    k = sum(counter.encode()) % 89
    if counter in _SPECIAL:
        value = _SPECIAL[counter]
    elif rule_of(counter) == "top4" and counter.endswith("COUNT"):
        value = f"(q + {k}) % 4"
    elif rule_of(counter) == "top4":
        value = f"((p + {k}) % 5) * 512"
    elif counter in FLOATS:
        value = f"((p + q * {k}) % {200 + 3 * k}) / 8.0"
    else:
        value = f"(q * {k % 7 + 1} + d * {k} + t) % {97 + k}"
    return f"CASE WHEN module = '{MODULE_OF[counter]}' THEN {value} END"


def records_sql(counters: list[str] | None = None, lineitem: str = "lineitem", spark: bool = False, carry: str = "") -> str:
    """spark: eighths are divided as doubles, which is exact too; Spark reads 8.0 as a decimal, whose division is slow. carry: a further column."""
    chosen = counters if counters is not None else [c for cs in MODULES.values() for c in cs]
    value = (lambda c: counter_sql(c).replace("/ 8.0", "/ 8D")) if spark else counter_sql
    columns = "".join(f", CAST({value(c)} AS {'DOUBLE' if c in FLOATS else 'BIGINT'}) AS {c}" for c in chosen)
    order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
    return (
        f"SELECT l_orderkey AS jobid, module, l_partkey % 3 AS file_id, l_suppkey % 8 AS rank, record_seq{carry and ', ' + carry}{columns} FROM ("
        f"SELECT *, {MODULE_SQL} AS module, {_BASE}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS record_seq FROM {lineitem}) base"
    )


JOBS_SQL = """SELECT o_orderkey AS jobid, o_custkey AS uid, CAST(o_custkey % 64 AS BIGINT) AS nprocs, {epoch} AS start_time,
CAST(CAST(floor(o_totalprice) AS BIGINT) % 5000 AS DOUBLE) / 8 - 2 AS runtime, o_orderpriority AS benchmark, o_orderstatus AS scenario FROM {orders}"""


def jobs_sql(orders: str = "orders", spark: bool = False) -> str:
    return JOBS_SQL.format(orders=orders, epoch="unix_timestamp(CAST(o_orderdate AS TIMESTAMP))" if spark else "CAST(epoch(o_orderdate) AS BIGINT)")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, counters: list[str] | None = None) -> DataFrame:
    """One row per record: jobid, module, file_id, rank, record_seq and the counters.

    Rows are dealt by job while they are narrow, as the records of a log lie together: what groups them by job then
    shuffles no wide partial sums.
    """
    dealt = _table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    return spark.sql(records_sql(counters, "{lineitem}", spark=True), lineitem=dealt)


def records_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of jobs that have a header, with heads in a job's first record: its headers (one, where keys are unique). Headers are joined while
    records are narrow; the records of a job lie in one partition and in order of the job."""
    head = jobs(spark, sf_dir)
    heads = head.groupBy("jobid").agg(F.collect_list(F.struct(*[c for c in head.columns if c != "jobid"])).alias("heads"))
    lineitem = _table(spark, sf_dir, "lineitem")
    dealt = lineitem.join(heads, lineitem["l_orderkey"] == heads["jobid"]).drop("jobid")
    return spark.sql(records_sql(None, "{lineitem}", spark=True, carry="CASE WHEN record_seq = 1 THEN heads END AS heads"), lineitem=dealt)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job header: jobid, uid, nprocs, start_time, runtime, benchmark, scenario."""
    return spark.sql(jobs_sql("{orders}", spark=True), orders=_table(spark, sf_dir, "orders"))


#: Seven dimensions of ground truth and prediction, a probability for each, a benchmark and two systems.
PREDICTION_DIMS = ["access_granularity", "metadata_intensity", "parallelism_efficiency", "access_pattern", "interface_choice", "file_strategy", "throughput_utilization"]


def predictions_sql(orders: str = "orders") -> str:
    columns = []
    for i, d in enumerate(PREDICTION_DIMS):
        gt = f"(o_orderkey * {3 + i} + o_custkey) % {5 + i} < 2"
        columns += [f"CAST({gt} AS INT) AS gt_{d}", f"CAST(({gt} AND o_custkey % {4 + i} <> 0) OR o_orderkey % {11 + i} = 0 AS INT) AS pred_{d}", f"((o_orderkey * 37 + o_custkey * {7 + i} + CAST({gt} AS INT) * 300) % 1000) / 1000.0 AS prob_{d}"]
    return f"SELECT o_orderkey AS job_id, o_orderpriority AS benchmark, o_orderstatus AS scenario, {', '.join(columns)} FROM {orders}"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, benchmark, scenario and gt_, pred_, prob_ of each of the seven dimensions."""
    return spark.sql(predictions_sql("{orders}"), orders=_table(spark, sf_dir, "orders"))


RUNS_SQL = """SELECT o_orderpriority AS workload, o_orderstatus AS model, o_custkey AS run_id, CAST(row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus, o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS iteration,
CAST(o_orderkey % 13 AS DOUBLE) / 4 AS speedup, o_custkey % 5 <> 0 AS executed, CAST(floor(o_totalprice) AS BIGINT) % 7 = 0 AS rollback, CAST(o_orderkey % 3 AS BIGINT) AS open_dims, CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 8 AS bandwidth, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS tokens FROM {orders}"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations of optimization runs: workload, model, run_id, iteration, speedup, executed, rollback, open_dims, bandwidth, tokens."""
    return spark.sql(RUNS_SQL, orders=_table(spark, sf_dir, "orders"))
