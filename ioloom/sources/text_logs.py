"""Scans of parsed-log text: header lines, counter totals, modules and mounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.functions.counters import ALL_COUNTERS

# Header keys as the logs write them, with the column, type and value without such a line.
KEYS = {
    "jobid": ("jobid", "bigint", "0"), "uid": ("uid", "bigint", "0"), "nprocs": ("nprocs", "bigint", "1"), "start_time": ("start_time", "bigint", "0"), "end_time": ("end_time", "bigint", "0"),
    "run time": ("run_time", "double", "0D"), "darshan log version": ("log_version", "string", "''"), "start_time_asci": ("start_time_str", "string", "''"),
}

#: A number in a line: digits, perhaps a sign before, a fraction and an exponent behind.
NUMBER = r"([-+]?[0-9]+(?:[.][0-9]*)?(?:[eE][-+]?[0-9]+)?)"


def headers(lines: DataFrame) -> DataFrame:
    """file and the header keys (# key: value), the last line of a key holding; what isn't a number counts as 0."""
    key, value = F.trim(F.regexp_extract("value", r"^#\s*([^:]+):", 1)), F.trim(F.regexp_extract("value", r"^#\s*[^:]+:\s*(.*)$", 1))
    rows = lines.filter(F.col("value").startswith("#")).select("file", "line_no", key.alias("key"), value.alias("v")).filter(F.col("key").isin(*KEYS))
    last = lambda k: f"max_by(v, CASE WHEN key = '{k}' THEN line_no END)"
    pick = lambda k, t, none: f"CASE WHEN count_if(key = '{k}') = 0 THEN {none} ELSE " + (last(k) if t == "string" else f"coalesce(try_cast({last(k)} AS {t}), 0)") + " END"
    return rows.groupBy("file").agg(*[F.expr(pick(k, t, none)).alias(name) for k, (name, t, none) in KEYS.items()])


def totals(lines: DataFrame) -> DataFrame:
    """file, counter, value of the lines total_<COUNTER>: <number>, and of agg_perf_by_slowest as agg_perf_mib_s; the last line holds."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(F.trim("value"), pattern, i), F.lit(""))
    total, speed = rf"^total_(\w+):\s+{NUMBER}", rf"agg_perf_by_slowest:\s+{NUMBER}"
    counter = F.coalesce(part(total, 1), F.when(part(speed, 1).isNotNull(), "agg_perf_mib_s"))
    rows = lines.select("file", "line_no", counter.alias("counter"), F.coalesce(part(total, 2), part(speed, 1)).alias("v")).filter("counter is not null")
    return rows.groupBy("file", "counter").agg(F.max_by(F.col("v").cast("double"), "line_no").alias("value"))


def pivot_totals(total: DataFrame, counters: list[str] | None = None) -> DataFrame:
    """One row per file with a column per counter; the list is given, so no pass looks for it."""
    return total.groupBy("file").pivot("counter", counters or ALL_COUNTERS).agg(F.first("value"))


# The modules that a line '<MODULE> module ... ver=' names, in the order in which they are listed, and those that '<MODULE> module data' names, after them.
VERSIONED = ["POSIX", "MPI-IO", "STDIO", "H5F", "H5D", "LUSTRE", "PNETCDF", "APMPI", "HEATMAP"]
WITH_DATA = ["POSIX", "STDIO", "MPI-IO"]


def modules(lines: DataFrame) -> DataFrame:
    """file, modules of the files whose lines name any, in the order of VERSIONED, then of WITH_DATA."""
    versions = {m: F.max(F.col("value").rlike(rf"{m} module.*ver=")) for m in VERSIONED}
    data = {m: F.max(F.col("value").contains(f"{m} module data")) for m in WITH_DATA}
    found = lines.groupBy("file").agg(*[c.alias(f"v_{m}") for m, c in versions.items()], *[c.alias(f"d_{m}") for m, c in data.items()])
    names = [F.when(F.col(f"v_{m}"), F.lit(m)) for m in VERSIONED] + [F.when(F.col(f"d_{m}") & ~F.col(f"v_{m}"), F.lit(m)) for m in WITH_DATA]
    return found.select("file", F.array_compact(F.array(*names)).alias("modules")).filter(F.size("modules") > 0)


def mounts(lines: DataFrame) -> DataFrame:
    """file, uses_lustre, lustre_mount (the first) from the lines '# mount entry: <mount> <fs>'."""
    parts = F.split(F.col("value"), r"\t")
    rows = lines.filter(F.col("value").startswith("# mount entry:") & (F.size(parts) >= 3)).select("file", "line_no", parts[1].alias("mount"), parts[2].alias("fs"))
    lustre = F.col("fs") == "lustre"
    return rows.groupBy("file").agg(F.coalesce(F.max(lustre), F.lit(False)).alias("uses_lustre"), F.min_by(F.when(lustre, F.col("mount")), F.when(lustre, F.col("line_no"))).alias("lustre_mount"))


# Results in the lines of benchmark programs: words that a lower-cased line has all of and any of, and what surrounds the number.
TOOL_RESULTS = {
    "hacc_write_time_s": (["write", "second"], [], "", r"\s*second"), "hacc_total_bytes": (["total", "byte"], [], "", r"\s*byte"), "custom_runtime_s": ([], ["runtime", "elapsed"], "", r"\s*s"),
    "h5bench_write_rate": (["write"], ["rate", "mb/s"], "", r"\s*mi?b/s"), "h5bench_read_rate": (["read"], ["rate", "mb/s"], "", r"\s*mi?b/s"), "h5bench_write_rc": (["write completed"], [], r"exit code:\s*", ""),
    "dlio_throughput_samples_s": (["throughput"], [], "", r"\s*(?:samples?|it)/s"), "dlio_epoch_time_s": (["epoch", "time"], [], "", r"\s*s"),
}
#: Results whose number is the third word of a line with these words, in this case.
THIRD_WORD = {"ior_write_bw_mibs": "Max Write:", "ior_read_bw_mibs": "Max Read:"}
WHOLE = ("hacc_total_bytes", "h5bench_write_rc")


def tool_results(lines: DataFrame) -> DataFrame:
    """file and each program's results, null where no line has them; the last line of a kind holds."""
    low, digits, whole = F.lower("value"), r"([0-9]+(?:[.][0-9]*)?)", "([0-9]+)"
    picks = {n: F.when(F.col("value").contains(words), F.get(F.split(F.trim("value"), r"\s+"), F.lit(2)).try_cast("double")) for n, words in THIRD_WORD.items()}
    for n, (every, some, before, after) in TOOL_RESULTS.items():
        tests = [low.contains(w) for w in every] + ([F.greatest(*[low.contains(w) for w in some])] if some else [])
        pattern = before + (whole if n in WHOLE else digits) + after
        picks[n] = F.when(F.least(*tests, F.lit(True)), F.regexp_extract(low, pattern, 1).try_cast("bigint" if n in WHOLE else "double"))
    rows = lines.select("file", "line_no", *[c.alias(n) for n, c in picks.items()])
    return rows.groupBy("file").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in picks])


def path_parts(path) -> dict:
    """Columns of a log's path: log_date of Darshan_Logs/<y>/<m>/<d>/, the job id and rank of _id<job>-<rank>_, null where absent."""
    part = lambda pattern, i: F.regexp_extract(path, pattern, i).try_cast("bigint")
    day, ids = r"Darshan_Logs/(\d{4})/(\d{1,2})/(\d{1,2})/", r"_id(\d+)-(\d+)_"
    date = F.format_string("%04d-%02d-%02d", part(day, 1), part(day, 2), part(day, 3))
    return {"log_date": F.when(part(day, 1).isNotNull(), date), "job_id": part(ids, 1), "rank": part(ids, 2)}


def by_job(logs: DataFrame, path: str) -> DataFrame:
    """logs without probes (_lscpu_, _uname_), with job: the id in _id<job>-, else the file's name."""
    base = F.element_at(F.split(path, "/"), -1)
    found = F.nullif(F.regexp_extract(base, r"_id(\d+)-", 1), F.lit(""))
    return logs.filter(~base.rlike("_lscpu_|_uname_")).withColumn("job", F.coalesce(found, base))


def job_labels(lines: DataFrame) -> DataFrame:
    """file, scenario (its name without _<job>.out) and label: what follows Label: in the first such line."""
    line = F.trim("value")
    label = F.trim(F.element_at(F.split(line, "Label:"), -1))
    rows = lines.select("file", "line_no", F.when(line.startswith("Label:"), label).alias("label"))
    scenario = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"_\d+\.out$", "")
    return rows.groupBy("file").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("line_no"))).alias("label")).select("file", scenario.alias("scenario"), "label")


def run_timing(lines: DataFrame) -> DataFrame:
    """file, exit_code, start_time, end_time, each of the last line that tells it: a whole number after the last colon of a
    line with 'Exit code:', what follows the last ' - ' of a line that begins with E2E, what follows the last 'Completed:'."""
    line = F.trim("value")
    after = lambda mark: F.trim(F.substring_index(line, mark, -1))
    told = {
        "exit_code": F.when(line.contains("Exit code:"), after(":").try_cast("bigint")),
        "start_time": F.when(line.startswith("E2E") & line.contains(" - "), after(" - ")),
        "end_time": F.when(line.contains("Completed:"), after("Completed:")),
    }
    rows = lines.select("file", "line_no", *[c.alias(n) for n, c in told.items()])
    return rows.groupBy("file").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in told])


def missing_chunks(found: DataFrame, chunk: str, expected: int) -> DataFrame:
    """The chunk numbers 0 to expected - 1 that found doesn't hold."""
    return found.sparkSession.range(expected).select(F.col("id").alias(chunk)).join(found.select(chunk).distinct(), chunk, "left_anti")


def inventory(files: DataFrame, path: str, size: str) -> DataFrame:
    """year, month, log_date, n_files, bytes, a row for every day from the first to the last, days without logs as 0."""
    days = files.select(F.to_date(path_parts(F.col(path))["log_date"]).alias("log_date"), F.col(size).alias("bytes")).filter("log_date is not null").groupBy("log_date").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
    span = days.agg(F.sequence(F.min("log_date"), F.max("log_date")).alias("d")).select(F.explode("d").alias("log_date"))
    return span.join(days, "log_date", "left").fillna(0).select(F.year("log_date").alias("year"), F.month("log_date").alias("month"), "log_date", "n_files", "bytes")


def inventory_totals(days: DataFrame) -> DataFrame:
    """year, month, n_files, bytes, n_days with logs, first_day, last_day of an inventory: a row a month, a year (month null) and in all (both null)."""
    with_logs = F.when(F.col("n_files") > 0, F.col("log_date"))
    return days.rollup("year", "month").agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"), F.count(with_logs).alias("n_days"), F.min(with_logs).alias("first_day"), F.max(with_logs).alias("last_day"))
