"""SQL text of the domain tables and of each stage, for holding the operators against another engine."""

from __future__ import annotations

from ioloom.functions.counters import ALL_COUNTERS, DIMENSIONS, FLOATS, MODULE_OF, MODULES, TOP4, of_rule, rule_of, top4_columns
from ioloom.operators.rules import CODES, CODES_OF, SEVERITY, WEIGHT
from ioloom.sources.surrogate import jobs_sql, records_sql


def merge_sql(c: str) -> str:
    shared = f"coalesce(s_{MODULE_OF[c].replace('-', '').lower()}, false)"
    last = f"arg_max({c}, record_seq) FILTER ({c} IS NOT NULL)"
    return {
        "sum_clamp": f"CASE WHEN count(*) FILTER ({c} = -1) > 0 THEN -1 ELSE CAST(sum({c}) AS BIGINT) END",
        "sum": f"sum({c})", "max": f"max({c})", "min_nonzero": f"coalesce(min({c}) FILTER ({c} > 0), 0.0)", "last": last,
        "shared_last": f"CASE WHEN bool_or({shared}) THEN {last} ELSE -1 END", "shared_min": f"CASE WHEN bool_or({shared}) THEN min({c}) ELSE 0.0 END", "shared_max": f"CASE WHEN bool_or({shared}) THEN max({c}) ELSE 0.0 END",
        "argmax": f"arg_max({c}, {c.replace('MAX_', 'F_MAX_').replace('_TIME_SIZE', '_TIME')} * 1000000 - record_seq) FILTER ({c} IS NOT NULL)", "zero": "0.0",
    }[rule_of(c)]


def top4_sql(groups: list[str]) -> str:
    """CTEs pairs, counted, placed and places (one row per job) over records."""
    pairs = " UNION ALL ".join(f"SELECT jobid, '{g}' AS grp, {v} AS value, {n} AS n FROM records WHERE {n} > 0" for g in groups for v, n in top4_columns(g))
    picks = ", ".join(f"coalesce(max({c}) FILTER (grp = '{g}' AND place = {i}), 0) AS {name}" for g in groups for i, pair in enumerate(top4_columns(g), 1) for name, c in zip(pair, ("value", "n"), strict=True))
    return f"""pairs AS ({pairs}),
counted AS (SELECT jobid, grp, value, CAST(sum(n) AS BIGINT) AS n FROM pairs GROUP BY jobid, grp, value),
placed AS (SELECT *, row_number() OVER (PARTITION BY jobid, grp ORDER BY n DESC, value DESC) AS place FROM counted),
places AS (SELECT jobid, {picks} FROM placed WHERE place <= 4 GROUP BY jobid)"""


_FLAGS = ", ".join(f"bool_or(shared) FILTER (module = '{m}') AS s_{m.replace('-', '').lower()}" for m in MODULES)
_PLAIN = [c for c in ALL_COUNTERS if rule_of(c) != "top4"]

RECORDS = f"records AS ({records_sql()})"
JOBS = f"jobs AS ({jobs_sql()})"
MERGED = f"""{RECORDS},
flags AS (SELECT jobid, {_FLAGS} FROM (SELECT jobid, module, min(file_id) = max(file_id) AS shared FROM records GROUP BY jobid, module) x GROUP BY jobid),
plain AS (SELECT records.jobid, {", ".join(f"{merge_sql(c)} AS {c}" for c in _PLAIN)}, count(DISTINCT file_id) AS num_files, count(*) AS n_records, string_agg(DISTINCT module, ',' ORDER BY module) AS modules, bool_or(coalesce(s_posix, false)) AS shared_posix
  FROM records JOIN flags ON records.jobid = flags.jobid GROUP BY records.jobid),
{top4_sql(list(TOP4))},
merged AS (SELECT plain.*, {", ".join(f"coalesce({c}, 0) AS {c}" for g in TOP4 for p in top4_columns(g) for c in p)} FROM plain LEFT JOIN places ON plain.jobid = places.jobid)"""

RAW = f"""{MERGED}, {JOBS},
raw AS (SELECT m.jobid AS _jobid, uid AS _uid, start_time AS _start_time, modules AS _modules, benchmark AS _benchmark, scenario AS _scenario, CAST(greatest(nprocs, 1) AS DOUBLE) AS nprocs, greatest(runtime, 0.0) AS runtime_seconds,
  {", ".join(f"coalesce(CAST(m.{c} AS DOUBLE), 0.0) AS {c}" for c in ALL_COUNTERS)},
  CAST(modules LIKE '%POSIX%' AS INT) AS has_posix, CAST(modules LIKE '%MPI-IO%' AS INT) AS has_mpiio, CAST(modules LIKE '%STDIO%' AS INT) AS has_stdio, 0 AS has_hdf5, 0 AS has_pnetcdf, 0 AS has_apmpi, 0 AS has_heatmap,
  CAST(shared_posix AS INT) AS is_shared_file, CAST(num_files AS DOUBLE) AS num_files FROM merged m JOIN jobs j ON m.jobid = j.jobid)"""

PASSES = ["has_posix = 1", "runtime_seconds >= 1", "POSIX_BYTES_READ + POSIX_BYTES_WRITTEN >= 1024", "POSIX_READS + POSIX_WRITES >= 1", "POSIX_F_READ_TIME >= 0 AND POSIX_F_WRITE_TIME >= 0 AND POSIX_F_META_TIME >= 0"]
_REPAIRED = ["POSIX_FASTEST_RANK", "POSIX_SLOWEST_RANK", "POSIX_FASTEST_RANK_BYTES", "POSIX_SLOWEST_RANK_BYTES", "POSIX_MMAPS"]
CLEAN = f"{RAW},\nclean AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = -1 THEN 0.0 ELSE {c} END AS {c}' for c in _REPAIRED)}) FROM raw WHERE {' AND '.join(f'({p})' for p in PASSES)})"

_N = [*ALL_COUNTERS, "nprocs", "runtime_seconds", "num_files"]
_S = lambda way, bins: "(" + " + ".join(f"POSIX_SIZE_{way}_{b}" for b in bins.split()) + ")"
_SMALL, _MEDIUM, _LARGE = "0_100 100_1K", "1K_10K 10K_100K 100K_1M", "1M_4M 4M_10M 10M_100M 100M_1G 1G_PLUS"
_R, _W, _O = "greatest(POSIX_READS, 1)", "greatest(POSIX_WRITES, 1)", "greatest(POSIX_READS + POSIX_WRITES, 1)"
_B, _T = "(POSIX_BYTES_READ + POSIX_BYTES_WRITTEN)", "(POSIX_F_READ_TIME + POSIX_F_WRITE_TIME + POSIX_F_META_TIME)"
_M = "greatest(MPIIO_COLL_READS + MPIIO_COLL_WRITES + MPIIO_INDEP_READS + MPIIO_INDEP_WRITES + MPIIO_NB_READS + MPIIO_NB_WRITES, 1)"
DERIVED_SQL = {
    "read_ratio": f"POSIX_BYTES_READ / greatest({_B}, 1)", "read_bw_mb_s": "POSIX_BYTES_READ / greatest(POSIX_F_READ_TIME, 1e-9) / 1e6", "write_bw_mb_s": "POSIX_BYTES_WRITTEN / greatest(POSIX_F_WRITE_TIME, 1e-9) / 1e6",
    "total_bw_mb_s": f"{_B} / greatest(POSIX_F_READ_TIME + POSIX_F_WRITE_TIME, 1e-9) / 1e6", "avg_read_size": f"POSIX_BYTES_READ / {_R}", "avg_write_size": f"POSIX_BYTES_WRITTEN / {_W}",
    "small_read_ratio": f"{_S('READ', _SMALL)} / {_R}", "small_write_ratio": f"{_S('WRITE', _SMALL)} / {_W}", "small_io_ratio": f"({_S('READ', _SMALL)} + {_S('WRITE', _SMALL)}) / {_O}",
    "medium_read_ratio": f"{_S('READ', _MEDIUM)} / {_R}", "medium_write_ratio": f"{_S('WRITE', _MEDIUM)} / {_W}", "large_read_ratio": f"{_S('READ', _LARGE)} / {_R}", "large_write_ratio": f"{_S('WRITE', _LARGE)} / {_W}",
    "seq_read_ratio": f"POSIX_SEQ_READS / {_R}", "seq_write_ratio": f"POSIX_SEQ_WRITES / {_W}", "consec_read_ratio": f"POSIX_CONSEC_READS / {_R}", "consec_write_ratio": f"POSIX_CONSEC_WRITES / {_W}",
    "rw_ratio": f"POSIX_READS / {_W}", "rw_switch_ratio": f"POSIX_RW_SWITCHES / {_O}", "mem_misalign_ratio": f"POSIX_MEM_NOT_ALIGNED / {_O}", "file_misalign_ratio": f"POSIX_FILE_NOT_ALIGNED / {_O}",
    "metadata_time_ratio": f"POSIX_F_META_TIME / greatest({_T}, 1e-9)", "read_time_fraction": f"POSIX_F_READ_TIME / greatest({_T}, 1e-9)", "write_time_fraction": f"POSIX_F_WRITE_TIME / greatest({_T}, 1e-9)",
    "opens_per_op": f"POSIX_OPENS / {_O}", "stats_per_op": f"POSIX_STATS / {_O}", "seeks_per_op": f"POSIX_SEEKS / {_O}", "fsync_ratio": f"POSIX_FSYNCS / {_W}", "opens_per_mb": f"POSIX_OPENS / greatest({_B} / 1e6, 1e-9)",
    "rank_bytes_cv": f"sqrt(greatest(POSIX_F_VARIANCE_RANK_BYTES, 0)) / greatest({_B} / greatest(nprocs, 1), 1e-9)", "rank_time_cv": f"sqrt(greatest(POSIX_F_VARIANCE_RANK_TIME, 0)) / greatest({_T} / greatest(nprocs, 1), 1e-9)",
    "byte_imbalance": f"(POSIX_SLOWEST_RANK_BYTES - POSIX_FASTEST_RANK_BYTES) / greatest({_B}, 1e-9)", "time_imbalance": f"(POSIX_F_SLOWEST_RANK_TIME - POSIX_F_FASTEST_RANK_TIME) / greatest({_T}, 1e-9)",
    "collective_ratio": f"(MPIIO_COLL_READS + MPIIO_COLL_WRITES) / {_M}", "nonblocking_ratio": f"(MPIIO_NB_READS + MPIIO_NB_WRITES) / {_M}",
    "io_duration": "greatest(POSIX_F_CLOSE_END_TIMESTAMP - POSIX_F_OPEN_START_TIMESTAMP, 0)", "io_active_fraction": f"{_T} / greatest(runtime_seconds, 1e-9)", "access_size_concentration": f"POSIX_ACCESS1_COUNT / {_O}", "dominant_access_size": "POSIX_ACCESS1_ACCESS",
}
ENGINEERED = f"""{CLEAN},
zeroed AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {c} = -1 THEN 0.0 ELSE {c} END AS {c}" for c in _N)}) FROM clean),
engineered AS (SELECT *, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in DERIVED_SQL.items())} FROM zeroed)"""

_ST = "(STDIO_BYTES_READ + STDIO_BYTES_WRITTEN)"
_TILT = lambda a, b, whole: f"{a} > {b} AND abs({a} - {b}) / {whole} > 0.1"
_SM = lambda way, n: f"{_S(way, _SMALL + ' ' + _MEDIUM)} / greatest({n}, 1) > 0.1 AND {_S(way, _SMALL + ' ' + _MEDIUM)} > 1000"
_RND = lambda way: f"(POSIX_{way}S - POSIX_SEQ_{way}S) / greatest(POSIX_{way}S, 1) > 0.2 AND POSIX_{way}S - POSIX_SEQ_{way}S > 1000"
CODE_SQL = {
    "S01": f"{_ST} / greatest(greatest({_B}, 1) + {_ST}, 1) > 0.1", "P01": _TILT("POSIX_WRITES", "POSIX_READS", _O), "P02": _TILT("POSIX_READS", "POSIX_WRITES", _O), "P03": _TILT("POSIX_BYTES_WRITTEN", "POSIX_BYTES_READ", f"greatest({_B}, 1)"), "P04": _TILT("POSIX_BYTES_READ", "POSIX_BYTES_WRITTEN", f"greatest({_B}, 1)"),
    "P05": _SM("READ", "POSIX_READS"), "P06": _SM("WRITE", "POSIX_WRITES"), "P07": f"POSIX_MEM_NOT_ALIGNED / {_O} > 0.1", "P08": f"POSIX_FILE_NOT_ALIGNED / {_O} > 0.1", "P09": "POSIX_MAX_BYTE_READ > POSIX_BYTES_READ", "P10": "POSIX_MAX_BYTE_WRITTEN > POSIX_BYTES_WRITTEN",
    "P11": _RND("READ"), "P12": f"NOT ({_RND('READ')}) AND POSIX_READS > 0", "P13": _RND("WRITE"), "P14": f"NOT ({_RND('WRITE')}) AND POSIX_WRITES > 0", "P15": f"is_shared_file = 1 AND {_SM('READ', 'POSIX_READS')}", "P16": f"is_shared_file = 1 AND {_SM('WRITE', 'POSIX_WRITES')}",
    "P17": "POSIX_F_META_TIME > 30", "P18": "nprocs > 1 AND byte_imbalance > 0.15", "P19": "nprocs > 1 AND time_imbalance > 0.15", "P21": "nprocs > 1 AND byte_imbalance > 0.3", "P22": "nprocs > 1 AND byte_imbalance > 0.3",
    "M01": "has_mpiio = 0", "M02": "MPIIO_COLL_READS = 0 AND MPIIO_INDEP_READS + MPIIO_COLL_READS > 1000", "M03": "MPIIO_COLL_WRITES = 0 AND MPIIO_INDEP_WRITES + MPIIO_COLL_WRITES > 1000", "M04": "MPIIO_COLL_READS > 0", "M05": "MPIIO_COLL_WRITES > 0",
    "M06": "has_mpiio = 1 AND MPIIO_NB_READS = 0", "M07": "has_mpiio = 1 AND MPIIO_NB_WRITES = 0", "M08": "false", "M09": "false", "M10": "false",
}
_DIM_SQL = {d: " OR ".join(f"{c} = 1" for c in CODES_OF[d]) for d in DIMENSIONS[:-1]}
_ISSUES = [c for c in CODES if SEVERITY[c] in WEIGHT]
LABELS = f"""{ENGINEERED},
coded AS (SELECT *, {", ".join(f"CAST(({CODE_SQL[c]}) AS INT) AS {c}" for c in CODES)} FROM engineered),
dimmed AS (SELECT *, {", ".join(f"CAST(({e}) AS INT) AS {d}" for d, e in _DIM_SQL.items())} FROM coded),
labels_ AS (SELECT *, CAST({" + ".join(DIMENSIONS[:-1])} = 0 AS INT) AS healthy,
  CASE WHEN {" + ".join(DIMENSIONS[:-1])} = 0 THEN 0.5 ELSE ({" + ".join(f"{c} * {WEIGHT[SEVERITY[c]]}" for c in _ISSUES)}) / (10.0 * greatest({" + ".join(_ISSUES)}, 1)) END AS confidence, 'rules' AS label_source, {" + ".join(CODES)} AS n_codes FROM dimmed)"""


def rounded(columns: list[str]) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


def r6(c: str) -> str:
    """Rounding to 6 places that engines agree on."""
    return f"floor(({c}) * 1000000.0 + 0.5) / 1000000.0"


def of(*rules: str) -> list[str]:
    return [c for r in rules for c in of_rule(r)]


assert set(FLOATS) <= set(ALL_COUNTERS)
