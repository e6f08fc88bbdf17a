"""The fixed counter schema of a log record and the rule that merges each counter over records."""

from __future__ import annotations

# Counter names as the logs write them.
_READ_BINS = ["0_100", "100_1K", "1K_10K", "10K_100K", "100K_1M", "1M_4M", "4M_10M", "10M_100M", "100M_1G", "1G_PLUS"]
POSIX_INT = (
    [f"POSIX_{c}" for c in "OPENS FILENOS DUPS READS WRITES SEEKS STATS MMAPS FSYNCS FDSYNCS RENAME_SOURCES RENAME_TARGETS RW_SWITCHES BYTES_READ BYTES_WRITTEN MAX_BYTE_READ MAX_BYTE_WRITTEN CONSEC_READS CONSEC_WRITES SEQ_READS SEQ_WRITES MEM_NOT_ALIGNED MEM_ALIGNMENT FILE_NOT_ALIGNED FILE_ALIGNMENT".split()]
    + [f"POSIX_SIZE_{d}_{b}" for d in ("READ", "WRITE") for b in _READ_BINS]
    + [f"POSIX_{g}{i}_{s}" for g, v in (("ACCESS", "ACCESS"), ("STRIDE", "STRIDE")) for s in (v, "COUNT") for i in range(1, 5)]
    + [f"POSIX_{c}" for c in "FASTEST_RANK FASTEST_RANK_BYTES SLOWEST_RANK SLOWEST_RANK_BYTES MAX_READ_TIME_SIZE MAX_WRITE_TIME_SIZE MODE RENAMED_FROM".split()]
)
POSIX_FLOAT = [f"POSIX_F_{c}" for c in "READ_TIME WRITE_TIME META_TIME MAX_READ_TIME MAX_WRITE_TIME OPEN_START_TIMESTAMP READ_START_TIMESTAMP WRITE_START_TIMESTAMP CLOSE_START_TIMESTAMP OPEN_END_TIMESTAMP READ_END_TIMESTAMP WRITE_END_TIMESTAMP CLOSE_END_TIMESTAMP FASTEST_RANK_TIME SLOWEST_RANK_TIME VARIANCE_RANK_TIME VARIANCE_RANK_BYTES".split()]
MPIIO_INT = [f"MPIIO_{c}" for c in "INDEP_OPENS COLL_OPENS INDEP_READS INDEP_WRITES COLL_READS COLL_WRITES SPLIT_READS SPLIT_WRITES NB_READS NB_WRITES SYNCS HINTS VIEWS BYTES_READ BYTES_WRITTEN RW_SWITCHES".split()] + [f"MPIIO_ACCESS{i}_{s}" for s in ("ACCESS", "COUNT") for i in range(1, 5)]
MPIIO_FLOAT = [f"MPIIO_F_{c}" for c in "READ_TIME WRITE_TIME META_TIME MAX_READ_TIME MAX_WRITE_TIME FASTEST_RANK_TIME SLOWEST_RANK_TIME VARIANCE_RANK_TIME VARIANCE_RANK_BYTES".split()]
STDIO_INT = [f"STDIO_{c}" for c in "OPENS FDOPENS READS WRITES SEEKS FLUSHES BYTES_READ BYTES_WRITTEN MAX_BYTE_READ MAX_BYTE_WRITTEN".split()]
STDIO_FLOAT = [f"STDIO_F_{c}" for c in "READ_TIME WRITE_TIME META_TIME FASTEST_RANK_TIME SLOWEST_RANK_TIME VARIANCE_RANK_TIME VARIANCE_RANK_BYTES".split()]

MODULES = {"POSIX": POSIX_INT + POSIX_FLOAT, "MPI-IO": MPIIO_INT + MPIIO_FLOAT, "STDIO": STDIO_INT + STDIO_FLOAT}
ALL_COUNTERS = [c for cs in MODULES.values() for c in cs]
FLOATS = set(POSIX_FLOAT + MPIIO_FLOAT + STDIO_FLOAT)
MODULE_OF = {c: m for m, cs in MODULES.items() for c in cs}
TOP4 = {"POSIX_ACCESS": "ACCESS", "POSIX_STRIDE": "STRIDE", "MPIIO_ACCESS": "ACCESS"}


def top4_columns(group: str) -> list[tuple[str, str]]:
    """(value column, count column) of the four places of a group."""
    return [(f"{group}{i}_{TOP4[group]}", f"{group}{i}_COUNT") for i in range(1, 5)]


_TOP4_COLUMNS = {c for g in TOP4 for pair in top4_columns(g) for c in pair}


def rule_of(counter: str) -> str:
    """sum_clamp, sum, max, min_nonzero, last, top4, shared_last, shared_min, shared_max, argmax or zero."""
    name = counter.split("_", 1)[1]
    if counter in _TOP4_COLUMNS:
        return "top4"
    if name.endswith("TIME_SIZE"):
        return "argmax"
    if name in ("FASTEST_RANK", "FASTEST_RANK_BYTES", "SLOWEST_RANK", "SLOWEST_RANK_BYTES"):
        return "shared_last"
    if name == "F_FASTEST_RANK_TIME":
        return "shared_min"
    if name == "F_SLOWEST_RANK_TIME":
        return "shared_max"
    if name.startswith("F_VARIANCE"):
        return "zero"
    if name.endswith("START_TIMESTAMP"):
        return "min_nonzero"
    if name.endswith("END_TIMESTAMP") or name.startswith(("MAX_BYTE", "F_MAX_")):
        return "max"
    if name in ("MODE", "MEM_ALIGNMENT", "FILE_ALIGNMENT", "RENAMED_FROM"):
        return "last"
    return "sum" if counter in FLOATS else "sum_clamp"


def of_rule(rule: str) -> list[str]:
    return [c for c in ALL_COUNTERS if rule_of(c) == rule]


#: The eight diagnosis dimensions, the last meaning that no other holds.
DIMENSIONS = ["access_granularity", "metadata_intensity", "parallelism_efficiency", "access_pattern", "interface_choice", "file_strategy", "throughput_utilization", "healthy"]

DERIVED = """read_ratio read_bw_mb_s write_bw_mb_s total_bw_mb_s avg_read_size avg_write_size small_read_ratio small_write_ratio small_io_ratio
medium_read_ratio medium_write_ratio large_read_ratio large_write_ratio seq_read_ratio seq_write_ratio consec_read_ratio consec_write_ratio rw_ratio
rw_switch_ratio mem_misalign_ratio file_misalign_ratio metadata_time_ratio read_time_fraction write_time_fraction opens_per_op stats_per_op seeks_per_op
fsync_ratio opens_per_mb rank_bytes_cv rank_time_cv byte_imbalance time_imbalance collective_ratio nonblocking_ratio io_duration io_active_fraction
access_size_concentration dominant_access_size""".split()
INDICATORS = "has_posix has_mpiio has_stdio has_hdf5 has_pnetcdf has_apmpi has_heatmap is_shared_file".split()

#: Normalization group of each feature: those that decide how it is scaled.
UNBOUNDED = "read_bw_mb_s write_bw_mb_s total_bw_mb_s avg_read_size avg_write_size rw_ratio opens_per_op stats_per_op seeks_per_op fsync_ratio opens_per_mb rank_bytes_cv rank_time_cv io_active_fraction".split()
ABSOLUTE = ["io_duration", "dominant_access_size", "num_files"]


def group_of(feature: str) -> str:
    """volume, count, histogram, top4, timing, timestamp, categorical, rank_id, conditional_size, indicator, ratio, ratio_unbounded, derived_absolute or metadata."""
    if feature in INDICATORS:
        return "indicator"
    if feature in ABSOLUTE:
        return "derived_absolute"
    if feature in DERIVED:
        return "ratio_unbounded" if feature in UNBOUNDED else "ratio"
    if feature in ("nprocs", "runtime_seconds"):
        return "metadata"
    by_rule = {"top4": "top4", "last": "categorical", "argmax": "conditional_size"}
    if (rule := rule_of(feature)) in by_rule:
        return by_rule[rule]
    name = feature.split("_", 1)[1]
    if name.endswith("TIMESTAMP"):
        return "timestamp"
    if feature in FLOATS:
        return "timing"
    if name in ("FASTEST_RANK", "SLOWEST_RANK"):
        return "rank_id"
    if name.startswith("SIZE_"):
        return "histogram"
    return "volume" if "BYTE" in name else "count"
