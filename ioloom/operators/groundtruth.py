"""Labels known from how a benchmark was set up, and their verification against counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ioloom.functions.counters import DIMENSIONS

G, M, P, A, I, S, T, H = DIMENSIONS

# File-name globs in their order, with the labels they mean; the first match holds.
PATTERNS = {
    "ior_small_posix_*": ["access_granularity"],
    "ior_small_direct_*": ["access_granularity"],
    "ior_misaligned_*": ["access_granularity"],
    "ior_random_posix_*": ["access_pattern"],
    "ior_random_small_*": ["access_pattern", "access_granularity"],
    "ior_interface_posix_shared_*": ["interface_choice"],
    "ior_interface_mpiio_indep_*": ["interface_choice"],
    "ior_file_explosion_*": ["file_strategy"],
    "ior_fsync_per_write_*": ["throughput_utilization"],
    "ior_healthy_*": ["healthy"],
    "mdtest_meta_*": ["metadata_intensity"],
    "mdtest_deep_tree_*": ["metadata_intensity"],
    "mdtest_fpp_*": ["file_strategy"],
    "mdtest_healthy_*": ["healthy"],
    "dlio_small_*": ["access_granularity"],
    "dlio_ckpt_*": ["throughput_utilization"],
    "dlio_healthy_*": ["healthy"],
    "dlio_shuffle_*": ["access_pattern"],
    "custom_imbalance_*": ["parallelism_efficiency"],
    "custom_balanced_*": ["healthy"],
    "ior_io500_hard_*": ["access_granularity", "interface_choice"],
    "ior_io500_easy_*": ["healthy"],
    "mdtest_io500_hard_*": ["metadata_intensity"],
    "mdtest_io500_easy_*": ["healthy"],
    "ior_e2e_posix_shared_*": ["interface_choice"],
    "ior_e2e_mpiio_coll_*": ["healthy"],
    "h5b_indep_small_n*": ["interface_choice"],
    "h5b_interleaved_access_*": ["healthy"],
    "h5b_collective_small_*": ["access_granularity"],
    "h5b_collective_large_healthy_*": ["healthy"],
    "h5b_indep_large_healthy_*": ["healthy"],
    "h5b_indep_small_interleaved_*": ["access_granularity", "interface_choice"],
    "h5b_indep_interleaved_*": ["interface_choice"],
    "h5b_indep_small_single_ost_*": ["access_granularity", "interface_choice", "throughput_utilization"],
    "hacc_posix_shared_large_*": ["interface_choice"],
    "hacc_fpp_many_ranks_*": ["file_strategy"],
    "hacc_posix_shared_single_ost_*": ["throughput_utilization"],
    "hacc_mpiio_collective_healthy_*": ["healthy"],
    "hacc_fpp_healthy_*": ["healthy"],
    "hacc_posix_shared_small_p*": ["access_granularity", "interface_choice"],
    "hacc_posix_shared_small_1ost_*": ["access_granularity", "interface_choice", "throughput_utilization"],
    "hacc_fpp_small_many_*": ["file_strategy", "access_granularity"],
    "hacc_posix_shared_many_single_ost_*": ["interface_choice", "throughput_utilization"],
}
# What an intended label must show, and what a log must hold to be looked at.
CHECKS = {G: ("small_io_ratio", 0.3, 1.0), M: ("metadata_time_ratio", 0.05, 1.0), P: ("rank_bytes_cv", 0.2, 100.0), A: ("seq_write_ratio", 0.0, 0.7), H: ("small_io_ratio", 0.0, 0.3)}
MIN_RUNTIME, MIN_BYTES, MIN_OPS, MIN_FILES, PASS_SHARE = 5.0, 10240, 100, 50, 0.8


def pattern_dims(name: Column) -> Column:
    """The labels of the first pattern that the lower-cased name matches, null if none. A star stands for any characters."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.like(glob.replace("_", r"\_").replace("*", "%")), F.array(*map(F.lit, dims))) for glob, dims in PATTERNS.items()])


def benchmark_of(name: Column) -> Column:
    """The benchmark that a log's name shows, special names before general ones."""
    low = F.lower(name)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    chain = F.when(has("hacc_io"), "hacc_io").when(has("h5bench", "h5b_"), "h5bench").when(has("mdtest"), "mdtest").when(low.startswith("ior_") | has("_ior_", "_ior "), "ior")
    return chain.when(has("dlio"), "dlio").when(has("custom_", "imbalance", "balanced"), "custom").otherwise("unknown")


def scenario_of(path: Column) -> Column:
    """The name of a log's run: its file name in lower case, without a job number's suffix and the extension."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(F.regexp_replace(base, r"_\d{4,}_\d+.*\.darshan$", ""), r"\.darshan$", "")


# Words in a log's name with the labels they show; the first that occurs holds.
INFERRED = [
    (["small_posix", "small_direct", "misaligned"], ["access_granularity"]),
    (["random_small"], ["access_pattern", "access_granularity"]),
    (["random_posix"], ["access_pattern"]),
    (["interface_posix_shared", "interface_mpiio_indep"], ["interface_choice"]),
    (["file_explosion"], ["file_strategy"]),
    (["fsync_per_write"], ["throughput_utilization"]),
    (["healthy"], ["healthy"]),
    (["meta_shared", "meta_unique", "meta_cross", "deep_tree"], ["metadata_intensity"]),
    (["fpp_explosion"], ["file_strategy"]),
    (["dlio_small"], ["access_granularity"]),
    (["dlio_ckpt", "checkpoint"], ["throughput_utilization"]),
    (["shuffle"], ["access_pattern"]),
    (["imbalance"], ["parallelism_efficiency"]),
    (["balanced"], ["healthy"]),
]


def inferred_dims(path: Column) -> Column:
    """The labels that words in a log's file name show, an empty array if none."""
    low = F.lower(F.element_at(F.split(path, "/"), -1))
    has = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    chain = F.lit(None).cast("array<string>")
    for words, dims in reversed(INFERRED):
        chain = F.when(has(words), F.array(*map(F.lit, dims))).otherwise(chain)
    return F.coalesce(chain, F.expr("cast(array() as array<string>)"))


def shown_labels(columns: list[str]) -> dict[str, Column]:
    """The eight labels that a job's counters show, as 0/1; features that aren't there count as harmless."""
    at = lambda c, none: F.coalesce(F.col(c), F.lit(none)) if c in columns else F.lit(none)
    shown = {
        G: at("small_io_ratio", 0.0) > 0.5, M: at("metadata_time_ratio", 0.0) > 0.3, P: at("rank_bytes_cv", 0.0) > 0.3, A: (at("seq_write_ratio", 1.0) < 0.5) & (at("seq_read_ratio", 1.0) < 0.5),
        I: (at("is_shared_file", 0) != 0) & (at("nprocs", 1.0) > 4) & ((at("has_mpiio", 0) == 0) | (at("MPIIO_COLL_WRITES", 0.0) == 0)), S: at("num_files", 0.0) > 100, T: (at("write_bw_mb_s", float("inf")) < 10) & (at("POSIX_BYTES_WRITTEN", 0.0) > 1e6),
    }
    none = ~F.greatest(*shown.values())
    return {d: c.cast("int") for d, c in (shown | {H: none}).items()}


def relabelled(df: DataFrame) -> DataFrame:
    """df (engineered features) with the eight labels that its counters show."""
    return df.withColumns(shown_labels(df.columns))


def assigned(df: DataFrame, name: str) -> DataFrame:
    """df (name and engineered features) with the eight labels, label_source and label_verified.

    The labels of a known name's pattern hold where they pass verification (construction), the counters' own
    labels otherwise (relabeled); a name without a pattern takes the labels that its words show (inferred). healthy is then
    what no other label denies.
    """
    words, own = inferred_dims(F.col(name)), shown_labels(df.columns)
    source = F.when(~F.col("pattern_known"), "inferred").when(F.col("verified"), "construction").otherwise("relabeled")
    out = verified(with_labels(df, name)).withColumn("label_source", source)
    pick = lambda d: F.when(F.col("label_source") == "construction", F.col(d)).when(F.col("label_source") == "inferred", F.array_contains(words, d).cast("int")).otherwise(own[d])
    return close_healthy(out.select(*df.columns, *[pick(d).alias(d) for d in DIMENSIONS], "label_source", (F.col("label_source") != "relabeled").alias("label_verified")))


def label_statistics(df: DataFrame) -> DataFrame:
    """label_source, dimension, n, pct of the source's rows, in one pass."""
    row = df.groupBy("label_source").agg(F.count("*").alias("total"), *[F.sum(d).alias(d) for d in DIMENSIONS])
    return row.unpivot(["label_source", "total"], DIMENSIONS, "dimension", "n").select("label_source", "dimension", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def with_labels(df: DataFrame, name: str) -> DataFrame:
    """df with a 0/1 column for each dimension and pattern_known."""
    dims = pattern_dims(F.col(name))
    return df.select("*", *[F.coalesce(F.array_contains(dims, d), F.lit(False)).cast("int").alias(d) for d in DIMENSIONS], dims.isNotNull().alias("pattern_known"))


def close_healthy(df: DataFrame) -> DataFrame:
    """healthy is 1 just where no other dimension is."""
    return df.withColumn("healthy", (F.greatest(*DIMENSIONS[:-1]) == 0).cast("int"))


def parse_label_string(c: Column) -> Column:
    """'a=1,b=0' as a map."""
    return F.transform_values(F.str_to_map(F.regexp_replace(c, r"\s+", ""), F.lit(","), F.lit("=")), lambda _, v: v.cast("int"))


def verified(df: DataFrame) -> DataFrame:
    """df (intended labels and engineered features) with included, n_checks, n_passed and verified."""
    checks = [(F.col(d) == 1, F.col(f).between(lo, hi)) for d, (f, lo, hi) in CHECKS.items()]
    checks.append((F.col(I) == 1, (F.col("has_mpiio") == 0) | (F.col("MPIIO_COLL_WRITES") == 0)))
    checks.append((F.col(S) == 1, (F.col("num_files") / F.greatest("nprocs", F.lit(1.0)) >= 1) & (F.col("num_files") >= MIN_FILES)))
    n = sum(a.cast("int") for a, _ in checks)
    ok = sum((a & F.coalesce(b, F.lit(False))).cast("int") for a, b in checks)
    included = (F.col("runtime_seconds") >= MIN_RUNTIME) & (F.col("POSIX_BYTES_READ") + F.col("POSIX_BYTES_WRITTEN") >= MIN_BYTES) & (F.col("POSIX_READS") + F.col("POSIX_WRITES") >= MIN_OPS)
    return df.select("*", included.alias("included"), n.alias("n_checks"), ok.alias("n_passed")).withColumn("verified", F.col("included") & ((F.col("n_checks") == 0) | (F.col("n_passed") >= PASS_SHARE * F.col("n_checks"))))
