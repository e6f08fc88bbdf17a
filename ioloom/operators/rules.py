"""Threshold rules: 32 codes per job, the eight labels they mean, and the confidence in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ioloom.functions.counters import DIMENSIONS

# Thresholds and severities of the codes.
SMALL_SHARE, SMALL_COUNT = 0.1, 1000
RANDOM_SHARE, RANDOM_COUNT = 0.2, 1000
BALANCE, MISALIGNED, STDIO_SHARE = 0.1, 0.1, 0.1
META_SECONDS, STRAGGLERS, SIZE_IMBALANCE, COLLECTIVE_COUNT = 30, 0.15, 0.3, 1000
#: Weights in tenths, so that their sums are exact.
WEIGHT = {"HIGH": 10, "WARN": 7, "INFO": 3}
SEVERITY = {
    "S01": "HIGH", "P01": "INFO", "P02": "INFO", "P03": "INFO", "P04": "INFO", "P05": "HIGH", "P06": "HIGH", "P07": "HIGH", "P08": "HIGH", "P09": "WARN", "P10": "WARN",
    "P11": "HIGH", "P12": "OK", "P13": "HIGH", "P14": "OK", "P15": "HIGH", "P16": "HIGH", "P17": "HIGH", "P18": "HIGH", "P19": "HIGH", "P21": "HIGH", "P22": "HIGH",
    "M01": "WARN", "M02": "HIGH", "M03": "HIGH", "M04": "OK", "M05": "OK", "M06": "WARN", "M07": "WARN", "M08": "OK", "M09": "OK", "M10": "OK",
}
CODES = list(SEVERITY)
#: The codes of which any one sets a dimension.
CODES_OF = dict(zip(DIMENSIONS, (["P05", "P06"], ["P17"], ["P18", "P19", "P21", "P22"], ["P11", "P13"], ["M02", "M03"], ["P15", "P16"], ["P09", "P10"]), strict=False))


def rule_codes() -> dict[str, Column]:
    """Every code as a boolean column over an engineered job row; small means under 1 MB."""
    p, m, lit = (lambda n: F.col(f"POSIX_{n}")), (lambda n: F.col(f"MPIIO_{n}")), F.lit
    over1 = lambda x: F.greatest(x, lit(1.0))
    small = lambda way: sum((p(f"SIZE_{way}_{b}") for b in ("100_1K", "1K_10K", "10K_100K", "100K_1M")), p(f"SIZE_{way}_0_100"))
    reads, writes, br, bw = p("READS"), p("WRITES"), p("BYTES_READ"), p("BYTES_WRITTEN")
    ops, total, stdio = over1(reads + writes), over1(br + bw), F.col("STDIO_BYTES_READ") + F.col("STDIO_BYTES_WRITTEN")
    tilted = lambda a, b, whole: (a > b) & (F.abs(a - b) / whole > BALANCE)
    many_small = lambda way, n: (small(way) / over1(n) > SMALL_SHARE) & (small(way) > SMALL_COUNT)
    random = lambda n, seq: ((n - seq) / over1(n) > RANDOM_SHARE) & (n - seq > RANDOM_COUNT)
    shared, several, mpi = F.col("is_shared_file") == 1, F.col("nprocs") > 1, F.col("has_mpiio") == 1
    no_coll = lambda way: (m(f"COLL_{way}") == 0) & (m(f"INDEP_{way}") + m(f"COLL_{way}") > COLLECTIVE_COUNT)
    p05, p06, p11, p13 = many_small("READ", reads), many_small("WRITE", writes), random(reads, p("SEQ_READS")), random(writes, p("SEQ_WRITES"))
    sized = several & (F.col("byte_imbalance") > SIZE_IMBALANCE)
    return {
        "S01": stdio / over1(total + stdio) > STDIO_SHARE,
        "P01": tilted(writes, reads, ops), "P02": tilted(reads, writes, ops), "P03": tilted(bw, br, total), "P04": tilted(br, bw, total),
        "P05": p05, "P06": p06, "P07": p("MEM_NOT_ALIGNED") / ops > MISALIGNED, "P08": p("FILE_NOT_ALIGNED") / ops > MISALIGNED,
        "P09": p("MAX_BYTE_READ") > br, "P10": p("MAX_BYTE_WRITTEN") > bw,
        "P11": p11, "P12": ~p11 & (reads > 0), "P13": p13, "P14": ~p13 & (writes > 0), "P15": shared & p05, "P16": shared & p06,
        "P17": p("F_META_TIME") > META_SECONDS, "P18": several & (F.col("byte_imbalance") > STRAGGLERS), "P19": several & (F.col("time_imbalance") > STRAGGLERS), "P21": sized, "P22": sized,
        "M01": ~mpi, "M02": no_coll("READS"), "M03": no_coll("WRITES"), "M04": m("COLL_READS") > 0, "M05": m("COLL_WRITES") > 0, "M06": mpi & (m("NB_READS") == 0), "M07": mpi & (m("NB_WRITES") == 0),
        "M08": lit(False), "M09": lit(False), "M10": lit(False),
    }


def with_codes(engineered: DataFrame) -> DataFrame:
    return engineered.select("*", *[c.cast("int").alias(n) for n, c in rule_codes().items()])


def any_of(codes: list[str]) -> Column:
    return F.greatest(*[F.col(c) for c in codes]) if len(codes) > 1 else F.col(codes[0])


def labelled(engineered: DataFrame, min_confidence: float | None = None, source: str = "rules", keep: list[str] = ()) -> DataFrame:
    """The job's identifiers, the features to keep, its labels, confidence, label_source and codes in name order.

    Confidence is the mean weight of the fired codes, 0.5 for a healthy job.
    """
    rows = with_codes(engineered)
    dims = {d: any_of(CODES_OF[d]) for d in DIMENSIONS[:-1]}
    rows = rows.select("*", *[c.alias(d) for d, c in dims.items()])
    rows = rows.withColumn("healthy", (F.greatest(*dims) == 0).cast("int"))
    issues = [c for c in CODES if SEVERITY[c] in WEIGHT]
    fired, weighed = F.expr(" + ".join(CODES)), F.expr(" + ".join(issues))
    weight = F.expr(" + ".join(f"{c} * {WEIGHT[SEVERITY[c]]}" for c in issues))
    rows = rows.withColumn("confidence", F.when(F.col("healthy") == 1, 0.5).otherwise(weight / (10 * F.greatest(weighed, F.lit(1)))))
    out = rows.select(*[c for c in engineered.columns if c.startswith("_")], *keep, *DIMENSIONS, "confidence", F.lit(source).alias("label_source"), fired.alias("n_codes"), *sorted(CODES))
    return out if min_confidence is None else out.filter(F.col("confidence") >= min_confidence)


def label_summary(labels: DataFrame) -> DataFrame:
    """dimension, n, pct over all jobs."""
    row = labels.agg(F.count("*").alias("total"), *[F.sum(d).alias(d) for d in DIMENSIONS])
    return row.unpivot(["total"], DIMENSIONS, "dimension", "n").select("dimension", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def code_rates(labels: DataFrame) -> DataFrame:
    """code, severity, n, rate, most frequent first."""
    row = labels.agg(F.count("*").alias("total"), *[F.sum(c).alias(c) for c in CODES])
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return row.unpivot(["total"], CODES, "code", "n").select("code", severity[F.col("code")].alias("severity"), "n", (F.col("n") / F.col("total")).alias("rate")).orderBy(F.desc("n"), "code")


# The flags of a six-rule set of which any one sets a dimension; other dimensions are never set.
FLAGS_OF = {"access_granularity": ["small_reads", "small_writes"], "metadata_intensity": ["excessive_metadata_access"], "parallelism_efficiency": ["operation_imbalance", "size_imbalance"], "access_pattern": ["random_operations"]}


def from_flags(flags: DataFrame, key: str) -> DataFrame:
    """key and the eight dimensions from a table of rule flags (a boolean column each; missing ones are off)."""
    on = lambda f: F.coalesce(F.col(f), F.lit(False)) if f in flags.columns else F.lit(False)
    dims = {d: F.greatest(*[on(f) for f in FLAGS_OF.get(d, [])], F.lit(False), F.lit(False)) for d in DIMENSIONS[:-1]}
    return flags.select(key, *[c.cast("int").alias(d) for d, c in dims.items()], (~F.greatest(*dims.values())).cast("int").alias("healthy"))


def code_agreement(ours: DataFrame, theirs: DataFrame, compared: DataFrame) -> DataFrame:
    """code, n_both, n_ours, n_theirs, agreement: fired codes (jobid, code) of two tools over the compared jobs (jobid), those
    that were sampled and that both tools know. A job outside that list is no mismatch."""
    fired = lambda codes, mark: codes.select("jobid", "code").distinct().join(compared.select("jobid").distinct(), "jobid", "left_semi").withColumn(mark, F.lit(1))
    both = fired(ours, "a").join(fired(theirs, "b"), ["jobid", "code"], "full_outer")
    n = both.groupBy("code").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_ours"), F.count_if(F.col("a").isNull()).alias("n_theirs"))
    return n.select("*", (F.col("n_both") / (F.col("n_both") + F.col("n_ours") + F.col("n_theirs"))).alias("agreement"))
