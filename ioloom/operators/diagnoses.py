"""Dimensions that free-text diagnoses name: by phrase, by paragraph with negations and cues, and in rule reports.

Patterns are column expressions, one alternation a dimension, so a text is scanned once for each dimension and stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of which any one, in lower case, names a dimension.
PHRASES = {
    "access_granularity": [
        "small read", "small write", "small i/o", "small request", "misalign", "unaligned", "alignment", "request size", "tiny", "granularity", "sub-optimal request", "small-sized", "small io", "fragmented", "size_read_0_100", "size_write_0_100",
        "small data transfer", "inefficient request size", "numerous smaller request", "small and medium", "below 1mb", "below 1 mb", "under 1 mb", "request sizes are small", "many small",
    ],
    "metadata_intensity": ["metadata", "meta-data", "open", "stat", "seek", "high metadata", "excessive metadata", "metadata overhead", "metadata time", "metadata operation", "metadata load", "file creation", "directory", "inode"],
    "parallelism_efficiency": [
        "load imbalance", "imbalance", "single rank", "one rank", "rank 0", "stragglers", "straggler", "uneven distribution", "rank imbalance", "skewed", "hotspot", "server load", "all i/o operations", "only one rank", "single process", "single-rank", "load balancing", "unbalanced",
    ],
    "access_pattern": ["random", "non-sequential", "non-contiguous", "random access", "random read", "random write", "scattered", "non sequential", "stride", "discontinuous", "non-consecutive"],
    "interface_choice": [
        "no collective", "independent i/o", "without mpi", "collective i/o", "low-level", "posix instead", "missing mpi-io", "not using mpi", "mpi-io absent", "direct posix", "bypassing mpi", "without collective", "independent write", "independent read",
        "individual i/o", "lack of collective", "multi-process without mpi", "not leveraging", "could benefit from mpi",
    ],
    "file_strategy": ["shared file", "file-per-process", "single shared", "shared-file", "all processes writing to same", "contention", "lock contention", "file sharing", "many files", "too many files", "excessive files", "single file", "common file"],
    "throughput_utilization": ["low throughput", "bandwidth", "underutiliz", "low bandwidth", "poor throughput", "slow i/o", "throughput", "transfer rate", "sustained", "peak performance", "bottleneck", "write time", "read time", "i/o time"],
}
# What negates a paragraph, what affirms one, and what in a paragraph names a dimension.
NEGATIONS = [
    r"no\s+(significant|major|critical|notable|apparent|clear)\s+(issue|problem|concern|bottleneck)", r"not\s+(a|an)\s+(significant|major|critical)\s+(issue|concern|bottleneck)", r"negligible|minimal\s+impact|unlikely\s+to\s+be|not\s+a\s+widespread|ineffective",
    r"no\s+issue|no\s+problems?\s+detected|no\s+concerns?", r"does\s+not\s+(appear|seem)\s+to\s+be\s+(a|an)\s+(issue|problem)",
]
CUES = ["significant", "issue", "concern", "impact", "problem", "bottleneck", "degradation", "inefficien", "hindering", "overhead"]
PARAGRAPHS = {
    "access_granularity": [r"small\s+(i/o|io|read|write)", r"misalign"],
    "access_pattern": [r"random\s+(i/o|io|access|read|write)", r"non.?sequential"],
    "interface_choice": [r"non.?collective", r"collective\s+i/o", r"low.?level\s+library", r"without\s+mpi", r"no\s+collective", r"posix\s+instead"],
    "parallelism_efficiency": [r"load\s+imbalanc", r"server\s+load", r"rank\s+load", r"imbalance"],
    "metadata_intensity": [r"metadata\s+(i/o|io|load|overhead|time|operations?)", r"high\s+metadata"],
    "file_strategy": [r"shared\s+file", r"file.?per.?process", r"contention", r"lock\s+contention"],
    "throughput_utilization": [r"low\s+throughput", r"bandwidth", r"underutiliz", r"low\s+bandwidth", r"peak\s+performance"],
}
# What a rule report says of a dimension.
REPORTS = {
    "access_granularity": [r"small\s+(read|write)\s+requests", r"misaligned\s+file\s+requests", r"misaligned\s+memory"],
    "parallelism_efficiency": [r"load\s+imbalance.*detected", r"data\s+sieving"],
    "interface_choice": [r"does\s+not\s+use\s+collective\s+(read|write)", r"no\s+collective"],
    "file_strategy": [r"small\s+(read|write)\s+requests\s+to\s+a\s+shared\s+file", r"shared\s+file.*contention"],
    "metadata_intensity": [r"high\s+metadata", r"metadata.*time.*high"],
    "access_pattern": [r"random\s+(read|write)\s+operations", r"random\s+access"],
    "throughput_utilization": [r"redundant\s+(read|write)\s+traffic"],
}
#: Characters that a paragraph has at least, and what parts paragraphs: a blank line, or a line that begins with a capital.
LEAST, BETWEEN = 20, r"\n\s*\n|\n(?=[A-Z])"


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def telling(phrases: list[str]) -> list[str]:
    """The phrases that hold no other one: where a longer one occurs, a shorter one does."""
    return [p for p in phrases if not any(q != p and q in p for q in phrases)]


def matched_dims(low: Column, patterns: dict[str, list[str]]) -> Column:
    """The dimensions of which any pattern is found, in their order."""
    return F.array_compact(F.array(*[F.when(low.rlike(alternation(ps)), F.lit(d)) for d, ps in patterns.items()]))


def phrase_dims(text: Column) -> Column:
    """The dimensions of which the text has any phrase; a null text has none."""
    return matched_dims(F.lower(F.coalesce(text, F.lit(""))), {d: [re.escape(p) for p in telling(ps)] for d, ps in PHRASES.items()})


def report_dims(text: Column) -> Column:
    """The dimensions that a rule report names, anywhere in its text."""
    return matched_dims(F.lower(F.coalesce(text, F.lit(""))), REPORTS)


def paragraph_dims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, dims (sorted) of the dimensions that affirmed paragraphs name: a paragraph needs LEAST characters and a cue; a negated
    one without a cue is passed over. Texts that name none have an empty array."""
    p = texts.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), BETWEEN)).alias("p")).filter(F.length(F.trim("p", F.lit(" \t\n\r\x0b\x0c"))) >= LEAST)
    affirmed, negated = F.col("p").rlike("(?i)" + alternation(CUES)), F.col("p").rlike("(?i)" + alternation(NEGATIONS))
    named = p.filter((~negated | affirmed) & affirmed).select(key, F.explode(matched_dims(F.lower("p"), PARAGRAPHS)).alias("dim"))
    found = named.groupBy(key).agg(F.array_sort(F.collect_set("dim")).alias("dims"))
    return texts.select(key).distinct().join(found, key, "left").select(key, F.coalesce("dims", F.expr("cast(array() as array<string>)")).alias("dims"))
