"""Atomic claims of recommendations, checked against the knowledge-base entries that they cite.

A recommendation is judged by the first entry that it cites and that exists. Entries are looked up by equi joins; the
checks of words, numbers and dimensions are column expressions, those of an entry alone once for each that is cited. Only the
similarity of two snippets needs Python: it is measured in Arrow batches where the rows lie, as what matching blocks share of both lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that show a repair strategy, phrases that claim no change of interface, words without meaning, and how large a speedup of a dimension may be.
STRATEGIES = {
    "buffer": ["buffer", "aggregat", "batch", "chunk", "coalesce", "big_buf", "memcpy", "flush"],
    "collective": ["collective", "mpi_file_write_all", "mpi_file_read_all", "write_all", "read_all"],
    "sequential": ["sort", "sequential", "qsort", "reorder", "offset"],
    "alignment": ["align", "alignment", "aligned", "block boundary"],
    "striping": ["stripe", "lustre", "ost", "lfs setstripe"],
    "reduce_metadata": ["stat", "metadata", "open", "close", "cache", "batch open", "reduce open"],
    "direct_io": ["direct", "o_direct"],
    "larger_transfer": ["larger", "increase", "transfer size", "1mb", "1048576", "bigger"],
    "shared_file": ["shared file", "single file", "mpi-io", "mpiio"],
    "file_per_proc": ["file-per-proc", "fpp", "file per proc"],
    "fsync_reduce": ["fsync", "sync", "reduce sync"],
    "random_to_seq": ["random", "sequential", "sort offset", "qsort"],
}
NO_CHANGE = ["no api change", "same api", "none", "no change", "remains posix", "remains mpi", "no api", "not required", "same posix", "different usage pattern", "buffering strategy", "usage pattern", "write buffering", "write aggregation"]
STOP_WORDS = ["the", "a", "an", "to", "from", "with", "for", "in", "of", "and", "or", "is", "are", "was", "be", "as", "at", "by", "this", "that", "it", "on", "no", "not"]
BOUNDS = {"access_granularity": 100.0, "access_pattern": 10.0, "metadata_intensity": 20.0, "parallelism_efficiency": 10.0, "interface_choice": 5.0, "file_strategy": 10.0, "throughput_utilization": 10.0, "healthy": 2.0}
#: Places over which recommendations without an entry are spread.
SPREAD = 4096
OTHER_BOUND, STRATEGY_SHARE, CODE_SHARE, WORD_SHARE = 20.0, 0.3, 0.4, 0.3


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(*[text.contains(w) for w in words], F.lit(False))


def strategies(low: Column) -> Column:
    """The strategies that a lower-cased text shows, in their order. The text is bound to a name, or it would be made anew for each word."""
    return F.get(F.transform(F.array(low), lambda t: F.array_compact(F.array(*[F.when(_any(t, words), F.lit(s)) for s, words in STRATEGIES.items()]))), F.lit(0))


def cited_ids(citation: Column) -> Column:
    """The ids of a comma-separated citation."""
    return F.filter(F.transform(F.split(F.coalesce(citation, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def speedups(text: Column) -> Column:
    """The numbers before an x, or without any the numbers that begin a range."""
    t = F.coalesce(text, F.lit(""))
    times = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)\s*(?:x|X)"), 1)
    spans = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)\s*-\s*\d"), 1)
    return F.transform(F.when(F.size(times) > 0, times).otherwise(spans), lambda n: n.cast("double"))


def words(low: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\b\w+\b"), 0)), F.array(*map(F.lit, STOP_WORDS)))


def snippet_similarity(a: str, b: str) -> float:
    """2 M / T of two texts with white space evened: M characters in matching blocks, T in both."""
    a, b = " ".join(a.split()), " ".join(b.split())
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _compared(batches):
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([snippet_similarity(a, b) for a, b in pairs], pa.float64())], names=["a", "b", "similarity"])


def similarities(pairs: DataFrame) -> DataFrame:
    """a, b, similarity of the distinct pairs (a, b) of non-empty texts."""
    return pairs.filter("a <> '' and b <> ''").distinct().mapInArrow(_compared, "a string, b string, similarity double")


#: Pairs whose similarity a worker keeps.
PAIRS = 50_000
_cached_similarity = lru_cache(PAIRS)(snippet_similarity)


def _nearest(batches):
    """The greatest similarity of a text with those of a list, 0 without any."""
    for texts, lists in batches:
        yield pa.array([max((_cached_similarity(a or "", b or "") for b in bs or []), default=0.0) for a, bs in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.float64())


def nearest(text: Column, others: Column) -> Column:
    """The greatest similarity of a text with those of an array of texts. Rows stay where they are; equal pairs are measured once in a worker."""

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _nearest(batches)

    return F.arrow_udf(of, "double")(text, others)


def first_valid(recs: DataFrame, kb: DataFrame) -> DataFrame:
    """rec_id, n_cited, n_valid_cited, primary: the first cited entry that exists (null if none), of the recommendations that cite any."""
    cited = recs.select("rec_id", F.posexplode(cited_ids(F.col("kb_citation"))).alias("pos", "entry_id"))
    known = cited.join(kb.select("entry_id").distinct().withColumn("there", F.lit(True)), "entry_id", "left")
    found = known.groupBy("rec_id").agg(F.count("*").alias("n_cited"), F.count("there").alias("n_valid_cited"), F.min_by("entry_id", F.when(F.col("there"), F.col("pos"))).alias("primary"))
    return found.withColumn("primary", F.when(F.col("n_valid_cited") > 0, F.col("primary")))


def verify(recs: DataFrame, kb: DataFrame) -> DataFrame:
    """The claims of each recommendation as booleans, their figures, and hallucinations: an array of type and detail.

    recs: rec_id, model, bottleneck_dimension, kb_citation, explanation, code_before, code_after, api_change, expected_speedup;
    kb: entry_id (unique), bottleneck_labels, fixes (array of dimension, cause, fix, code_before, code_after), io_functions (a
    map), key_params. Missing texts are empty. Without a valid citation no claim holds.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    empty = lambda x: F.coalesce(x, F.lit(""))
    said = ["bottleneck_dimension", "kb_citation", "explanation", "code_before", "code_after", "api_change", "expected_speedup"]
    # Only entries that are cited take part; what is known of an entry alone is found once for it.
    cited = recs.select(F.explode(cited_ids(F.col("kb_citation"))).alias("entry_id")).distinct()
    kb = kb.join(cited, "entry_id", "left_semi")
    fix_text = lambda f: F.lower(F.concat_ws(" ", empty(f["fix"]), empty(f["cause"]), empty(f["code_after"])))
    entries = kb.select(F.col("entry_id").alias("primary"), F.coalesce("bottleneck_labels", F.array()).alias("labels"), F.coalesce("fixes", F.expr("cast(array() as " + kb.schema["fixes"].dataType.simpleString() + ")")).alias("fixes"), "io_functions", text("key_params").alias("key_params"))
    fix_words = F.transform("fixes", lambda f: F.concat_ws(" ", empty(f["fix"]), empty(f["code_after"]), empty(f["code_before"])))
    kb_words = words(F.lower(F.concat_ws(" ", F.array_join(F.map_values(F.coalesce("io_functions", F.create_map().cast("map<string,string>"))), " "), "key_params", F.array_join(fix_words, " "))))
    known = entries.select("primary", "labels", F.size("fixes").alias("n_fixes"), F.transform("fixes", lambda f: empty(f["dimension"])).alias("fix_dims"), F.transform("fixes", lambda f: empty(f["code_before"])).alias("befores"), F.transform("fixes", lambda f: empty(f["code_after"])).alias("afters"),
        F.transform("fixes", lambda f: F.struct(fix_text(f).alias("text"), strategies(fix_text(f)).alias("shows"))).alias("shown"), kb_words.alias("kb_words"))

    # Most recommendations may lack an entry: their null keys are spread, or one task would hold them all.
    # (An entry's is 0, but not as a constant, for which the optimizer would drop the key.)
    spread = F.when(F.col("primary").isNull(), F.pmod(F.xxhash64("rec_id"), F.lit(SPREAD))).otherwise(F.lit(0).cast("bigint"))
    # What is known of a recommendation alone is found below the joins, above which expressions would be inlined and repeated.
    rows = recs.select("rec_id", "model", *[text(c).alias(c) for c in said])
    rows = rows.withColumn("_text", F.lower(F.concat_ws(" ", "explanation", "code_after", "api_change")))
    rows = rows.select("*", strategies(F.col("_text")).alias("_own"), words(F.lower("api_change")).alias("_api"), F.array_max(speedups(F.col("expected_speedup"))).alias("speedup_claimed")).drop("explanation", "expected_speedup").join(first_valid(recs, kb), "rec_id", "left").fillna(0, ["n_cited", "n_valid_cited"])
    rows = rows.withColumn("_spread", spread).join(known.withColumn("_spread", F.pmod(F.length("primary"), F.lit(1)).cast("bigint")), ["primary", "_spread"], "left")

    # The best similarity of each snippet with those of the entry's fixes; texts are compared where neither shows a strategy.
    plain = F.when(F.size("_own") == 0, F.transform(F.filter("shown", lambda f: F.size(f["shows"]) == 0), lambda f: f["text"]))
    low = F.lower("api_change")
    rows = rows.select("*", nearest(F.col("code_before"), F.col("befores")).alias("before"), nearest(F.col("code_after"), F.col("afters")).alias("after"), nearest(F.col("_text"), plain).alias("text"))
    shared = F.transform("shown", lambda f: F.when((F.size("_own") > 0) & (F.size(f["shows"]) > 0), F.size(F.array_intersect("_own", f["shows"])) / F.size(F.array_union("_own", f["shows"]))).otherwise(0.0))
    rows = rows.withColumn("fix_type_score", F.greatest(F.coalesce(F.array_max(shared), F.lit(0.0)), F.col("text")))
    rows = rows.withColumn("api_overlap", F.when(F.size("_api") > 0, F.size(F.array_intersect("_api", "kb_words")) / F.size("_api")))
    bound = F.coalesce(*[F.when(F.col("bottleneck_dimension") == d, F.lit(x)) for d, x in BOUNDS.items()], F.lit(OTHER_BOUND))

    valid = F.col("primary").isNotNull()
    checks = {
        "dimension_match": F.array_contains(F.concat("labels", "fix_dims"), F.col("bottleneck_dimension")),
        "fix_type_match": F.col("fix_type_score") >= STRATEGY_SHARE,
        "code_pattern_match": (F.col("n_fixes") > 0) & ((F.col("before") + F.col("after")) / 2 >= CODE_SHARE),
        "api_change_match": (F.col("api_change") == "") | _any(low, NO_CHANGE) | F.col("api_overlap").isNull() | (F.col("api_overlap") >= WORD_SHARE),
        "speedup_plausible": F.col("speedup_claimed").isNull() | (F.col("speedup_claimed") <= bound),
    }
    rows = rows.select("*", (F.trim("kb_citation") != "").alias("has_citation"), valid.alias("citation_valid"), *[F.coalesce(valid & c, F.lit(False)).alias(n) for n, c in checks.items()])
    detail = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("detail"))
    wrong = lambda name, told: F.when(valid & ~F.col(name), told)
    found = F.array_compact(F.array(
        F.when(~valid & (F.col("n_cited") > 0), detail("invalid_citation", "cited: ", F.col("kb_citation"))),
        wrong("dimension_match", detail("dimension_mismatch", F.col("bottleneck_dimension"), " is not among ", F.array_join("labels", ","))),
        wrong("fix_type_match", detail("fix_type_mismatch", "strategy similarity ", F.round("fix_type_score", 3))),
        wrong("code_pattern_match", detail("code_pattern_mismatch", "before ", F.round("before", 3), ", after ", F.round("after", 3))),
        wrong("api_change_match", detail("api_change_mismatch", "word overlap ", F.round("api_overlap", 2))),
        wrong("speedup_plausible", detail("speedup_implausible", "claimed ", F.col("speedup_claimed"))),
    ))
    figures = [F.when(valid, F.round(c, 3)).alias(n) for n, c in (("fix_type_score", F.col("fix_type_score")), ("code_before_similarity", F.col("before")), ("code_after_similarity", F.col("after")))]
    return rows.select("rec_id", "model", "bottleneck_dimension", "n_cited", "n_valid_cited", "primary", "has_citation", "citation_valid", *checks, *figures, F.when(valid, F.col("speedup_claimed")).alias("speedup_claimed"), found.alias("hallucinations"))


def hallucinations(verified: DataFrame) -> DataFrame:
    """model, type, n of the claims that don't hold, most frequent first within a model."""
    return verified.select("model", F.explode("hallucinations").alias("h")).groupBy("model", F.col("h.type").alias("type")).agg(F.count("*").alias("n"))
