"""Records to jobs: one grouping with a merge rule for each counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ioloom.functions.counters import ALL_COUNTERS, MODULE_OF, MODULES, TOP4, rule_of, top4_columns


# Expressions are SQL text: a plan of 136 counters is parsed at once instead of being built call by call.


def _shared(module: str) -> str:
    """One distinct file only among the module's records: its least and greatest id agree."""
    file_id = f"CASE WHEN module = '{module}' THEN file_id END"
    return f"coalesce(min({file_id}) = max({file_id}), false)"


def _last(c: str) -> str:
    return f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN record_seq END)"


def merged(c: str) -> str:
    """The aggregate that merges counter c over a job's records."""
    rule, shared = rule_of(c), _shared(MODULE_OF[c])
    if rule == "sum_clamp":
        return f"CASE WHEN max({c} = -1) THEN -1 ELSE sum({c}) END"
    if rule == "argmax":
        time = c.replace("MAX_", "F_MAX_").replace("_TIME_SIZE", "_TIME")
        return f"max_by({c}, CASE WHEN {time} IS NOT NULL THEN struct({time}, -record_seq) END)"
    return {
        "sum": f"sum({c})",
        "max": f"max({c})",
        "min_nonzero": f"coalesce(min(CASE WHEN {c} > 0 THEN {c} END), 0D)",
        "last": _last(c),
        "shared_last": f"CASE WHEN {shared} THEN {_last(c)} ELSE -1 END",
        "shared_min": f"CASE WHEN {shared} THEN min({c}) ELSE 0D END",
        "shared_max": f"CASE WHEN {shared} THEN max({c}) ELSE 0D END",
        "zero": "0D",
    }[rule]


def top4_merge(records: DataFrame, groups: list[str], key: str = "jobid") -> DataFrame:
    """One row per job with each group's four most counted values: counts of equal values are added,
    ordered by count, then by value, both descending; unused places are 0."""
    pairs = ", ".join(f"named_struct('grp', '{g}', 'value', {v}, 'n', {n})" for g in groups for v, n in top4_columns(g))
    counted = records.selectExpr(key, f"explode(array({pairs})) AS x").filter("x.n > 0").groupBy(key, "x.grp", "x.value").agg(F.sum("x.n").alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "grp").orderBy(F.desc("n"), F.desc("value")))
    best = counted.withColumn("place", place).filter("place <= 4")
    picks = [F.expr(f"coalesce(max({c}) FILTER (WHERE grp = '{g}' AND place = {i}), 0) AS {name}") for g in groups for i, pair in enumerate(top4_columns(g), 1) for name, c in zip(pair, ("value", "n"), strict=True)]
    return best.groupBy(key).agg(*picks)


def aggregate_records(records: DataFrame, counters: list[str] | None = None, key: str = "jobid") -> DataFrame:
    """One row per job: its counters merged, shared_<module> flags, num_files, n_records, modules (sorted).

    Every merge is a sum of partial ones, so a job of very many records is merged where they lie before its shuffle.
    """
    chosen = [c for c in (counters or ALL_COUNTERS) if c in records.columns]
    groups = [g for g in TOP4 if any(c in chosen for pair in top4_columns(g) for c in pair)]
    plain, peaks = [c for c in chosen if rule_of(c) not in ("top4", "argmax")], [c for c in chosen if rule_of(c) == "argmax"]
    flags = [F.expr(f"{_shared(m)} AS shared_{m.replace('-', '').lower()}") for m in MODULES]
    out = records.groupBy(key).agg(*[F.expr(f"{merged(c)} AS {c}") for c in plain], *flags, F.count("*").alias("n_records"))
    # Apart, so that the wide grouping has neither distinct phases nor a set in its buffer.
    out = out.join(records.groupBy(key).agg(F.countDistinct("file_id").alias("num_files"), F.array_sort(F.collect_set("module")).alias("modules")), key)
    if peaks:  # their buffers hold structs, with which no grouping is hashed: beside the others these would all be sorted and interpreted
        out = out.join(records.groupBy(key).agg(*[F.expr(f"{merged(c)} AS {c}") for c in peaks]), key)
    if groups:
        places = top4_merge(records, groups, key)
        out = out.join(places, key, "left").fillna(0, [c for c in places.columns if c != key])
    return out.select(key, *chosen, *[c for c in out.columns if c not in chosen and c != key and rule_of_place(c)])


def rule_of_place(c: str) -> bool:
    """Columns that aren't places of a top-4 group that wasn't asked for."""
    return not c[0].isupper()


def merge_ranks(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per-rank logs of a job as one: rank from the order of its logs, processes counted, times spanned.

    records: jobid, path, module, file_id, record_seq and counters; jobs: jobid, path, start_time, end_time.
    Zero times are unset. All merge rules then hold over the union.
    """
    ranked = records.withColumn("rank", F.dense_rank().over(Window.partitionBy("jobid").orderBy("path")) - 1)
    head = jobs.groupBy("jobid").agg(F.countDistinct("path").alias("nprocs"), F.min(F.when(F.col("start_time") > 0, F.col("start_time"))).alias("start_time"), F.max(F.when(F.col("end_time") > 0, F.col("end_time"))).alias("end_time"))
    head = head.withColumn("runtime", (F.coalesce("end_time", F.lit(0)) - F.coalesce("start_time", F.lit(0))).cast("double"))
    seq = F.row_number().over(Window.partitionBy("jobid").orderBy("path", "record_seq"))
    return aggregate_records(ranked.withColumn("record_seq", seq)).join(head, "jobid")
