"""Queries of text diagnoses, the knowledge base, retrieval and whole diagnoses (survey 2.M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ioloom.functions.counters import DIMENSIONS
from ioloom.operators import diagnoses, retrieval, rules
from ioloom.plans import sql
from ioloom.plans.core import register
from ioloom.plans.stages import engineered, engineered_whole
from ioloom.sources.scratch import scratch_path

_SEVEN = ["access_granularity", "metadata_intensity", "parallelism_efficiency", "access_pattern", "interface_choice", "file_strategy", "throughput_utilization"]
# Texts and the dimensions that they name, sorted by name: G, M, P, A, I, S, T stand for the seven above.
_OF = dict(zip("GMPAIST", _SEVEN, strict=True))
_PHRASED = [("Many SMALL requests", "G"), ("the rank 0 opens it", "MP"), ("a random stride", "A"), ("It could benefit from MPI", "I"), ("lock contention on a shared file", "S"), ("slow I/O", "T"), ("all is well", ""), ("Directory of tiny ones", "GM"), (None, ""), ("bottleneck of independent writes", "IT"), ("size_read_0_100 is high", "G")]
_PARAGRAPHED = [
    ("There is no significant issue with small reads here", "G"), ("Random access is negligible for this run", ""), ("Small reads\n\nHigh metadata overhead", "M"), ("Load imbalance is a concern\nRandom reads are a problem here", "AP"), ("the shared file shows\nlower bandwidth problems", "ST"),
    ("Collective I/O would help this code", ""), (None, ""), ("A problem.\n \nNon-collective calls are a concern", "I"), ("Random x problem\n\n  misaligned  \n", ""), ("There is no issue.\nHigh metadata load is not a widespread one", ""),
]
_REPORTED = [("Application issues a high number of SMALL READ requests to a shared file", "GS"), ("Load imbalance of 30% detected", "P"), ("Application does not use collective WRITE operations", "I"), ("redundant READ traffic; data sieving", "PT"), ("metadata calls took long, time is high", "M"), ("random write operations", "A"), ("fine", ""), (None, ""), ("shared file\ncontention", "")]


def _told(cases) -> str:
    """SQL for the dimensions of order k's text."""
    names = lambda marks: ",".join(sorted(_OF[m] for m in marks))
    return f"CASE o_orderkey % {len(cases)} " + " ".join(f"WHEN {i} THEN '{names(marks)}'" for i, (_, marks) in enumerate(cases)) + " END"


def _texts(spark, sf_dir, cases):
    said = F.element_at(F.array(*[F.lit(t).cast("string") for t, _ in cases]), (F.col("o_orderkey") % len(cases) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), said.alias("t"))


_listed = lambda c: F.array_join(F.array_sort(c), ",")


@register("M18_phrase_dims", f"SELECT o_orderkey AS k, {_told(_PHRASED)} AS dims FROM orders")
def m18(spark, sf_dir):
    return _texts(spark, sf_dir, _PHRASED).select("k", _listed(diagnoses.phrase_dims(F.col("t"))).alias("dims"))


@register("M19_paragraph_dims", f"SELECT o_orderkey AS k, {_told(_PARAGRAPHED)} AS dims FROM orders")
def m19(spark, sf_dir):
    return diagnoses.paragraph_dims(_texts(spark, sf_dir, _PARAGRAPHED), "k", "t").select("k", _listed("dims").alias("dims"))


@register("M20_report_dims", f"SELECT o_orderkey AS k, {_told(_REPORTED)} AS dims FROM orders")
def m20(spark, sf_dir):
    return _texts(spark, sf_dir, _REPORTED).select("k", _listed(diagnoses.report_dims(F.col("t"))).alias("dims"))


# ---- the knowledge base and what is found in it

_KEYS = "nprocs runtime_seconds POSIX_BYTES_WRITTEN POSIX_BYTES_READ POSIX_WRITES POSIX_READS POSIX_SEQ_WRITES POSIX_SEQ_READS POSIX_FSYNCS POSIX_OPENS POSIX_F_META_TIME MPIIO_COLL_WRITES MPIIO_INDEP_WRITES avg_write_size avg_read_size small_io_ratio seq_write_ratio metadata_time_ratio collective_ratio total_bw_mb_s fsync_ratio".split()
_ROUNDED = ", ".join(f"floor({c} * 10000 + 0.5) / 10000 AS {c}" for c in _KEYS)
_FIXES = [(d, f"fix of {d}") for d in _SEVEN]


def _kb(spark, sf_dir):
    rows = rules.labelled(engineered(spark, sf_dir), keep=[c for c in retrieval.SIGNATURE if not c.startswith("_")])
    rows = rows.withColumns({"benchmark": F.col("_benchmark"), "scenario": F.concat(F.lit("s"), F.col("_jobid") % 3), "idx": F.col("_jobid").cast("bigint")})
    return retrieval.knowledge_base(rows, spark.createDataFrame(_FIXES, "dimension string, fix string"), DIMENSIONS, retrieval.SIGNATURE)


_ON = "concat_ws(',', " + ", ".join(f"CASE WHEN {d} = 1 THEN '{d}' END" for d in DIMENSIONS) + ")"
_FIXED = "concat_ws(',', " + ", ".join(f"CASE WHEN {d} = 1 THEN 'fix of {d}' END" for d in _SEVEN) + ")"


@register("M1_knowledge_base", f"WITH {sql.LABELS} SELECT _benchmark || '_s' || (_jobid % 3) || '_' || _jobid AS entry_id, {_ON} AS dims, {_FIXED} AS fixes, {_ROUNDED} FROM labels_")
def m1(spark, sf_dir):
    return _kb(spark, sf_dir).select("entry_id", F.array_join("dims", ",").alias("dims"), F.array_join(F.transform("fixes", lambda f: f["fix"]), ",").alias("fixes"), *[F.col("signature")[c].alias(c) for c in _KEYS])


@register("M2_exported_entries", f"WITH {sql.LABELS} " + " UNION ALL ".join(f"SELECT '{d}' AS dim, count(*) AS n, min(_benchmark || '_s' || (_jobid % 3) || '_' || _jobid) AS first, CAST(sum(floor(nprocs * 10000 + 0.5) / 10000) AS DOUBLE) AS nprocs FROM labels_ WHERE {d} = 1 HAVING count(*) > 0" for d in DIMENSIONS))
def m2(spark, sf_dir):
    path = scratch_path(spark, "kb")
    retrieval.export(_kb(spark, sf_dir), path)
    read = spark.read.schema("entry_id string, dims array<string>, signature struct<nprocs:double>, dim string").json(f"{path}/by_dim")
    return read.groupBy("dim").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"), F.sum("signature.nprocs").alias("nprocs"))


_SIG = ["read_ratio", "small_io_ratio", "seq_read_ratio", "metadata_time_ratio"]
_SIM = " + ".join(f"CASE WHEN a.{c} <> 0 OR b.{c} <> 0 THEN least(abs(a.{c}), abs(b.{c})) / greatest(abs(a.{c}), abs(b.{c}), 1e-9) ELSE 0 END" for c in _SIG)
_NK = " + ".join(f"CAST(a.{c} <> 0 OR b.{c} <> 0 AS INT)" for c in _SIG)
_SHARE = " + ".join(f"a.{d} * b.{d}" for d in DIMENSIONS)
_FOUND = f"""{sql.LABELS}, s AS MATERIALIZED (SELECT _jobid, {', '.join(DIMENSIONS)}, {', '.join(f'floor({c} * 10000 + 0.5) / 10000 AS {c}' for c in _SIG)} FROM labels_),
p AS (SELECT a._jobid AS job_id, b._jobid AS entry_id, {_SHARE} AS matched, floor(coalesce(({_SIM}) / nullif({_NK}, 0), 0) * 10000 + 0.5) / 10000 AS similarity FROM s a, s b WHERE a._jobid % 100 = 0 AND {_SHARE} > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY matched DESC, similarity DESC, entry_id) AS place FROM p), f AS (SELECT * FROM o WHERE place <= 3)"""


def _asked(spark, sf_dir):
    """Every job as an entry of the knowledge base, and those whose id is divisible by 100 as questions."""
    signature = F.map_from_arrays(F.array(*map(F.lit, _SIG)), F.array(*[F.floor(F.col(c) * 10000 + 0.5) / 10000 for c in _SIG])).alias("signature")
    rows = rules.labelled(engineered_whole(spark, sf_dir), keep=_SIG)
    path = scratch_path(spark, "signatures")
    rows.select(F.col("_jobid").cast("bigint").alias("job_id"), F.array_compact(F.array(*[F.when(F.col(d) == 1, F.lit(d)) for d in DIMENSIONS])).alias("dims"), signature).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.filter("job_id % 100 = 0"), rows.select(F.col("job_id").alias("entry_id"), "dims", "signature", F.col("job_id").alias("ordinal"))


@register("M4_M6_retrieval", f"WITH {_FOUND} SELECT job_id, place, entry_id, matched, similarity FROM f")
def m4(spark, sf_dir):
    asked, kb = _asked(spark, sf_dir)
    found = retrieval.retrieve(asked, kb, DIMENSIONS, _SIG)
    return found.select("job_id", F.posexplode("evidence").alias("p", "e")).select("job_id", (F.col("p") + 1).alias("place"), "e.entry_id", "e.matched", "e.similarity")


_CITED = " ".join(f"|| CASE WHEN {d} = 1 THEN '{d}:fix of {d}:' || coalesce((SELECT string_agg(entry_id, ' ' ORDER BY place) FROM f JOIN s e ON e._jobid = f.entry_id WHERE f.job_id = j._jobid AND e.{d} = 1), '') || ';' ELSE '' END" for d in _SEVEN)


@register("M22_diagnoses", f"WITH {_FOUND} SELECT _jobid AS job_id, CASE WHEN {' + '.join(_SEVEN)} > 0 THEN 'bottlenecks' ELSE 'healthy' END AS status, (SELECT string_agg(entry_id, ' ' ORDER BY place) FROM f WHERE f.job_id = j._jobid) AS evidence, '' {_CITED} AS recommendations FROM s j WHERE _jobid % 100 = 0")
def m22(spark, sf_dir):
    asked, kb = _asked(spark, sf_dir)
    out = retrieval.diagnose(asked, kb, spark.createDataFrame(_FIXES, "dimension string, fix string"), DIMENSIONS, _SIG)
    told = F.transform("recommendations", lambda r: F.concat(r["dimension"], F.lit(":"), r["fix"], F.lit(":"), F.array_join(r["citations"], " "), F.lit(";")))
    return out.select("job_id", "status", F.array_join(F.transform("evidence", lambda e: e["entry_id"].cast("string")), " ").alias("evidence"), F.array_join(told, "").alias("recommendations"))
