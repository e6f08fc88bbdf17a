"""Queries of atomic claims (survey 2.M): recommendations are made from orders, the knowledge base from part."""

from __future__ import annotations

from ioloom.operators import claims, knowledge
from ioloom.plans.core import register

_DIM = "CASE {k} % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(("access_granularity", "metadata_intensity", "parallelism_efficiency", "access_pattern", "interface_choice", "file_strategy", "throughput_utilization", "healthy"))) + " END"
_KB = f"SELECT concat('kb_', p_partkey) AS entry_id, array({_DIM.format(k='p_partkey')}) AS bottleneck_labels, array(named_struct('dimension', {_DIM.format(k='(p_partkey + 1)')}, 'cause', cast(null AS string), 'fix', 'Use collective buffering', 'code_before', 'aaaa', 'code_after', concat('MPI_File_write_all(', p_partkey, ')'))) AS fixes, map('w', 'pwrite') AS io_functions, 'block=4k' AS key_params FROM {{part}}"
_RECS = f"""SELECT o_orderkey AS rec_id, o_orderpriority AS model, {_DIM.format(k='o_orderkey')} AS bottleneck_dimension, CASE o_orderkey % 6 WHEN 1 THEN '' WHEN 2 THEN 'nope' WHEN 3 THEN concat('kb_', o_custkey % 150) WHEN 4 THEN concat('nope, kb_', o_custkey % 150, ' ,kb_x') WHEN 5 THEN concat(' kb_', o_custkey % 150, ',kb_', o_custkey % 150) END AS kb_citation,
CASE o_custkey % 4 WHEN 0 THEN 'Sort the offsets' WHEN 1 THEN 'Collective write_all' WHEN 2 THEN 'bigger Buffer' ELSE 'zzz' END AS explanation, CASE WHEN o_orderkey % 3 = 0 THEN ' a a  a a' WHEN o_orderkey % 3 = 1 THEN 'aaaa' END AS code_before, CASE WHEN o_orderkey % 2 = 0 THEN concat('MPI_File_write_all(', o_custkey % 150, ')') ELSE 'qqqq' END AS code_after,
CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN 'Switch to MPI_File_write_all' WHEN 3 THEN 'use of hdf5 chunk cache layer' ELSE 'the' END AS api_change, CASE o_orderkey % 7 WHEN 1 THEN '2.5x' WHEN 2 THEN 'Up to 16x' WHEN 3 THEN '10-50x' WHEN 4 THEN '3-4 times' WHEN 5 THEN '150X' WHEN 6 THEN 'fast' END AS expected_speedup FROM {{orders}}"""

# Spelled out: the strategies that a recommendation's words show, of which the entry shows buffer and collective; ' a a  a a'
# and 'aaaa' share four of eleven characters in blocks of one, 2 * 4 / (7 + 4).
_CHECKED = f"""c AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderpriority AS model, o_orderkey % 6 AS c, o_orderkey % 6 >= 3 AND o_custkey % 150 IN (SELECT p_partkey FROM part) AS ok, {_DIM.format(k='o_orderkey')} AS dim, {_DIM.format(k='(o_custkey % 150)')} AS kb1, {_DIM.format(k='(o_custkey % 150 + 1)')} AS kb2 FROM orders),
d AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 8.0 / 11 WHEN 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS b4, CAST(k % 2 = 0 AS DOUBLE) AS af, CASE k % 7 WHEN 1 THEN 2.5 WHEN 2 THEN 16.0 WHEN 3 THEN 50.0 WHEN 4 THEN 3.0 WHEN 5 THEN 150.0 END AS speedup0,
  CAST(u % 4 = 1 OR k % 2 = 0 OR k % 5 = 2 AS INT) + CAST(u % 4 = 2 OR k % 5 = 3 AS INT) AS shared, CAST(u % 4 = 0 AS INT) + CAST(u % 4 = 2 AS INT) + CAST(k % 5 = 3 AS INT) AS own,
  CASE dim WHEN 'access_granularity' THEN 100 WHEN 'metadata_intensity' THEN 20 WHEN 'interface_choice' THEN 5 WHEN 'healthy' THEN 2 ELSE 10 END AS bound FROM c),
e AS (SELECT *, CAST(speedup0 AS DOUBLE) AS speedup, CASE WHEN shared + own = 0 THEN 0 ELSE shared / CAST(2 + own AS DOUBLE) END AS score FROM d),
v AS (SELECT k AS rec_id, model, CAST(CASE c WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 0 END AS BIGINT) AS n_cited, CAST(CASE WHEN NOT ok THEN 0 WHEN c = 5 THEN 2 ELSE 1 END AS BIGINT) AS n_valid_cited, c >= 2 AS has_citation, ok AS citation_valid,
  ok AND dim IN (kb1, kb2) AS dimension_match, ok AND score >= 0.3 AS fix_type_match, ok AND (b4 + af) / 2 >= 0.4 AS code_pattern_match, ok AND k % 5 <> 3 AS api_change_match, ok AND coalesce(speedup <= bound, true) AS speedup_plausible,
  CASE WHEN ok THEN round(score, 3) END AS fix_type_score, CASE WHEN ok THEN round(b4, 3) END AS code_before_similarity, CASE WHEN ok THEN af END AS code_after_similarity, CASE WHEN ok THEN speedup END AS speedup_claimed FROM e)"""


def verified(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return claims.verify(spark.sql(_RECS, orders=read("orders")), spark.sql(_KB, part=read("part")))


@register("M12_M13_atomic_claims", f"WITH {_CHECKED} SELECT * FROM v")
def m12(spark, sf_dir):
    return verified(spark, sf_dir).drop("bottleneck_dimension", "primary", "hallucinations")


_WRONG = {"invalid_citation": "NOT citation_valid AND n_cited > 0"} | {t: f"citation_valid AND NOT {c}" for t, c in (("dimension_mismatch", "dimension_match"), ("fix_type_mismatch", "fix_type_match"), ("code_pattern_mismatch", "code_pattern_match"), ("api_change_mismatch", "api_change_match"), ("speedup_implausible", "speedup_plausible"))}


@register("M14_hallucinations", f"WITH {_CHECKED} " + " UNION ALL ".join(f"SELECT model, '{t}' AS type, count(*) AS n FROM v WHERE {c} GROUP BY model" for t, c in _WRONG.items()))
def m14(spark, sf_dir):
    return claims.hallucinations(verified(spark, sf_dir))


_CLAIMS = ("dimension_match", "fix_type_match", "code_pattern_match", "api_change_match", "speedup_plausible")


@register("M15_claims_of_models", f"WITH {_CHECKED} SELECT model, count(*) AS n_recs_total, count(*) FILTER (has_citation) AS n_recs_cited, count(*) FILTER (NOT has_citation) AS n_recs_uncited, round(count(*) FILTER (citation_valid) / CAST(count(*) AS DOUBLE), 4) AS citation_groundedness, " + ", ".join(f"round(count(*) FILTER ({c}) / CAST(greatest(count(*) FILTER (has_citation), 1) AS DOUBLE), 4) AS {c}_rate" for c in _CLAIMS) + f", round(({' + '.join(f'count(*) FILTER ({c})' for c in _CLAIMS)}) / (5.0 * greatest(count(*) FILTER (has_citation), 1)), 4) AS claim_groundedness FROM v GROUP BY model")
def m15_claims(spark, sf_dir):
    return knowledge.claim_statistics(verified(spark, sf_dir))
