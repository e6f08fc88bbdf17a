"""Atomic claims on hand-made recommendations, and snippet similarity against plain sequence matching."""

import random
from difflib import SequenceMatcher

from ioloom.operators import claims

REC = "rec_id int, model string, bottleneck_dimension string, kb_citation string, explanation string, code_before string, code_after string, api_change string, expected_speedup string"
KB = "entry_id string, bottleneck_labels array<string>, fixes array<struct<dimension:string,cause:string,fix:string,code_before:string,code_after:string>>, io_functions map<string,string>, key_params string"


def test_claims_of_hand_made_recommendations(spark):
    kb = spark.createDataFrame([("a", ["metadata_intensity"], [("file_strategy", None, "cache the Stat calls", "for f: open(f)", "open once"), (None, None, None, None, None)], {"o": "H5Dwrite"}, None), ("b", None, [], None, None), ("c", ["healthy"], [("healthy", "q", "qq", "", "")], {}, "x")], KB)
    rows = [
        (1, "m", "file_strategy", "zz, a", "cache metadata", "for  f:\nopen(f)", "", "H5DWRITE now", "2-3x"),
        (2, "m", "healthy", "a", "xyz", None, None, "rewrite everything twice", "2.1x"),
        (3, "m", "healthy", "b", None, None, None, None, None),
        (4, "m", None, None, None, None, None, None, None),
        (5, "m", "healthy", " , ", "", "", "", "", "9x"),
        (6, "m", "healthy", "nope", "", "", "", "", "9x"),
        (7, "m", "healthy", "c,a", "qq", "", "", "qq q", "9x"),
    ]
    got = {r.rec_id: r for r in claims.verify(spark.createDataFrame(rows, REC), kb).collect()}
    held = lambda i: [got[i][c] for c in ("dimension_match", "fix_type_match", "code_pattern_match", "api_change_match", "speedup_plausible")]
    types = lambda i: [h.type for h in got[i].hallucinations]
    assert len(got) == 7 and held(1) == [True, True, True, True, True] and (got[1].n_cited, got[1].n_valid_cited, got[1].primary) == (2, 1, "a")
    assert got[1].code_before_similarity == 1.0 and got[1].speedup_claimed == 3.0
    assert held(2) == [False] * 5 and types(2) == ["dimension_mismatch", "fix_type_mismatch", "code_pattern_mismatch", "api_change_mismatch", "speedup_implausible"]
    assert held(3) == [False, False, False, True, True] and types(3) == ["dimension_mismatch", "fix_type_mismatch", "code_pattern_mismatch"]
    assert held(4) == held(5) == held(6) == [False] * 5 and types(4) == types(5) == [] and types(6) == ["invalid_citation"]
    assert not got[4].has_citation and got[5].has_citation and not got[5].citation_valid
    # Neither side shows a strategy: the texts themselves are compared.
    assert got[7].fix_type_score == round(SequenceMatcher(None, "qq qq q", "qq q").ratio(), 3) and held(7)[3]


def test_snippet_similarity_evens_white_space(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 300))), "".join(rng.choice("ab\t ") for _ in range(rng.randint(0, 300)))) for _ in range(60)]
    got = {(r.a, r.b): r.similarity for r in claims.similarities(spark.createDataFrame(pairs * 2, "a string, b string")).collect()}
    plain = lambda a, b: SequenceMatcher(None, " ".join(a.split()), " ".join(b.split())).ratio() if a.split() and b.split() else 0.0
    assert got == {(a, b): plain(a, b) for a, b in pairs if a and b}


def test_numbers_and_ids(spark):
    df = spark.createDataFrame([("10-50x",), ("Up to 2.5 X",), ("3-4 times",), ("fast",), (None,)], "t string")
    assert [list(r[0]) for r in df.select(claims.speedups(claims.F.col("t"))).collect()] == [[50.0], [2.5], [3.0], [], []]
    df = spark.createDataFrame([("a, b,,",), (None,), ("",)], "t string")
    assert [list(r[0]) for r in df.select(claims.cited_ids(claims.F.col("t"))).collect()] == [["a", "b"], [], []]


def test_uncited_recommendations_are_spread_and_texts_stay_where_they_are(spark):
    recs = spark.range(2000).selectExpr("id AS rec_id", "'m' AS model", "'healthy' AS bottleneck_dimension", "CASE WHEN id = 7 THEN 'nope, k1' END AS kb_citation", "'sort' AS explanation", "'ab' AS code_before", "'zz' AS code_after", "'' AS api_change", "'2x' AS expected_speedup")
    kb = spark.createDataFrame([("k1", ["healthy"], [("healthy", None, "sort", "a b", "zz")], None, None), ("k2", None, None, None, None)], "entry_id string, bottleneck_labels array<string>, fixes array<struct<dimension:string,cause:string,fix:string,code_before:string,code_after:string>>, io_functions map<string,string>, key_params string")
    out = claims.verify(recs, kb)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread" in plan and plan.count("Join") <= 6
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = claims.verify(recs, kb).groupBy(claims.F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    r = out.filter("rec_id = 7").first()
    assert (r.n_cited, r.n_valid_cited, r.primary, r.code_before_similarity, r.code_after_similarity, r.fix_type_score) == (2, 1, "k1", 0.8, 1.0, 1.0) and out.filter("citation_valid").count() == 1
