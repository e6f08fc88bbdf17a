"""Record merging, features, rules, metrics and joins: hand-made rows, and queries against SQL on a small table set."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ioloom.functions.counters import ALL_COUNTERS, MODULES, rule_of
from ioloom.operators import features, metrics, prepare, relate, rules, stats
from ioloom.operators.records import aggregate_records, top4_merge
from ioloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_counter_schema():
    assert {m: len(c) for m, c in MODULES.items()} == {"POSIX": 86, "MPI-IO": 33, "STDIO": 17}
    assert len(set(ALL_COUNTERS)) == 136


def test_merge_rules_on_hand_made_records(spark):
    cols = "jobid bigint, module string, file_id bigint, record_seq bigint, POSIX_READS bigint, POSIX_MODE bigint, POSIX_MAX_BYTE_READ bigint, POSIX_F_OPEN_START_TIMESTAMP double, POSIX_F_MAX_READ_TIME double, POSIX_MAX_READ_TIME_SIZE bigint, POSIX_SLOWEST_RANK bigint, POSIX_F_SLOWEST_RANK_TIME double"
    rows = [(1, "POSIX", 7, 1, 5, 10, 3, 0.0, 2.0, 100, 4, 1.5), (1, "POSIX", 7, 2, 6, 20, 9, 3.0, 2.0, 200, 5, 2.5), (2, "POSIX", 7, 1, -1, 1, 1, 0.0, 1.0, 1, 1, 1.0), (2, "POSIX", 8, 2, 9, 2, 1, 0.0, 5.0, 2, 2, 9.0)]
    got = {r.jobid: r for r in aggregate_records(spark.createDataFrame(rows, cols)).collect()}
    a, b = got[1], got[2]
    assert (a.POSIX_READS, a.POSIX_MODE, a.POSIX_MAX_BYTE_READ, a.POSIX_F_OPEN_START_TIMESTAMP, a.POSIX_MAX_READ_TIME_SIZE, a.POSIX_SLOWEST_RANK, a.POSIX_F_SLOWEST_RANK_TIME, a.shared_posix, a.num_files) == (11, 20, 9, 3.0, 100, 5, 2.5, True, 1)
    assert (b.POSIX_READS, b.POSIX_F_OPEN_START_TIMESTAMP, b.POSIX_MAX_READ_TIME_SIZE, b.POSIX_SLOWEST_RANK, b.POSIX_F_SLOWEST_RANK_TIME, b.shared_posix, b.num_files) == (-1, 0.0, 2, -1, 0.0, False, 2)


def test_top4_merge_adds_equal_values_and_breaks_ties_by_value(spark):
    names = [c for i in range(1, 5) for c in (f"POSIX_ACCESS{i}_ACCESS", f"POSIX_ACCESS{i}_COUNT")]
    rows = [(1, 8, 3, 16, 3, 32, 1, 64, 0), (1, 16, 2, 128, 4, 256, 3, 512, 3)]
    r = top4_merge(spark.createDataFrame(rows, "jobid bigint, " + ", ".join(f"{n} bigint" for n in names)), ["POSIX_ACCESS"]).first()
    assert [(r[f"POSIX_ACCESS{i}_ACCESS"], r[f"POSIX_ACCESS{i}_COUNT"]) for i in range(1, 5)] == [(16, 5), (128, 4), (512, 3), (256, 3)]


def test_rule_boundaries(spark, tmp_path):
    base = {c: 0.0 for c in ALL_COUNTERS} | {c: 0 for c in ("has_posix", "has_mpiio", "has_stdio", "has_hdf5", "has_pnetcdf", "has_apmpi", "has_heatmap", "is_shared_file")} | {"nprocs": 1.0, "runtime_seconds": 10.0, "num_files": 1.0}
    cases = [{"POSIX_READS": 1000.0, "POSIX_SIZE_READ_0_100": 1000.0}, {"POSIX_READS": 1001.0, "POSIX_SIZE_READ_0_100": 1001.0}, {"POSIX_F_META_TIME": 30.0}, {"POSIX_F_META_TIME": 30.1}, {"has_mpiio": 1, "MPIIO_NB_READS": 1.0, "MPIIO_NB_WRITES": 1.0}, {"has_mpiio": 1, "POSIX_F_META_TIME": 31.0, "POSIX_MAX_BYTE_READ": 5.0}]
    pd.DataFrame([{"_jobid": i} | base | c for i, c in enumerate(cases)]).to_parquet(tmp_path / "rows.parquet")
    got = {r["_jobid"]: r for r in rules.labelled(features.engineer(spark.read.parquet(str(tmp_path / "rows.parquet")))).collect()}
    assert [got[i].P05 for i in (0, 1)] == [0, 1] and [got[i].P17 for i in (2, 3)] == [0, 1]
    assert got[4].healthy == 1 and got[4].confidence == 0.5
    assert (got[5].healthy, got[5].metadata_intensity, got[5].throughput_utilization) == (0, 1, 1) and got[5].confidence == pytest.approx((1 + 0.7 * 3) / 4)


def test_metric_identities(spark):
    rows = [(i, i % 3 == 0, i % 2 == 0, (i % 10) / 10) for i in range(60)]
    df = spark.createDataFrame([(i, "b", int(a), int(b), p) for i, a, b, p in rows], "job_id bigint, benchmark string, gt_x int, pred_x int, prob_x double")
    r = metrics.per_label(df, ["x"]).first()
    assert r.tp + r.fp + r.fn + r.tn == 60 and (r.tp, r.fp, r.fn) == (10, 20, 10)
    low = metrics.bootstrap(df, ["x"], 200).first()
    assert low.low <= r.f1 <= low.high
    left = metrics.left_out_thresholds(df, ["x"], [0.2, 0.5, 0.8]).collect()
    f1 = lambda t, out: (lambda tp, p, g: 2 * tp / (p + g) if p + g else 0)(sum(a and q >= t for i, a, _, q in rows if i != out), sum(q >= t for i, a, _, q in rows if i != out), sum(a for i, a, _, _ in rows if i != out))
    assert all(x.threshold == max((f1(t, x.job_id), -t) for t in (0.2, 0.5, 0.8))[1] * -1 for x in left)


def test_splits_have_exact_sizes_and_no_overlap(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 * 40000).alias("t"))
    for out in (prepare.temporal_split(df, "t", "k"), prepare.random_split(df, "k")):
        assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}
    late = prepare.temporal_split(df, "t", "k").groupBy("split").agg(F.max(F.struct("t", "k")).alias("m"), F.min(F.struct("t", "k")).alias("n")).collect()
    at = {r.split: r for r in late}
    assert at["train"].m < at["val"].n < at["val"].m < at["test"].n
    assert prepare.temporal_split(df.limit(3), "t", "k").filter("split <> 'train'").count() == 0


def test_longest_prefix_ways_agree(spark, monkeypatch):
    names = spark.createDataFrame([("abcd",), ("ab",), ("zz",), ("abx",)], "name string")
    keys = spark.createDataFrame([("abc",), ("ab",), ("a",), ("abxy",)], "key string")
    few = {r.name: r.label for r in relate.longest_prefix(names, "name", keys, "key").collect()}
    monkeypatch.setattr(relate, "MAX_KEYS", 1)
    assert few == {r.name: r.label for r in relate.longest_prefix(names, "name", keys, "key").collect()} == {"abcd": "abc", "ab": "ab", "zz": None, "abx": "abxy"}


def test_constants_and_clipped_logs(spark):
    df = spark.createDataFrame([(1.0, 5.0, -3.0), (1.0, 6.0, 9.0)], "a double, b double, c double")
    assert stats.constants(df, ["a", "b", "c"]) == ["a"]
    assert [round(r[0], 6) for r in df.select(prepare.log1p_clipped(F.col("c"))).collect()] == [0.0, 2.302585]
    assert rule_of("POSIX_MMAPS") == "sum_clamp"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(set(ORACLES) & {"B3_max", "label_rates", "H5_temporal_split", "J3_nearest_interval", "J5_longest_prefix", "L17_ranking", "F1_F7_pattern_labels", "N4_N6_run_progress"}))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda d: sorted(tuple("" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)
