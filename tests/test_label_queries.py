"""Registered queries of labelling, paths, scoring and runs against their SQL, and the edges that the tables lack."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ioloom.operators import groundtruth, metrics, runs
from ioloom.plans.queries import ORACLES, QUERIES
from ioloom.sources import text_logs

SF = "/root/testdata/sf0.001"
NAMES = ["F2_F7_inferred_labels", "F8_label_strings", "E30_rule_flags", "A1_headers", "A2_A5_totals_pivot", "A8_path_columns", "A11_missing_chunks", "A17_A19_job_output", "A18_inventory", "A18_inventory_totals", "A3_A4_modules_mounts", "A16_tool_results", "A1_A5_A7_A9_log_files", "A7_capped_files", "A17_A19_output_files", "E29_code_agreement", "B13_logs_by_job", "J9_mapped_codes", "K11_seed_runs", "K14_label_noise", "K14_confident_joint", "L18_left_out_threshold", "L22_agreement_buckets", "L23_leaderboard", "M11_groundedness", "M12_M13_atomic_claims", "M14_hallucinations", "M15_claims_of_models", "M18_phrase_dims", "M19_paragraph_dims", "M20_report_dims", "M1_knowledge_base", "M2_exported_entries", "M4_M6_retrieval", "M22_diagnoses", "M15_claim_statistics", "M23_token_cost", "N1_pair_speedups", "N7_run_categories", "N8_workload_metrics", "N9_model_summary", "N9_ablation_metrics", "N14_size_strings"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in os.listdir(SF):
        con.execute(f"create view {n.split('.')[0]} as select * from read_parquet('{SF}/{n}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_headers_take_the_last_line_and_defaults(spark):
    lines = spark.createDataFrame([("a", 0, "# nprocs: 4"), ("a", 1, "# nprocs: 8"), ("a", 2, "# start_time_asci: Mon 1:2"), ("a", 3, "# uid: x"), ("b", 0, "# darshan log version: 3.4")], "file string, line_no long, value string")
    a, b = text_logs.headers(lines).orderBy("file").collect()
    assert (a.nprocs, a.start_time, a.start_time_str, a.uid) == (8, 0, "Mon 1:2", 0) and (b.nprocs, b.log_version, b.run_time) == (1, "3.4", 0.0)


def test_scenarios_sizes_and_missing_features(spark):
    names = [("/x/IOR_a_12345_6_z.darshan", "ior_a"), ("mdtest_b.darshan", "mdtest_b"), ("c_123_4.darshan", "c_123_4")]
    got = spark.createDataFrame(names, "p string, want string").select(groundtruth.scenario_of(F.col("p")).alias("s"), "want").collect()
    assert all(r.s == r.want for r in got)
    sizes = [("1M", 1 << 20), ("64k", 65536), (" 1.5g ", 1610612736), ("4096", 4096), ("4kb", None), ("", None)]
    assert all(r.s == r.want for r in spark.createDataFrame(sizes, "t string, want long").select(runs.size_bytes(F.col("t")).alias("s"), "want").collect())
    bare = groundtruth.relabelled(spark.createDataFrame([(0.6,), (None,)], "small_io_ratio double")).collect()
    assert [(r.access_granularity, r.throughput_utilization, r.healthy) for r in bare] == [(1, 0, 0), (0, 0, 1)]


def test_bootstrap_intervals_hold_the_point_and_differences_are_paired(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 2 == 0), int(i % 3 == 0)) for i in range(120)], "job_id long, gt_x int, pred_x int, base_x int")
    micro = {r.metric: r for r in metrics.bootstrap(df, ["x"], 2000).collect()}
    f1 = metrics.per_label(df, ["x"]).first().f1
    assert set(micro) == {"micro_f1", "macro_f1"} and all(r.low < f1 < r.high and abs(r.mean - f1) < 0.03 for r in micro.values())
    paired = metrics.bootstrap(df, ["x"], 2000, other="base").first()
    assert paired.high < 0 and paired.p_not_above == 1.0
    assert {r.mean for r in metrics.bootstrap(df.withColumn("base_x", F.col("pred_x")), ["x"], 50, other="base").collect()} == {0.0}
