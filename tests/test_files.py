"""File scans: listing, quarantine, caps; text lines whose forms the tables lack."""

import gzip

from ioloom.operators import rules
from ioloom.sources import log_files, text_logs


def lines_of(spark, *texts):
    return spark.createDataFrame([(f"f{i}", n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))], "file string, line_no bigint, value string")


def test_scan_keeps_broken_files_apart(spark, tmp_path):
    top = tmp_path / "logs"
    (top / "deep").mkdir(parents=True)
    (top / "a.log").write_text("# jobid: 1\r\ntotal_X: 2\n")
    (top / "deep" / "b.log").write_bytes(gzip.compress(b"# jobid: 2\n"))
    (top / "c.log").write_bytes(gzip.compress(b"# jobid: 3\n")[:-4])
    (top / "d.log").write_bytes(b"# jobid: \xff\xfe")
    (top / "e.log").write_text("usage: " + "x" * 500)
    (top / "f.log").write_text(" \n")
    (top / "g.other").write_text("# jobid: 9")
    good, bad = log_files.scan(spark, [str(top)], str(tmp_path / "out"), "*.log", must_match="^#")
    assert sorted((r.file[-5:], r.line_no, r.value) for r in good.collect()) == [("a.log", 0, "# jobid: 1"), ("a.log", 1, "total_X: 2"), ("b.log", 0, "# jobid: 2")]
    told = {r.file_path[-5:]: r for r in bad.collect()}
    assert set(told) == {"c.log", "d.log", "e.log", "f.log"} and all(len(r.error) <= 200 and r.timestamp for r in told.values())
    assert told["c.log"].error.startswith("broken gzip") and "utf-8" in told["d.log"].error and told["f.log"].error == "empty file"
    assert {r.jobid for r in text_logs.headers(good).collect()} == {1, 2}


def test_listing_lists_and_caps_by_name(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.log").write_text(n * 3)
    (tmp_path / "list.txt").write_text(f"{tmp_path}/c.log\n\n {tmp_path}/a.log \n")
    files = log_files.listing(spark, [str(tmp_path)], "*.log")
    assert sorted((r.file[-5:], r.bytes) for r in files.collect()) == [("a.log", 3), ("b.log", 3), ("c.log", 3)]
    good, bad = log_files.scan(spark, [str(tmp_path)], str(tmp_path / "one"), "*.log", cap=2)
    assert sorted(r.value for r in good.collect()) == ["aaa", "bbb"] and bad.count() == 0
    good, _ = log_files.scan(spark, log_files.path_list(spark, str(tmp_path / "list.txt")), str(tmp_path / "two"))
    assert sorted(r.value for r in good.collect()) == ["aaa", "ccc"]
    good, bad = log_files.scan(spark, [str(tmp_path)], str(tmp_path / "three"), "*.log", cap=0)
    assert good.count() == bad.count() == 0


def test_run_timing_reads_the_written_forms(spark):
    got = {r.file: r[1:] for r in text_logs.run_timing(lines_of(spark, "E2E x - y - 10:00\nsrun: Exit code: 3\nExit code: none\nnow Completed: 11:00 ", "e2e - 1\nE2E no dash\nexit code: 4", "  E2E - a\nExit code: -1")).collect()}
    assert got == {"f0": (3, "10:00", "11:00"), "f1": (None, None, None), "f2": (-1, "a", None)}


def test_modules_keep_the_listed_order(spark):
    got = {r.file: r.modules for r in text_logs.modules(lines_of(spark, "# HEATMAP module: ver=1\n# POSIX module ver=4", "MPI-IO module data\nSTDIO module data\nSTDIO module ver=2", "XPOSIX modules", "LUSTRE module data")).collect()}
    assert got == {"f0": ["POSIX", "HEATMAP"], "f1": ["STDIO", "MPI-IO"]}


def test_totals_take_every_number(spark):
    got = {r.counter: r.value for r in text_logs.totals(lines_of(spark, "total_A: 1\ntotal_A: -2.5e+3\ntotal_B: +4E-1\ntotal_C: x\n# agg_perf_by_slowest: 1.5e2 # MiB/s\nxtotal_D: 1")).collect()}
    assert got == {"A": -2500.0, "B": 0.4, "agg_perf_mib_s": 150.0}


def test_code_agreement_looks_at_compared_jobs_only(spark):
    pairs = lambda *rows: spark.createDataFrame(rows, "jobid bigint, code string")
    got = rules.code_agreement(pairs((1, "P05"), (2, "P05"), (3, "P05")), pairs((1, "P05"), (4, "P06")), spark.createDataFrame([(1,), (5,)], "jobid bigint")).collect()
    assert [tuple(r) for r in got] == [("P05", 1, 0, 0, 1.0)]


def test_a_log_is_one_row_until_it_is_written_and_a_pass_has_few_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from ioloom.plans import file_queries

    logs = spark.range(100).withColumnRenamed("id", "k")
    path = file_queries._written(spark, logs, F.array(F.lit("a"), F.lit(None).cast("string"), F.col("k").cast("string")))
    files = [p for p in __import__("pathlib").Path(path).rglob("*.txt")]
    assert len(files) == 100 and {p.read_text() for p in files} == {f"a\n\n{k}\n" for k in range(100)}
    before = spark.sparkContext.defaultParallelism
    good, _ = log_files.scan(spark, [path], str(tmp_path / "scan"))
    assert good.count() == 300 and len(list((tmp_path / "scan").rglob("*.parquet"))) <= log_files.TASKS * before


def test_lines_are_dealt_by_log_so_that_no_task_groups_a_whole_input_split(spark):
    from ioloom.plans import evidence_queries

    lines = evidence_queries._lines(spark, "/root/testdata/sf0.001")
    assert lines.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
