"""Merges and percentiles by column in Arrow batches against Spark's own, over values, jobs and batches of all kinds."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ioloom.functions.counters import ALL_COUNTERS, FLOATS, MODULE_OF, MODULES
from ioloom.operators import columns, merge, order, records, stats

HARD = [0.0, -0.0, 1e-320, -1e-320, 1.0, 1.0 + 1e-15, 1.0 - 1e-15, -1.0, 1e15 + 1, 1.6e9, 1e308, -1e308, math.inf, -math.inf, None]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("dealt", [False, True])
def test_merge_in_batches_is_the_grouping_of_records(spark, small_batches, dealt):
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 40, 1, 6, 7, 30, 5]
    job = np.repeat(np.arange(len(sizes)), sizes)
    n = len(job)
    module = rng.choice([*MODULES, "H5F", None], n, p=[0.4, 0.25, 0.2, 0.1, 0.05])
    data = {"jobid": job, "module": pa.array(module.tolist(), pa.string()), "file_id": pa.array([None if x > 5 else int(x % 2) for x in rng.integers(0, 7, n)], pa.int64())}
    data["record_seq"] = np.concatenate([rng.permutation(s) for s in sizes])  # records come in any order
    for c in ALL_COUNTERS:
        v = rng.integers(-2, 9, n)
        gone = (rng.random(n) < 0.3) | (module != MODULE_OF[c])
        data[c] = pa.array((v / 8).tolist() if c in FLOATS else v.tolist(), pa.float64() if c in FLOATS else pa.int64(), mask=gone)
    data["POSIX_F_MAX_READ_TIME"] = pa.array(np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 3, n)))
    rows = spark.createDataFrame(pa.table(data)).withColumn("head", F.struct(F.col("jobid").alias("a"), F.col("jobid").cast("string").alias("b"))).coalesce(1)
    want = records.aggregate_records(rows)
    got = merge.merge_all(rows, carry=["head"], dealt=dealt)
    assert [(f.name, f.dataType) for f in got.drop("head").select(*want.columns).schema] == [(f.name, f.dataType) for f in want.schema]
    text = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert text(got) == text(want) and got.filter("head.a <> jobid or head.b <> jobid or head is null").count() == 0


def test_sums_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        merge._fit([2**63])


def table(spark, n=3000):
    rows = [(HARD[i % len(HARD)], None, 1.6e9 + (i * 7919) % 3001, float(i % 3), 1 + i * 1e-9, math.nan if i % 3 else 1.0, 7 if i == 5 else None, float(i == 9)) for i in range(n)]
    return spark.createDataFrame(rows, "hard double, none double, times double, hot double, dense double, nan double, one int, rare double").repartition(5)


@pytest.mark.parametrize("few", [4096, 2])
def test_percentiles_by_column_are_those_of_the_whole_column(spark, monkeypatch, few):
    monkeypatch.setattr(columns, "FEW", few)
    monkeypatch.setattr(columns, "SLOTS", 5)
    monkeypatch.setattr(columns, "HELD", 50)
    shares, df = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0], table(spark)
    held = columns.Columns(df, df.columns)
    got = held.percentiles(shares)
    held.release()
    want = {r.feature: r.q for r in order.percentiles(stats.values(df, df.columns), ["feature"], "value", shares).collect()}
    assert {df.columns[c]: list(map(repr, q)) for c, q in got.items()} == {f: list(map(repr, q)) for f, q in want.items()}


def test_outliers_and_ranges_read_no_unpivoted_values(spark, monkeypatch):
    df = table(spark)
    q = lambda rows, s: {r.feature: r.q[0] for r in order.percentiles(rows, ["feature"], "value", [s]).collect()}
    rows = stats.values(df, df.columns)
    mid = q(rows, 0.5)
    away = rows.withColumn("mid", F.create_map(*[F.lit(x) for p in mid.items() for x in p])[F.col("feature")]).select("feature", F.abs(F.col("value") - F.col("mid")).alias("value"))
    mad = q(away, 0.5)
    ends = {s: q(rows, s) for s in (0.05, 0.25, 0.75, 0.95)}
    spread = {r.feature: (r.m, r.s) for r in rows.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()}
    by_column = {c: [r[c] for r in df.select(c).collect()] for c in df.columns}
    monkeypatch.setattr(stats, "values", None)  # one row a cell: 186 times the table
    far = {r.feature: r.outlier_ratio for r in stats.mad_outliers(df, df.columns).collect()}
    for c, cells in by_column.items():
        there = [float(v) for v in cells if v is not None]
        over = lambda x: not x <= 3
        if c in mad and not mad[c] <= 1e-10:
            want = [over(abs(v - mid[c]) / (1.4826 * mad[c])) for v in there]
        elif there and spread[c][1] is not None and not spread[c][1] <= 1e-10:
            want = [over(abs(v - spread[c][0]) / spread[c][1]) for v in there]
        else:
            want = [False]
        assert far[c] == pytest.approx(sum(want) / len(want), abs=1e-12), c
    found = {r.feature: (r.in_range, r.iqr_ok) for r in stats.range_check(df, df.columns).collect()}
    assert set(found) == set(df.columns) and found["none"] == (None, None)
    for c in mad:
        a, b, x, y = (ends[s][c] for s in (0.05, 0.25, 0.75, 0.95))
        assert found[c] == (a >= -10 and y <= 10, 0.1 <= x - b <= 10), c
    empty = df.limit(0)
    assert stats.mad_outliers(empty, df.columns).count() == 0 and stats.range_check(empty, df.columns).count() == 0
