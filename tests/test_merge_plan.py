"""The merge of records shuffles narrow rows and hashes its wide sums."""

from ioloom.operators.records import aggregate_records
from ioloom.sources import surrogate


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_of_records_are_not_shuffled(spark):
    """Records are dealt by job before they are widened, so between partial and final sums there is no exchange."""
    plan = plan_of(aggregate_records(surrogate.records(spark, "/root/testdata/sf0.001", ["POSIX_READS", "POSIX_WRITES"])))
    assert "REPARTITION" in plan and "ENSURE_REQUIREMENTS" not in plan.split("POSIX_READS")[1].split("FileScan")[0]


def test_the_wide_merge_is_hashed(spark):
    wide = [x for x in plan_of(aggregate_records(surrogate.records(spark, "/root/testdata/sf0.001"))).splitlines() if "SortAggregate" in x]
    assert not any("sum(POSIX_READS" in x for x in wide)
