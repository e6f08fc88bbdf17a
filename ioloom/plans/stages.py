"""The stages that many queries share: raw rows, engineered rows and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ioloom.operators import features, merge, rules
from ioloom.operators.records import aggregate_records
from ioloom.sources import surrogate


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.assemble(aggregate_records(surrogate.records(spark, sf_dir)), surrogate.jobs(spark, sf_dir))


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer(features.clean(raw(spark, sf_dir)))


def engineered_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engineered for queries of all features: counters are merged in Arrow batches, none is left out if it isn't asked for, and
    rows are no longer dealt by job."""
    merged = merge.merge_all(surrogate.records_of_jobs(spark, sf_dir), carry=["heads"], dealt=True)
    joined = merged.select("*", F.inline("heads")).drop("heads")
    return features.engineer(features.clean(features.assembled(joined, merged.columns)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.labelled(engineered(spark, sf_dir))
