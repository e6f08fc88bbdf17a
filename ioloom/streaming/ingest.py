"""Structured Streaming forms of ingest and rates. Each runs what is available, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def append_new(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends to path the rows that no earlier run with this checkpoint has written."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def deduplicated(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows without late repeats of a key within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_rates(df: DataFrame, time: str, width: str, by: str, value: str, delay: str = "1 hour") -> DataFrame:
    """window start, by, n and the mean of value."""
    return df.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("rate")).select(F.col("window.start").alias("start"), by, "n", "rate")


def sessions(df: DataFrame, time: str, user: str, gap: str) -> DataFrame:
    """user, session start and end, n: activity with no pause of gap or more."""
    return df.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
