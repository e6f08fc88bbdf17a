"""Joins, set operations and ordered picks by relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows matched on keys and on their occurrence number within them."""
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return number(left, left_order).join(number(right, right_order), [*keys, "occurrence"])


def nearest_interval(points: DataFrame, steps: DataFrame, key: str, time: str, start: str, end: str, slack: int, point_id: str, width: int = 86_400) -> DataFrame:
    """Each point with the step of its key whose interval, widened by slack, holds it and ends nearest; ties go to the earlier step.

    A band join: time is cut into bins of width, a step stands in each bin that it reaches, and key and bin are joined,
    so a key with many points is as many tasks as it has bins, and points meet the steps of their own bin only.
    """
    at = lambda t: F.floor(t / width)
    s = steps.select(F.col(key).alias("_key"), F.col(start).alias("step_start"), F.col(end).alias("step_end"))
    low, high = F.col("step_start") - slack, F.col("step_end") + slack
    s = s.filter(low <= high).withColumn("_bin", F.explode(F.sequence(at(low), at(high))))
    p = points.withColumn("_at", at(F.col(time)))
    joined = p.join(s, (p[key] == s._key) & (p._at == s._bin) & p[time].between(s.step_start - slack, s.step_end + slack)).drop("_key", "_bin", "_at")
    place = F.row_number().over(Window.partitionBy(point_id).orderBy(F.abs(F.col(time) - F.col("step_end")), "step_start"))
    return joined.withColumn("_k", place).filter("_k = 1").drop("_k")


def lookup(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """left with the table's columns, null where the key isn't there."""
    return left.join(table, key, "left")


def unmapped(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return left.join(table, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def longest_prefix(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """Each name with its matching key: an exact one, else the longest that either begins with the other.

    keys is a list of labels of proven size in the caller's hands: it is matched by a broadcast
    nested loop only below MAX_KEYS rows, else by all prefixes of the names in an equi join.
    """
    if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        k = F.broadcast(keys.select(F.col(key).alias("label")))
        joined = names.join(k, F.col(name).startswith(F.col("label")) | F.col("label").startswith(F.col(name)), "left")
    else:
        parts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, F.lit(1), i))
        k = keys.select(F.col(key).alias("label"))
        down = names.withColumn("_p", F.explode(parts(F.col(name)))).join(k, F.col("_p") == F.col("label")).drop("_p")
        up = names.join(k.withColumn("_p", F.explode(parts(F.col("label")))), F.col(name) == F.col("_p")).drop("_p")
        joined = names.join(down.unionByName(up).distinct(), name, "left")
    best = F.row_number().over(Window.partitionBy(name).orderBy(F.desc(F.col("label") == F.col(name)), F.desc(F.length("label")), "label"))
    return joined.withColumn("_k", best).filter("_k = 1").drop("_k")


MAX_KEYS = 2000


def overlap_join(left: DataFrame, right: DataFrame, array: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, matched (number of shared array values): an equi join on exploded values."""
    a = left.select(left_id, F.explode(array).alias("_v")).distinct()
    b = right.select(right_id, F.explode(array).alias("_v")).distinct()
    return a.join(b, "_v").groupBy(left_id, right_id).agg(F.count("*").alias("matched"))


def pending(todo: DataFrame, done: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Work that has no result without an error."""
    return todo.join(done.filter(~error), keys, "left_anti")


def mapped_codes(df: DataFrame, key: str, codes: str, mapping: DataFrame, skip: list[str] = ("NOL",)) -> DataFrame:
    """key, dims: dimensions of the codes by a (code, dim) table, ['healthy'] if none."""
    each = df.select(key, F.explode_outer(codes).alias("code")).filter(F.col("code").isNull() | ~F.col("code").isin(*skip)).join(mapping, "code", "left")
    found = each.groupBy(key).agg(F.array_sort(F.collect_set("dim")).alias("dims"))
    return df.select(key).distinct().join(found, key, "left").select(key, F.when(F.size(F.coalesce("dims", F.array())) > 0, F.col("dims")).otherwise(F.array(F.lit("healthy"))).alias("dims"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] = ()) -> DataFrame:
    """The first k rows in order, of each group if by is given."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def chunks(jobs: DataFrame, key: str, n: int) -> DataFrame:
    """jobs with chunk: n ceiling-sized slices in key order. The order of keys comes from a range partitioning."""
    spread = jobs.repartitionByRange(key).withColumn("_p", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("_p").agg(F.count("*").alias("c")).select("_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_b"), F.ceil(F.sum("c").over(Window.partitionBy()) / n).alias("_size"))
    return spread.join(sizes, "_p").withColumn("chunk", F.floor((F.col("_b") + F.col("_r") - 1) / F.col("_size"))).drop("_p", "_r", "_b", "_size")
