"""Places, running sums and exact percentiles within groups of any size: groups are cut into buckets in order, buckets are
summed, and only rows of one bucket meet in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Even slots that a step of the logarithm is cut into.
SLOTS = 4096


def step(v: Column) -> Column:
    """A whole number that never falls as the double v rises, a 64th of an e-fold wide; nulls first, NaN last."""
    size = F.least(F.floor(F.ln(F.abs(v)) * 64), F.lit(50_000)) + 50_001
    return F.when(v.isNull(), -200_000).when(F.isnan(v), 200_000).when(v == 0, 0).otherwise(F.signum(v).cast("long") * size)


def _below(value: str, by: list[str], order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, by: list[str], bucket: Column, order: list) -> DataFrame:
    """rows with _place (from 0, in order within by) and _size (rows of the group). bucket must never fall in that order."""
    rows = rows.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0))).withColumn("_b", bucket)
    sizes = rows.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_g", "_b", _below("_n", ["_g"], "_b").alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias("_size"))
    own = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*order)) - 1
    return rows.join(sizes, ["_g", "_b"]).withColumn("_place", F.col("_before") + own).drop("_g", "_b", "_before")


def running(counts: DataFrame, by: str, value: str, sums: list[str]) -> DataFrame:
    """counts (a row per by and value) with <sum>_below, over lesser values of the group, and <sum>_all, over the group."""
    at = counts.withColumn("_b", step(F.col(value).cast("double")))
    hist = at.groupBy(by, "_b").agg(*[F.sum(s).alias(s) for s in sums])
    hist = hist.select(by, "_b", *[_below(s, [by], "_b").alias(f"_{s}") for s in sums], *[F.sum(s).over(Window.partitionBy(by)).alias(f"{s}_all") for s in sums])
    out = at.join(hist, [by, "_b"])
    return out.select(*counts.columns, *[(F.col(f"_{s}") + _below(s, [by, "_b"], value)).alias(f"{s}_below") for s in sums], *[f"{s}_all" for s in sums])


def kept(short: DataFrame) -> DataFrame:
    """short, a table of as many rows as groups and shares ask for, computed now: what follows plans and runs it once."""
    return short.sparkSession.createDataFrame(short.toArrow(), short.schema)


def settled(short: DataFrame, held: DataFrame) -> DataFrame:
    """short, computed now; held, persisted for it, is released."""
    out = kept(short)
    held.unpersist()
    return out


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: bool = False) -> DataFrame:
    """by, q: exact interpolated percentiles of value in each group, in the order of shares; groups without a value have no row.

    Each sought rank is found in a step of the logarithm, then in one of 4096 even slots of that step, and only the values of
    such slots are ordered. few: the groups are a short list, as the columns of a table are, so steps, slots and what
    they hold (two a share and group) are short too: they are counted where the rows lie, by partial sums, and broadcast; only
    the values of sought slots are shuffled, and the result is computed at once. Otherwise equal values are counted
    first, and counts are shuffled.
    """
    small = F.broadcast if few else lambda df: df
    g, b, slot = ["_g"], ["_g", "_b"], ["_g", "_b", "_slot"]
    inside = (F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_n"))
    at = rows.select(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if few:
        at = at.select("*", F.lit(1).cast("bigint").alias("_n"), step(F.col("_v")).alias("_b"))
    else:
        at = at.groupBy("_g", "_v").agg(F.count("*").alias("_n")).withColumn("_b", step(F.col("_v")))
    hist = at.groupBy(*b).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hist = hist.withColumn("_at", _below("_n", g, "_b")).withColumn("_last", F.sum("_n").over(Window.partitionBy(*g)) - 1)
    sought = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), cut(F.col("_last") * s).alias("_rank")) for i, s in enumerate(shares) for up, cut in ((False, F.floor), (True, F.ceil))])
    found = hist.withColumn("x", F.explode(sought)).select("*", "x.*").filter(inside).select(*b, "_lo", "_hi", "_last", "i", "up", (F.col("_rank") - F.col("_at")).alias("_rank"))
    found = kept(found) if few else found

    even = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLOTS)).otherwise(0)
    near = at.join(small(found.select(*b, "_lo", "_hi").distinct()), b).select(*b, even.alias("_slot"), "_v", "_n")
    fine = near.groupBy(*slot).agg(F.sum("_n").alias("_n"))
    fine = fine.withColumn("_at", _below("_n", b, "_slot"))
    found = fine.join(small(found), b).filter(inside).select(*slot, "_last", "i", "up", (F.col("_rank") - F.col("_at")).alias("_rank"))
    found = kept(found) if few else found

    last = near.join(small(found.select(*slot).distinct()), slot)
    last = last.groupBy(*slot, "_v").agg(F.sum("_n").alias("_n")) if few else last
    last = last.withColumn("_at", _below("_n", slot, "_v"))
    hits = last.join(small(found), slot).filter(inside)
    picked = lambda i, up: F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("_v")))
    ends = hits.groupBy("_g").agg(F.max("_last").alias("_last"), *[picked(i, up).alias(f"_{i}{up}") for i in range(len(shares)) for up in (False, True)])

    def between(i: int, s: float) -> Column:
        lo, hi, at = F.col(f"_{i}False"), F.col(f"_{i}True"), F.col("_last") * s
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    out = ends.select("_g.*", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))
    return kept(out) if few else out
