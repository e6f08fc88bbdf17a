"""Sharding by a k-d tree over document metadata.

Nodes are split at the weighted median of the dimension in which they are widest, weights being
bytes, until every leaf holds its share. The median is found by distributed histograms: each round
sums bytes into BINS bins for all open nodes at once and narrows every node's interval to the bin
that holds the median; rows that tie on the dimension are split by row number, so the cut is exact
and one heavy value can be divided. Only per-node sums reach the driver, BINS a node and round at most.

Law: bytes. Shards differ by about a document's size per level. Equal texts or ids are not kept together.
Defined results: null text has size 1 and checksum 0; null metadata sorts lowest; repeated rows are
rows of their own; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ioloom.llm.base import written

BINS = 4096


def _metadata(id_col: str, text_col: str, docs: DataFrame) -> list[Column]:
    """The dimensions: text length and, where they exist, hashes of language and source."""
    named = [F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(-1)) for c in ("lang", "source") if c in docs.columns]
    return [F.coalesce(F.length(text_col), F.lit(-1)).cast("bigint"), *[c.cast("bigint") for c in named]]


def _cuts(rows: DataFrame, column: str, aims: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """For each node: (v, bytes below v), v the smallest value of column with sum(size of column <= v) >= aim.

    aims: node -> (aim, lowest value, highest value).
    """
    state = {n: [aim, lo, hi, 0] for n, (aim, lo, hi) in aims.items()}  # [aim, lo, hi, bytes below lo]
    while open_ := {n: s for n, s in state.items() if s[1] < s[2]}:
        width = {n: max(1, -(-(s[2] - s[1] + 1) // BINS)) for n, s in open_.items()}
        pick = lambda of: F.coalesce(*[F.when(F.col("node") == n, F.lit(of(n))) for n in open_])
        lo, hi, step = pick(lambda n: open_[n][1]), pick(lambda n: open_[n][2]), pick(lambda n: width[n])
        inside = rows.filter(F.col("node").isin(list(open_))).filter(F.col(column).between(lo, hi))
        sums: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        for r in inside.groupBy("node", F.floor((F.col(column) - lo) / step).alias("bin")).agg(F.sum("size").alias("b")).collect():
            sums[r["node"]].append((r["bin"], r["b"]))
        for n, s in open_.items():
            bins, below = sorted(sums[n]), s[3]
            for k, b in bins:
                if below + b >= s[0] or k == bins[-1][0]:
                    low = s[1] + k * width[n]
                    state[n] = [s[0], low, min(s[2], low + width[n] - 1), below]
                    break
                below += b
    return {n: (s[1], s[3]) for n, s in state.items()}


def kd_shards(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null: law bytes).

    With target_bytes, the number of shards follows from the total size.
    """
    text = F.col(text_col)
    dims = _metadata(id_col, text_col, docs)
    names = [f"dim{i}" for i in range(len(dims))]
    slim = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("crc"), F.monotonically_increasing_id().alias("row"), *[d.alias(n) for d, n in zip(dims, names, strict=True)])
    slim = written(slim, "shard-rows")
    if target_bytes:
        total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        n_shards = max(1, -(-total // target_bytes))
    # Leaves are known by their first shard: node k with s shards becomes k and k + s // 2.
    rows, spread, extent = slim.withColumn("node", F.lit(0)), {0: n_shards}, None
    while todo := [n for n, s in spread.items() if s > 1]:
        of = {r["node"]: r for r in rows.filter(F.col("node").isin(todo)).groupBy("node").agg(F.sum("size").alias("size"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), *[f(n).alias(f"{n}_{w}") for n in names for f, w in ((F.min, "lo"), (F.max, "hi"))]).collect()}
        if not of:
            break
        extent = extent or {n: max(1, of[0][f"{n}_hi"] - of[0][f"{n}_lo"]) for n in names}
        widest = {k: max(names, key=lambda n: (r[f"{n}_hi"] - r[f"{n}_lo"]) / extent[n]) for k, r in of.items()}
        values = F.coalesce(*[F.when(F.col("node") == k, F.col(d)) for k, d in widest.items()])
        at = rows.withColumn("value", values)
        aims = {k: (max(1, round(r["size"] * (spread[k] // 2) / spread[k])), r[f"{widest[k]}_lo"], r[f"{widest[k]}_hi"]) for k, r in of.items()}
        cut = _cuts(at, "value", aims)
        tied = at.filter(F.coalesce(*[F.when(F.col("node") == k, F.col("value") == v) for k, (v, _) in cut.items()], F.lit(False)))
        ties = _cuts(tied, "row", {k: (aims[k][0] - below, of[k]["row_lo"], of[k]["row_hi"]) for k, (_, below) in cut.items()})
        right = F.coalesce(*[F.when(F.col("node") == k, (F.col("value") > v) | ((F.col("value") == v) & (F.col("row") > ties[k][0]))) for k, (v, _) in cut.items()], F.lit(False))
        move = F.coalesce(*[F.when(F.col("node") == k, F.lit(spread[k] // 2)) for k in of], F.lit(0))
        rows = written(at.withColumn("node", F.col("node") + F.when(right, move).otherwise(0)).drop("value"), "shard-rows")
        spread = {m: s for k, n in spread.items() for m, s in (((k, n // 2), (k + n // 2, n - n // 2)) if n > 1 else ((k, n),))}
    # A slot is the count of a shard's rows in earlier input splits plus the rank within the split.
    split = F.shiftright("row", 33)
    placed = rows.select("id", "size", "crc", F.col("node").alias("shard"), split.alias("split"), "row")
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "split").orderBy("row")) - 1
    out = placed.withColumn("rank", rank).join(base, ["shard", "split"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
