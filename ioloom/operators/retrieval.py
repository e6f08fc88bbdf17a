"""Evidence for jobs from a knowledge base, without a table of pairs.

Of entries with equal labels and signature only the first K can be among the best, and jobs that ask the same get the same, so both
are narrowed first. Entries are blocks of equal labels and equal zero places, divided by value into leaves with bounds, so how many
labels a job and an entry share is known for a whole leaf, and so is the greatest similarity that an entry of it can have. A task holds
the knowledge base as arrays and goes through the leaves by shared labels, then by bound, until no leaf left can
hold a better entry.

A knowledge base of more than SLICE entries is ranged by labels, zero places and the interleaved bits of its values, so that a task makes leaves of
entries that are near each other. Only the bounds of the leaves (LEAVES or so) and of groups of them are broadcast. A question first meets the entries of its nearest leaves,
which gives a least rank, then those of all leaves whose bounds reach that rank; each leaf goes to its questions once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ioloom.sources.scratch import scratch_path

#: Entries that are broadcast at once, similarities that a task computes at once, and entries of a leaf.
SLICE, CELLS, LEAF = 200_000, 4_000_000, 64
#: Leaves of a knowledge base in slices (leaves grow beyond), leaves of a group, and groups that a question's first entries are looked for in.
LEAVES, GROUP, NEAR = 100_000, 32, 8


# The features of a job's signature.
SIGNATURE = [
    "nprocs", "runtime_seconds", "POSIX_BYTES_WRITTEN", "POSIX_BYTES_READ", "POSIX_WRITES", "POSIX_READS", "POSIX_SEQ_WRITES", "POSIX_SEQ_READS", "POSIX_FSYNCS", "POSIX_OPENS", "POSIX_F_META_TIME",
    "MPIIO_COLL_WRITES", "MPIIO_INDEP_WRITES", "avg_write_size", "avg_read_size", "small_io_ratio", "seq_write_ratio", "metadata_time_ratio", "collective_ratio", "total_bw_mb_s", "fsync_ratio",
]


def pattern(dims: str, names: list[str]):
    """The bits of an array column's dimensions."""
    return sum((F.coalesce(F.array_contains(dims, d).cast("int"), F.lit(0)) * (1 << i) for i, d in enumerate(names)), F.lit(0))


@dataclass
class Entries:
    """Entries in the order of their leaves; of each leaf its first and last row, label pattern, bounds and least ordinal."""

    ids: np.ndarray
    ordinals: np.ndarray
    signatures: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    patterns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def _leaves(at: np.ndarray, signatures: np.ndarray, size: int):
    """The rows at, halved by the value that spans the widest ratio until size are left or all are alike."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) > size:
            mine = signatures[at]
            low, high = mine.min(axis=0), mine.max(axis=0)
            span = np.divide(high, low, out=np.ones_like(high), where=low > 0)
            widest = int(span.argmax())
            if span[widest] > 1:
                order, half = np.argpartition(mine[:, widest], len(at) // 2), len(at) // 2
                todo += [at[order[:half]], at[order[half:]]]
                continue
            for first in range(0, len(at), size):
                yield at[first : first + size]
        else:
            yield at


def _loaded(kb: DataFrame) -> Entries:
    """kb (entry_id, ordinal, pattern, signature without signs), SLICE rows or so, on the driver, in leaves."""
    return _in_leaves(kb.toArrow(), LEAF)


def _in_leaves(rows: pa.Table, size: int) -> Entries:
    ordinals, patterns = rows.column("ordinal").to_numpy(), rows.column("pattern").to_numpy()
    ids = np.array(rows.column("entry_id").to_pylist(), object)
    signatures = np.array(rows.column("signature").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1 if len(ids) else 0)
    if not len(ids):
        return Entries(ids, ordinals, signatures, *[np.zeros(0, np.int64)] * 3, signatures, signatures, np.zeros(0, np.int64))
    blocks = np.unique(np.column_stack([patterns.astype(float), signatures != 0]), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(blocks, kind="stable")
    parts = [leaf for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1) for leaf in _leaves(at, signatures, size)]
    stop = np.cumsum([len(p) for p in parts], dtype=np.int64)
    start = stop - np.array([len(p) for p in parts], dtype=np.int64)
    pick = lambda how, of: np.array([how(of[p], axis=0) for p in parts])
    rows_ = np.concatenate(parts)
    low, high = (pick(how, signatures).reshape(len(parts), signatures.shape[1]) for how in (np.min, np.max))
    return Entries(ids[rows_], ordinals[rows_], signatures[rows_], start, stop, np.array([patterns[p[0]] for p in parts], dtype=np.int64), low, high, pick(np.min, ordinals))


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a x rows of b: the mean over places not 0 in both of the smaller over the larger absolute value, in 4 places."""
    total, n = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for x, y in zip(np.abs(a).T, np.abs(b).T, strict=True):
        counts = (x[:, None] != 0) | (y[None, :] != 0)
        total += np.where(counts, np.minimum(x[:, None], y[None, :]) / np.maximum(np.maximum(x[:, None], y[None, :]), 1e-9), 0)
        n += counts
    mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    return np.floor(mean * 10000 + 0.5) / 10000


def _level(x: np.ndarray, level: np.ndarray, kb: Entries, room: int) -> list[tuple]:
    """The first room (row, similarity) of the leaves of a level, by similarity, then ordinal."""
    # The nearest point of a leaf's bounds: similarity falls on both sides of the asked value, in floats too.
    bound = similarities(x[None], np.clip(x, kb.low[level], kb.high[level]))[0]
    order = np.lexsort((kb.least[level], -bound))
    level, bound = level[order], bound[order]
    rows, found, first, step = np.empty(0, np.int64), np.empty(0), 0, 4
    while first < len(level):
        if len(rows) == room and (bound[first], -kb.least[level[first]]) < (found[-1], -kb.ordinals[rows[-1]]):
            break
        more = np.concatenate([np.arange(kb.start[i], kb.stop[i]) for i in level[first : first + step]])
        rows, found = np.concatenate([rows, more]), np.concatenate([found, similarities(x[None], kb.signatures[more])[0]])
        best = np.lexsort((kb.ordinals[rows], -found))[:room]
        rows, found = rows[best], found[best]
        first, step = first + step, min(2 * step, max(1, CELLS // LEAF))
    return list(zip(rows.tolist(), found.tolist(), strict=True))


def _best(asked: np.ndarray, bits: int, kb: Entries, k: int) -> list[list[tuple]]:
    """For each asked signature with these label bits the first k (entry, matched, similarity, ordinal)."""
    out: list[list[tuple]] = [[] for _ in asked]
    shared = np.array([int(p & bits).bit_count() for p in kb.patterns.tolist()], dtype=np.int64)
    levels = [(m, np.flatnonzero(shared == m)) for m in range(bits.bit_count(), 0, -1)]
    for x, mine in zip(asked, out, strict=True):
        for matched, level in levels:
            if len(level) and len(mine) < k:
                mine += [(kb.ids[i], matched, s, int(kb.ordinals[i])) for i, s in _level(x, level, kb, k - len(mine))]
    return out


def _answered(batches, kb: Entries, k: int, kind: pa.DataType):
    shape = pa.list_(pa.struct([("entry_id", kind), ("matched", pa.int32()), ("similarity", pa.float64()), ("ordinal", pa.int64())]))
    for batch in batches:
        bits = batch.column(0).to_numpy()
        signatures = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        found: list = [None] * batch.num_rows
        for p in np.unique(bits):
            at = np.flatnonzero(bits == p)
            for row, best in zip(at.tolist(), _best(signatures[at], int(p), kb, k), strict=True):
                found[row] = [{"entry_id": e, "matched": m, "similarity": s, "ordinal": o} for e, m, s, o in best]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, shape)], names=["pattern", "signature", "evidence"])


def retrieve(jobs: DataFrame, kb: DataFrame, names: list[str], keys: list[str], k: int = 3, size: int | None = None) -> DataFrame:
    """job_id, evidence: an array of the k best (entry_id, matched, similarity, ordinal), by shared labels, similarity, then ordinal.

    jobs: job_id, dims (an array), signature (a map); kb: entry_id, dims, signature, ordinal (unique). names: all
    dimensions; keys: all keys of signatures; a missing value is 0.
    """
    spark, size = jobs.sparkSession, size or SLICE
    vector = F.array(*[F.abs(F.coalesce(F.try_element_at("signature", F.lit(c)), F.lit(0.0))) for c in keys]).alias("signature")
    asked, wanted = jobs.select("job_id", pattern("dims", names).alias("pattern"), vector), ["pattern", "signature"]
    entries = kb.select("entry_id", F.col("ordinal").cast("bigint").alias("ordinal"), pattern("dims", names).alias("pattern"), vector)
    alike = F.row_number().over(Window.partitionBy(*wanted).orderBy("ordinal"))
    path = scratch_path(spark, "entries")
    entries.withColumn("_place", alike).filter(F.col("_place") <= k).drop("_place").write.parquet(path)
    entries = spark.read.parquet(path)
    questions = asked.select(*wanted).distinct().sortWithinPartitions("pattern")
    kinds = kb.schema["entry_id"].dataType.simpleString()
    schema = f"pattern int, signature array<double>, evidence array<struct<entry_id:{kinds},matched:int,similarity:double,ordinal:bigint>>"
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds]
    count = entries.count()
    if count <= size:
        shared = spark.sparkContext.broadcast(_loaded(entries))
        part = questions.mapInArrow(lambda batches: _answered(batches, shared.value, k, kind), schema)
        return asked.join(part, wanted).select("job_id", "evidence")
    path = scratch_path(spark, "questions")
    questions.withColumn("q", F.monotonically_increasing_id()).write.parquet(path)
    questions = spark.read.parquet(path)
    path = scratch_path(spark, "evidence")
    _in_slices(questions, entries, -(-count // size), max(LEAF, -(-count // LEAVES)), len(keys), k, kinds).write.parquet(path)
    none = F.lit(None).cast(schema.split("evidence ")[1])
    gathered = questions.join(spark.read.parquet(path), "q", "left").select(*wanted, F.coalesce("evidence", F.filter(F.array(none[0]), lambda e: F.lit(False))).alias("evidence"))
    return asked.join(gathered, wanted).select("job_id", "evidence")


# ---- a knowledge base in slices


@dataclass
class Index:
    """Of all leaves their id, label pattern, bounds, least ordinal and entries; of each group of leaves with equal labels the first
    leaf, the one after its last, labels, bounds and entries."""

    leaf: np.ndarray
    patterns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    entries: np.ndarray

    def __post_init__(self):
        run = np.flatnonzero(np.append(True, self.patterns[1:] != self.patterns[:-1]))
        self.first = np.concatenate([np.arange(a, b, GROUP) for a, b in zip(run, np.append(run[1:], len(self.patterns)), strict=True)])
        self.stop = np.append(self.first[1:], len(self.patterns))
        self.group_patterns = self.patterns[self.first]
        self.group_low, self.group_high = np.minimum.reduceat(self.low, self.first), np.maximum.reduceat(self.high, self.first)
        self.group_entries = np.add.reduceat(self.entries, self.first)

    def _opened(self, groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of groups, and their bounds."""
        leaves = np.concatenate([np.arange(self.first[g], self.stop[g]) for g in groups]) if len(groups) else np.zeros(0, np.int64)
        return leaves, _bounds(x, self.low[leaves], self.high[leaves])

    def nearest(self, x: np.ndarray, bits: int, n: int) -> np.ndarray:
        """Leaves of n entries or more, if so many share a label: of the first NEAR groups, or more, the first by shared labels, bound and middle."""
        shared = np.bitwise_count(self.group_patterns & bits)
        groups = np.flatnonzero(shared)
        score = shared[groups] * 2.0 + _bounds(x, self.group_low[groups], self.group_high[groups])  # a bound is 1 at most
        groups = groups[np.argsort(-score, kind="stable")]
        groups = groups[: max(NEAR, np.searchsorted(np.cumsum(self.group_entries[groups]), n) + 1)]
        leaves, bound = self._opened(groups, x)
        middle = similarities(x[None], (self.low[leaves] + self.high[leaves]) / 2)[0]
        leaves = leaves[np.lexsort((-middle, -bound, -np.bitwise_count(self.patterns[leaves] & bits).astype(int)))]
        return leaves[: np.searchsorted(np.cumsum(self.entries[leaves]), n) + 1]

    def reaching(self, x: np.ndarray, bits: int, rank: tuple[int, float, int] | None) -> np.ndarray:
        """The leaves that may hold an entry of this rank (shared labels, similarity, ordinal) or a better one; all that share a label without a rank."""
        shared = np.bitwise_count(self.group_patterns & bits)
        if rank is None:
            return np.flatnonzero(np.bitwise_count(self.patterns & bits))
        matched, similarity, ordinal = rank
        groups = np.flatnonzero(shared >= matched)
        groups = groups[(shared[groups] > matched) | (_bounds(x, self.group_low[groups], self.group_high[groups]) >= similarity)]
        leaves, bound = self._opened(groups, x)
        more = np.bitwise_count(self.patterns[leaves] & bits) > matched
        return leaves[more | (bound > similarity) | ((bound == similarity) & (self.least[leaves] <= ordinal))]


def _bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest similarity to x within each pair of bounds; a place that may be zero or not counts as is better."""
    return similarities(x[None], np.clip(x, low, high))[0] if len(low) else np.zeros(0)


def _ranged(batches):
    """entries with a key whose order keeps equal labels and zero places together, and near values within them."""
    for batch in batches:
        patterns = batch.column("pattern").to_numpy().astype(">u4")
        signatures = np.ascontiguousarray(batch.column("signature").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        upper = (signatures.view(np.int64) >> 31).astype(">u4")  # exponent and 21 bits: no value has a sign
        bits = np.unpackbits(upper.view(np.uint8).reshape(*signatures.shape, 4), axis=2)
        near = np.packbits(bits.transpose(0, 2, 1).reshape(batch.num_rows, -1), axis=1)
        key = np.hstack([patterns.view(np.uint8).reshape(-1, 4), np.packbits(signatures != 0, axis=1), near])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in key], pa.binary())], names=[*batch.schema.names, "range"])


def _leaf_rows(batches, size: int, kind: pa.DataType):
    """A row for each leaf of a partition's entries."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    kb = _in_leaves(pa.Table.from_batches(held).select(["entry_id", "ordinal", "pattern", "signature"]), size)
    n, step = len(kb.start), max(1, CELLS // max(1, size * kb.signatures.shape[1]))
    lists = lambda a, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), a)
    for first in range(0, n, step):
        at = slice(first, min(n, first + step))
        rows = slice(int(kb.start[at][0]), int(kb.stop[at][-1]))
        ends = np.append(0, np.cumsum(kb.stop[at] - kb.start[at]))
        width = kb.signatures.shape[1]
        whole = lambda a, width=width: lists(pa.array(a.reshape(-1)), np.arange(len(a) + 1) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(at.start, at.stop) + (TaskContext.get().partitionId() << 32)), pa.array(kb.patterns[at].astype(np.int32)), whole(kb.low[at]), whole(kb.high[at]), pa.array(kb.least[at]), pa.array(np.diff(ends)),
             lists(pa.array(kb.ids[rows].tolist(), kind), ends), lists(pa.array(kb.ordinals[rows]), ends), lists(pa.array(kb.signatures[rows].reshape(-1)), ends * width)],
            names=["leaf", "pattern", "low", "high", "least", "n", "ids", "ordinals", "signatures"],
        )


def _asking(batches, index: Index, k: int, ranked: bool):
    """leaf and question for each leaf that a question must meet: without ranks its nearest, else those that reach its rank."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signatures = np.array(batch.column("signature").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        bits, leaves = batch.column("pattern").to_pylist(), []
        ranks = batch.column("rank").to_pylist() if ranked else [None] * batch.num_rows
        for x, b, rank in zip(signatures, bits, ranks, strict=True):
            met = index.reaching(x, b, rank and (rank["matched"], rank["similarity"], rank["ordinal"])) if ranked else index.nearest(x, b, max(k, 2 * LEAF))
            leaves.append(index.leaf[met])
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(m) for m in leaves]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves)), *[c.take(at) for c in batch.columns]], names=["leaf", *batch.schema.names])


def _met(batches, k: int, kind: pa.DataType, width: int):
    """q and an entry (matched, similarity, ordinal, entry_id): of each leaf the first k of each of its questions, none below a question's rank."""
    for batch in batches:
        for row in range(batch.num_rows):
            of = lambda name, row=row: batch.column(name)[row].values
            signatures = of("signatures").to_numpy().reshape(-1, width)
            ordinals, ids, asked = of("ordinals").to_numpy(), of("ids"), of("asked")
            q, bits = asked.field("q").to_numpy(), asked.field("pattern").to_numpy()
            x = asked.field("signature").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            matched = np.bitwise_count(bits & batch.column("pattern")[row].as_py()).astype(np.int32)
            ranks = asked.field("rank") if "rank" in asked.type.names else None
            step, found = max(1, CELLS // len(ordinals)), []
            for first in range(0, len(q), step):
                part = slice(first, first + step)
                s = similarities(x[part], signatures)
                best = np.lexsort((np.broadcast_to(ordinals, s.shape), -s), axis=1)[:, :k]
                asker, entry = np.repeat(np.arange(len(s)), best.shape[1]), best.reshape(-1)
                found.append((asker + first, entry, s[asker, entry]))
            asker, entry, s = (np.concatenate(c) for c in zip(*found, strict=True))
            if ranks is not None:
                get = lambda f: ranks.field(f).fill_null(0).to_numpy(zero_copy_only=False)[asker]  # noqa: B023, E731
                some, same = ranks.is_valid().to_numpy(zero_copy_only=False)[asker], matched[asker] == get("matched")
                keep = ~some | (matched[asker] > get("matched")) | (same & ((s > get("similarity")) | ((s == get("similarity")) & (ordinals[entry] <= get("ordinal")))))
                asker, entry, s = asker[keep], entry[keep], s[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q[asker]), pa.array(matched[asker]), pa.array(s), pa.array(ordinals[entry]), ids.take(pa.array(entry))], names=["q", "matched", "similarity", "ordinal", "entry_id"])


def _in_slices(questions: DataFrame, entries: DataFrame, slices: int, size: int, width: int, k: int, kinds: str) -> DataFrame:
    """q, evidence of the questions (q, pattern, signature) that share a label with any entry."""
    spark, kind = questions.sparkSession, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds]
    ranged = entries.mapInArrow(_ranged, f"entry_id {kinds}, ordinal bigint, pattern int, signature array<double>, range binary").repartitionByRange(slices, "range")
    path = scratch_path(spark, "leaves")
    ranged.mapInArrow(lambda batches: _leaf_rows(batches, size, kind), f"leaf bigint, pattern int, low array<double>, high array<double>, least bigint, n bigint, ids array<{kinds}>, ordinals array<bigint>, signatures array<double>").write.parquet(path)
    leaves = spark.read.parquet(path)
    head = leaves.select("leaf", "pattern", "low", "high", "least", "n").orderBy("leaf").toArrow()
    whole = lambda c: head.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    plain = lambda c: head.column(c).to_numpy()
    index = spark.sparkContext.broadcast(Index(plain("leaf"), plain("pattern"), whole("low"), whole("high"), plain("least"), plain("n")))

    def met(asking: DataFrame, ranked: bool) -> DataFrame:
        kept = "q bigint, pattern int, signature array<double>" + (", rank struct<matched:int,similarity:double,ordinal:bigint>" if ranked else "")
        asking = asking.select("q", "pattern", "signature", *["rank"] * ranked).repartition(2 * spark.sparkContext.defaultParallelism)  # few bytes, much work
        pairs = asking.mapInArrow(lambda batches: _asking(batches, index.value, k, ranked), f"leaf bigint, {kept}")
        of_leaf = pairs.groupBy("leaf").agg(F.collect_list(F.struct(*[c for c in pairs.columns if c != "leaf"])).alias("asked"))
        rows = of_leaf.join(leaves.select("leaf", "pattern", "ids", "ordinals", "signatures"), "leaf")
        return rows.mapInArrow(lambda batches: _met(batches, k, kind, width), f"q bigint, matched int, similarity double, ordinal bigint, entry_id {kinds}")

    best = F.array_sort(F.collect_list(F.struct((-F.col("matched")).alias("m"), (-F.col("similarity")).alias("s"), "ordinal", "entry_id")))
    first = met(questions, False).groupBy("q").agg(best.alias("e"))
    rank = F.when(F.size("e") >= k, F.struct((-F.col("e")[k - 1]["m"]).alias("matched"), (-F.col("e")[k - 1]["s"]).alias("similarity"), F.col("e")[k - 1]["ordinal"].alias("ordinal")))
    path = scratch_path(spark, "ranks")
    questions.join(first.select("q", rank.alias("rank")), "q").write.parquet(path)
    found = met(spark.read.parquet(path), True).groupBy("q").agg(F.slice(best, 1, k).alias("e"))
    return found.select("q", F.transform("e", lambda e: F.struct(e["entry_id"].alias("entry_id"), (-e["m"]).alias("matched"), (-e["s"]).alias("similarity"), e["ordinal"].alias("ordinal"))).alias("evidence"))


def knowledge_base(rows: DataFrame, fixes: DataFrame, names: list[str], keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Entries from labelled rows: entry_id (benchmark_scenario_index), benchmark, scenario, dims (healthy if none), signature (keys with a
    value, in 4 places), fixes (of the dims, in their order), and source, if sources (benchmark, source) is given.

    rows: benchmark, scenario, idx (unique), a 0/1 column a dimension, and keys; fixes: dimension and further columns, a row a dimension.
    """
    on = F.array_compact(F.array(*[F.when(F.col(d) == 1, F.lit(d)) for d in names]))
    value = lambda c: F.col(c).cast("double")
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.when(~F.isnan(value(c)), F.floor(value(c) * 10000 + 0.5) / 10000).alias("value")) for c in keys]), lambda p: p["value"].isNotNull())
    out = rows.select(F.concat_ws("_", "benchmark", "scenario", F.col("idx").cast("string")).alias("entry_id"), "benchmark", "scenario", F.col("idx").alias("ordinal"), F.when(F.size(on) > 0, on).otherwise(F.array(F.lit("healthy"))).alias("dims"), F.map_from_entries(pairs).alias("signature"))
    table = {r["dimension"]: r for r in fixes.collect()}  # a row a dimension
    known = [d for d in names if d in table]
    of = lambda r: F.struct(*[F.lit(r[c]).alias(c) for c in fixes.columns])
    made = F.array_compact(F.array(*[F.when(F.array_contains("dims", d), of(table[d])) for d in known]))
    out = out.withColumn("fixes", made)
    return out if sources is None else out.join(sources, "benchmark", "left").select(*out.columns, "source")


def export(kb: DataFrame, path: str) -> None:
    """The entries as JSON lines, packed by gzip, below path: full, and a folder dim=<dimension> for each of an entry's dimensions below
    by_dim. The second is made from the first, so the entries are computed once."""
    kb.write.json(f"{path}/full", compression="gzip")
    full = kb.sparkSession.read.schema(kb.schema).json(f"{path}/full")
    full.withColumn("dim", F.explode("dims")).write.partitionBy("dim").json(f"{path}/by_dim", compression="gzip")


def diagnose(jobs: DataFrame, kb: DataFrame, fixes: DataFrame, names: list[str], keys: list[str], k: int = 3) -> DataFrame:
    """One result a job (job_id, dims, signature): status (healthy or bottlenecks), dims, evidence, and recommendations: for each
    dimension but healthy its fix and the ids of the evidence that has the dimension, in order. fixes: dimension, fix."""
    path = scratch_path(jobs.sparkSession, "found")
    retrieve(jobs, kb, names, keys, k).write.parquet(path)  # read twice
    found = jobs.sparkSession.read.parquet(path)
    table = {r["dimension"]: r["fix"] for r in fixes.collect()}  # a row a dimension
    own = kb.select("entry_id", F.col("dims").alias("entry_dims"))
    cited = found.select("job_id", F.posexplode("evidence").alias("place", "e")).select("job_id", "place", "e.entry_id").join(own, "entry_id")
    cited = cited.select("job_id", "place", "entry_id", F.explode("entry_dims").alias("dim")).groupBy("job_id", "dim").agg(F.array_sort(F.collect_list(F.struct("place", "entry_id"))).alias("c"))
    cited = cited.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.transform("c", lambda x: x["entry_id"].cast("string"))))).alias("cited"))
    fix = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    advice = F.transform(F.filter("dims", lambda d: d != "healthy"), lambda d: F.struct(d.alias("dimension"), F.try_element_at(fix, d).alias("fix"), F.coalesce(F.try_element_at(F.coalesce("cited", F.create_map().cast("map<string,array<string>>")), d), F.expr("cast(array() as array<string>)")).alias("citations")))
    out = jobs.select("job_id", "dims").join(found, "job_id").join(cited, "job_id", "left")
    return out.select("job_id", F.when(F.size(advice) > 0, "bottlenecks").otherwise("healthy").alias("status"), "dims", F.transform("evidence", lambda e: e.dropFields("ordinal")).alias("evidence"), advice.alias("recommendations"))
