"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within RADIUS bits are linked. Each of the 64 bits is given a vector of RADIUS + 1 bits;
table v, for each of the 2**(RADIUS + 1) - 1 non-zero v, keeps the bits whose vector has odd
inner product with v. The vectors of any RADIUS differing bits miss some v altogether, so every pair within the
radius agrees in some table: no link is lost.

Equal fingerprints are one node. Only nodes that share a table's masked value with another are
looked at. Within such a bucket a task makes a spanning forest of the links, not all pairs; forests
have the components of all links. A bucket of more than BUCKET nodes is dealt by RADIUS + 1 blocks of the bits in which
its nodes may differ: at most RADIUS bits differ, so some block is equal. What is too large still is cut into slices, and each pair of
slices is looked at by a task. Components then follow by alternating star contractions, each round written to the
shared folder.

A node is named by the row that would stand for it (smallest id, then smallest text hash) before its fingerprint, so
the smallest name in a component carries the component's id, and the row to keep, without another grouping.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; very long texts are read
whole; null ids take part and have the component of their group (null if no id in it is known); repeated rows
are in one component; an empty table gives no rows; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import HOT_KEYS, HOT_ROWS, discarded, quoted, salted_join, written

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Nodes of one bucket that a task links directly; larger buckets are divided first.
BUCKET = 4096


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2**(radius + 1) - 1 covering masks; bit i has the vector 1 + i mod (2**(radius + 1) - 1)."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint_of(raw: bytes | None) -> int:
    """64 majority bits over the XXH64 of all shingles of a text in UTF-8; 0 without words."""
    import xxhash

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    h = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    # Byte columns are counted by value; a value's bits then give the bit counts.
    set_bits = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint_of(t) for t in batch.column(3).cast(pa.binary()).to_pylist()], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["id", "text_hash", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash (of the text as it is), row (a number of the row), fp (the fingerprint as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("body"))
    return given.mapInArrow(_fingerprints, f"id {kind}, text_hash bigint, row bigint, fp bigint")


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (root, member) that join each component of the values within the radius."""
    left, links = values, []
    while len(left) > 1:
        root, front, rest = left[0], left[:1], left[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front:
                near |= np.bitwise_count(rest ^ x) <= radius
            front, rest = rest[near], rest[~near]
            links += [(root, x) for x in front]
        left = rest
    return links


def _linked(batches, radius: int):
    """Batches of (table, key, fp) sorted by table and key -> links; a bucket is held across batches."""
    held = np.zeros((0, 3), np.int64)

    def links(rows: np.ndarray):
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        out = [x for bucket in np.split(rows[:, 2].astype(np.uint64), cut) if len(bucket) > 1 for x in _forest(bucket, radius)]
        pairs = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)])
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0]
        held = rows[last:]
        if last:
            yield links(rows[:last])
    if len(held):
        yield links(held)


def _within(rows: DataFrame, radius: int) -> DataFrame:
    """Links of the buckets (t, key) of rows (t, key, fp)."""
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda batches: _linked(batches, radius), "a bigint, b bigint")


_signed = lambda m: m - (1 << 64) if m >> 63 else m


def _shared(keys: DataFrame) -> DataFrame:
    """(t, key, n) of the buckets of more than one node, most having one."""
    return written(keys.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp of nodes that have the components of all pairs within the radius."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks(radius))])
    keys = nodes.select("fp", F.explode(table).alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    shared = _shared(keys)
    found = _within(keys.join(shared.filter(F.col("n") <= BUCKET), ["t", "key"]).select("t", "key", "fp"), radius)
    large = shared.filter(F.col("n") > BUCKET)
    if large.limit(1).count():
        # Within a large bucket the unmasked bits are dealt into radius + 1 blocks, of which some block is equal.
        blocks = [[sum(1 << b for b in [i for i in range(64) if not m >> i & 1][k :: radius + 1]) for k in range(radius + 1)] for m in masks(radius)]
        block = F.element_at(F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(x)).alias("x")) for k, x in enumerate(row)]) for row in blocks]), F.col("t") + 1)
        dealt = keys.join(large.select("t", "key"), ["t", "key"]).select("t", "key", "fp", F.explode(block).alias("b"))
        dealt = dealt.select((F.col("t") + 64 * (1 + F.col("b.k"))).alias("t"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("b.x"))).alias("key"), "fp")
        known = dealt.join(_shared(dealt), ["t", "key"])
        # What is large still is cut into slices, and every pair of slices is a bucket.
        slices = F.when(F.col("n") > BUCKET, F.ceil(2 * F.col("n") / BUCKET)).otherwise(1).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        pairs = known.select("t", "key", "fp", slices.alias("s")).select("t", "key", "fp", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"))
        cut = pairs.select("t", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
        found = found.unionAll(_within(cut, radius))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b) of any type with an order, root being the smallest node reachable.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones; the
    round's edges are written to the shared folder, which cuts lineage. Neighbours are never gathered: a node's
    smallest neighbour is an aggregate that is joined back, a hub's rows being spread.
    """
    def star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        joined = salted_join(pairs, low, "u", "n", "v", total)
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionAll(low.filter("u > m").select("u", F.col("m").alias("v"))).distinct()

    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen, total = None, 2 * current.count()
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        middle = written(star(both, True, total), "edges")
        discarded(current)
        current = written(star(middle, False, total), "edges")
        discarded(middle)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Fingerprint rows of docs; (fp, n rows, name, root) of each distinct one; the number of rows.

    A name is (id unknown, id, text hash, fp); root is the smallest name in the component.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    name = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash"))
    nodes = rows.groupBy("fp").agg(F.count("*").alias("n"), name.alias("k"))
    nodes = written(nodes.select("fp", "n", F.struct("k.unknown", "k.id", "k.text_hash", "fp").alias("name")), "nodes")
    named = lambda end: nodes.select(F.col("fp").alias(end), F.col("name").alias(f"{end}_name"))
    edges = links(nodes).join(named("a"), "a").join(named("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    joined = components(edges).select(F.col("node.fp").alias("fp"), "root")
    return rows, nodes.join(joined, "fp", "left").select("fp", "n", "name", F.coalesce("root", "name").alias("root")), rows.count()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, fingerprint (16 hex digits), component_id (smallest id reachable) for every document."""
    rows, rooted, total = _rooted(docs, id_col, text_col)
    out = salted_join(rows, rooted.select("fp", "n", F.col("root.id").alias("component_id")), "fp", "n", "row", total)
    return out.select(F.col("id").alias(id_col), "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id, of equal ids the smallest text hash.

    Rows that agree in id and text are one. A group without any known id keeps its smallest text hash.
    Texts are shuffled once, by the kept keys; rows of a key that many rows repeat are united before that.
    """
    rows, rooted, total = _rooted(docs, id_col, text_col)
    kept = rooted.filter("name = root").select(F.coalesce(F.col("root.id").cast("string"), F.lit("")).alias("i"), F.col("root.unknown").alias("u"), F.col("root.text_hash").alias("h"))
    key = ["i", "u", "h"]
    marked = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(id_col).isNull().alias("u"), F.xxhash64(text_col).alias("h"))
    counted = rows.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("i"), F.col("id").isNull().alias("u"), F.col("text_hash").alias("h")).agg(F.count("*").alias("n"))
    hot = written(counted.filter(F.col("n") > max(HOT_ROWS, -(-total // HOT_KEYS))).select(*key), "repeated")  # HOT_KEYS rows at most
    if hot.limit(1).count():
        repeated = marked.join(F.broadcast(hot), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row", *key)
        marked = marked.join(F.broadcast(hot), key, "left_anti").unionByName(repeated)
    return marked.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
