"""Random forests of all labels, grown level by level side by side.

Rows are binned once, a byte a feature, and dealt evenly. A level of all trees of all labels is one job: a task leads its rows down the
trees that are there and counts bins by class at the nodes to split, counts meet by tree, and the driver gets a split a node. A row's
place in the trees' bags comes from its key, so neither the partitions nor a task's second run change the forests. The rules are Spark
ML's: bags by Poisson's law, the root of the features' number at a node, 32 bins, Gini gain, leaves of one prediction pruned.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.operators.many_fits import _bytes, _of_bytes
from ioloom.operators.models import MAX_WEIGHT, source_weight
from ioloom.sources.scratch import scratch_path

BINS, SEED = 32, 42
#: Rows, at most about so many, from which edges of bins come, as in Spark ML; rows that a task counts at once, and that a file holds.
EDGE_ROWS, BLOCK, FILE = 10_000, 131_072, 400_000

#: How often a row is in a bag, by 16 random bits.
TIMES = np.searchsorted(np.cumsum([np.exp(-1) / factorial(k) for k in range(9)]), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between distinct values: all of them, or those at which the values so far come nearest to the next share."""
    v, n = np.unique(values[np.isfinite(values)], return_counts=True)
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) < bins:
        return middle
    share = n.sum() / bins
    cuts, below, target = [], n[0], share
    for m, more in zip(middle, n[1:], strict=True):
        if abs(below - target) < abs(below + more - target):
            cuts.append(m)
            target += share
        below += more
    return np.array(cuts)


def bags(key: np.ndarray, trees: int) -> list[np.ndarray]:
    """By tree, how often each row is in its bag; key: hashes of the rows' keys."""
    out: list[np.ndarray] = []
    for i in range(0, trees, 4):  # splitmix64 of key and i
        z = key.view(np.uint64) + np.uint64((i // 4 + 1 + SEED) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out += list(TIMES[(z ^ (z >> np.uint64(31))).view(np.uint16).reshape(-1, 4)].T)
    return out[:trees]


def _binned(batches, cuts: list[np.ndarray]):
    """h, s, y and the features as bytes x of their bins."""
    for batch in batches:
        x = np.empty((batch.num_rows, len(cuts)), np.uint8)
        for i, c in enumerate(cuts):
            x[:, i] = np.searchsorted(c, batch.column(3 + i).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], _bytes(x, batch.num_rows)], names=["h", "s", "y", "x"])


def packed(rows: DataFrame, n: int, features: list[str]) -> tuple[DataFrame, list[np.ndarray]]:
    """rows (h, s, y, features) with binned features, written once; and the edges of the bins."""
    spark, share = rows.sparkSession, min(1.0, EDGE_ROWS / max(n, 1))
    some = rows.filter((F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else F.lit(True)).select(*features).toArrow()
    cuts = [edges(some.column(f).to_numpy()) for f in features]
    path, cores = scratch_path(spark, "binned"), spark.sparkContext.defaultParallelism
    made = rows.mapInArrow(lambda batches: _binned(batches, cuts), "h long, s double, y long, x binary")
    made.repartition(cores * -(-n // (cores * FILE)) or 1, "h").write.parquet(path)
    return spark.read.parquet(path), cuts


class Tree:
    """Nodes are numbered 1 and, under i, 2i and 2i + 1. splits: node -> feature, last bin to the left, gain, weight; said: node -> class;
    front: nodes to split at this level, with the features that each sees."""

    def __init__(self, place: int, n_features: int):
        self.place, self.n_features = place, n_features
        self.splits: dict[int, tuple[int, int, float, float]] = {}
        self.said: dict[int, int] = {1: 0}
        self.front = self._seen([1])

    def _seen(self, nodes: list[int]) -> dict[int, np.ndarray]:
        k = int(np.ceil(np.sqrt(self.n_features)))
        return {i: np.random.default_rng([SEED, self.place, i]).choice(self.n_features, k, replace=False) for i in nodes}

    def split(self, found: np.ndarray, last: bool):
        """found: by node of the front what best_splits tells; last: the new nodes stay leaves."""
        new = []
        for (i, seen), (at, cut, gain, l0, l1, r0, r1) in zip(self.front.items(), found, strict=True):
            self.said[i] = int(l1 + r1 > l0 + r0)
            if gain > 0:
                self.splits[i] = int(seen[int(at)]), int(cut), gain, l0 + l1 + r0 + r1
                self.said[2 * i], self.said[2 * i + 1] = int(l1 > l0), int(r1 > r0)
                new += [c for c, pure in ((2 * i, not l0 or not l1), (2 * i + 1, not r0 or not r1)) if not pure]
        self.front = {} if last else self._seen(new)

    def importances(self) -> np.ndarray:
        """Gain times weight by feature, adding up to 1; splits into leaves that say the same are pruned."""
        out = np.zeros(self.n_features)

        def leaf(i: int) -> int | None:
            if i not in self.splits:
                return self.said[i]
            left, right = leaf(2 * i), leaf(2 * i + 1)
            if left is not None and left == right:
                return left
            feature, _, gain, weight = self.splits[i]
            out[feature] += gain * weight
            return None

        leaf(1)
        return out / (out.sum() or 1.0)


def _blocks(batches, n_features: int):
    """h, s, y and x with a line a feature, BLOCK rows or more at a time."""
    held, n = [], 0

    def block():
        h, s, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        return h, s, y, np.ascontiguousarray(np.concatenate([_of_bytes(b.column(3), "u1", n_features) for b in held]).T)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield block()
            held, n = [], 0
    if n:
        yield block()


def _counts(batches, grown: dict[tuple[int, int], Tree], n_features: int):
    """By label and tree the weights of rows at the nodes of the front: node, feature that it sees, class, bin."""
    out = {k: np.zeros((len(t.front), len(next(iter(t.front.values()))), 2 * BINS)) for k, t in grown.items()}
    ways = {k: {i >> up for i in t.front for up in range(1, i.bit_length())} for k, t in grown.items()}
    for h, s, y, x in _blocks(batches, n_features):
        times = bags(h, max(t for _, t in grown) + 1)
        mine = {d: ((y >> d & 1) * BINS).astype(np.uint8) for d in {d for d, _ in grown}}
        for t in sorted({t for _, t in grown}):
            some = np.flatnonzero(times[t])
            weight = times[t][some] * s[some]
            for d in sorted(d for d, other in grown if other == t):
                tree, sums = grown[d, t], out[d, t]
                slot = {i: k for k, i in enumerate(tree.front)}
                todo = [(1, some, weight)]
                while todo:
                    i, at, w = todo.pop()
                    if i in slot:
                        label = mine[d][at]
                        for j, f in enumerate(tree.front[i]):
                            sums[slot[i], j] += np.bincount(x[f][at] + label, w, 2 * BINS)
                    elif i in ways[d, t]:
                        f, cut = tree.splits[i][:2]
                        left = x[f][at] <= cut
                        todo += [(2 * i, at[left], w[left]), (2 * i + 1, at[~left], w[~left])]
    for (d, t), sums in out.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([t], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["d", "t", "v"])


def best_splits(sums: np.ndarray, positive: float) -> np.ndarray:
    """nodes x (place of the feature, last bin to the left, gain, weights left of class 0 and 1, right of 0 and 1), gain 0 without a split.

    sums: nodes, features, class and bin; positive: weight of class 1.
    """
    by_class, weight = sums.reshape(*sums.shape[:2], 2, BINS), np.array([1.0, positive])[:, None]
    left, whole = np.cumsum(by_class, axis=3)[..., :-1], by_class[:, :1].sum(axis=3, keepdims=True)
    right = whole - left
    right[right < whole * 1e-12] = 0.0  # what subtraction leaves of nothing
    left, right, whole = left * weight, right * weight, whole * weight
    impure = lambda c: (n := c.sum(axis=2)) - (c * c).sum(axis=2) / np.maximum(n, 1e-300)  # noqa: E731  Gini impurity times weight
    total = whole.sum(axis=2)
    gain = np.where((left.sum(axis=2) > 0) & (right.sum(axis=2) > 0), (impure(whole) - impure(left) - impure(right)) / np.maximum(total, 1e-300), 0.0)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    at, cut, node = best // (BINS - 1), best % (BINS - 1), np.arange(len(gain))
    return np.stack([at, cut, np.where(gain[node, at, cut] > 1e-15, gain[node, at, cut], 0.0), *left[node, at, :, cut].T, *right[node, at, :, cut].T], axis=1)


def _chosen(table: pa.Table, fronts: dict[tuple[int, int], int], weights: list[float]) -> pa.Table:
    d, t = table.column("d")[0].as_py(), table.column("t")[0].as_py()
    total = None
    for v in table.column("v"):
        part = np.frombuffer(v.as_buffer(), "<f8")
        total = part.copy() if total is None else np.add(total, part, out=total)
    best = best_splits(total.reshape(fronts[d, t], -1, 2 * BINS), weights[d])
    return pa.table({"d": pa.array([d], pa.int32()), "t": pa.array([t], pa.int32()), "v": pa.array([best.tobytes()], pa.binary())})


def fit(train: DataFrame, key: str, features: list[str], dims: list[str], trees: int = 20, depth: int = 6) -> dict[str, list[Tree]]:
    """The trees of each dimension that has both classes; weights are class weight times source weight, as models.fit has them."""
    source = source_weight() if "label_source" in train.columns else F.lit(1.0)
    counts = train.agg(F.count("*").alias("n"), *[F.sum(F.col(d).cast("long")).alias(d) for d in dims]).first()
    n, positive = counts["n"], [counts[d] or 0 for d in dims]
    able = [i for i, p in enumerate(positive) if 0 < p < n]
    if not able:
        return {}
    weights = [min((n - p) / max(p, 1), MAX_WEIGHT) for p in positive]
    y = sum((F.coalesce(F.col(d).cast("long"), F.lit(0)) * (1 << i) for i, d in enumerate(dims)), F.lit(0).cast("long"))
    rows = train.select(F.xxhash64(key).alias("h"), source.cast("double").alias("s"), y.alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    binned, _ = packed(rows, n, features)
    context, width = binned.sparkSession.sparkContext, len(features)
    out = {(d, t): Tree(t, width) for d in able for t in range(trees)}
    for level in range(depth):
        open_ones = {k: t for k, t in out.items() if t.front}
        if not open_ones:
            break
        shared, fronts = context.broadcast(open_ones), {k: len(t.front) for k, t in open_ones.items()}
        sums = binned.select("h", "s", "y", "x").mapInArrow(lambda batches, shared=shared: _counts(batches, shared.value, width), "d int, t int, v binary")
        found = sums.groupBy("d", "t").applyInArrow(lambda table: _chosen(table, fronts, weights), "d int, t int, v binary").toArrow()  # a split a node
        for d, t, v in zip(*(found.column(c).to_pylist() for c in ("d", "t", "v")), strict=True):
            out[d, t].split(np.frombuffer(v, "<f8").reshape(-1, 7), level + 1 == depth)
        shared.destroy()
    return {dims[d]: [out[d, t] for t in range(trees)] for d in able}


def importances(fitted: dict[str, list[Tree]]) -> dict[str, np.ndarray]:
    """By dimension the mean importances of its trees, adding up to 1."""
    sums = {d: np.sum([t.importances() for t in trees], axis=0) for d, trees in fitted.items()}
    return {d: v / (v.sum() or 1.0) for d, v in sums.items()}
