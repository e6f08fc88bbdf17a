"""Exact percentiles of many columns at once, by column in Arrow batches.

A batch of rows becomes a row a column: its distinct values in order and how often each occurs, packed. What is asked of a column then reads
those only. A rank is found in narrowing steps: values count by slots of their bit patterns (which rise as values do), the slot that holds the rank is cut
into even slots of its own, and so on until a slot holds one value. Tasks return a few hundred slots a column, so no task and
no driver holds a column, and no value is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots that a slot is cut into, rows of a slot of which each value is a slot, and slots that a task holds before equal ones are added.
SLOTS, FEW, HELD = 1024, 4096, 200_000
_ALL = np.iinfo(np.int64)
_PACKED = "c int, n bigint, size int, v binary, k binary"
#: Values and how often each occurs.
Counted = tuple[np.ndarray, np.ndarray]


def _keys(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles that hold neither -0.0 nor NaN but the usual one, which is last."""
    bits = v.view(np.int64)
    return bits ^ ((bits >> 63) & _ALL.max)


def _value(key: int) -> float:
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> 63) & _ALL.max)).view(float)[0])


def _usual(v: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(v), np.nan, v + 0.0)


def _packed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    pack = lambda a: pa.compress(a.tobytes(), codec="lz4", asbytes=True)
    for batch in batches:
        flat = batch.column(0).flatten()
        values = np.ascontiguousarray(flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, n).T)
        there = np.ascontiguousarray(flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n).T)
        rows = []
        for c in range(n):
            v, times = np.unique(_usual(values[c][there[c]]), return_counts=True)
            rows.append((len(values[c]), len(v), pack(v), pack(times.astype(np.int32))))
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]], names=["c", "n", "size", "v", "k"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Counted]]:
    """A column, its rows in a batch, and its values there in order and how often each occurs."""
    for batch in batches:
        for c, n, size, v, k in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            yield c, n, (np.frombuffer(pa.decompress(v, 8 * size, "lz4", asbytes=True), float), np.frombuffer(pa.decompress(k, 4 * size, "lz4", asbytes=True), np.int32).astype(np.int64))


def _away(counted: Counted, middle: float) -> Counted:
    v = _usual(np.abs(counted[0] - middle))
    order = np.argsort(v, kind="stable")
    return v[order], counted[1][order]


def _summed(slots: list[np.ndarray]) -> np.ndarray:
    """Equal column, interval and slot (rows 0 to 2) once: counts added, least and greatest key."""
    a = np.concatenate(slots, axis=1)
    a = a[:, np.lexsort((a[2], a[1], a[0]))]
    first = np.flatnonzero(np.append(True, (a[:3, 1:] != a[:3, :-1]).any(axis=0)))
    return np.vstack([a[:3, first], np.add.reduceat(a[3], first), np.minimum.reduceat(a[4], first), np.maximum.reduceat(a[5], first)])


def _slots(batches, wanted: dict[int, list[tuple]], middles: dict[int, float] | None) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for c, _, counted in _unpacked(batches):
        if c not in wanted or not len(counted[0]):
            continue
        v, times = counted if middles is None else _away(counted, middles[c])
        keys = _keys(v)
        for j, (low, high, width) in enumerate(wanted[c]):
            a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            if a == b:
                continue
            mine = keys[a:b]
            slot = (mine - low) // width if width else mine >> 48
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            last = np.append(first[1:], len(slot)) - 1
            found.append(np.vstack([np.full(len(first), c), np.full(len(first), j), slot[first], np.add.reduceat(times[a:b], first), mine[first], mine[last]]))
            held += len(first)
        if held > HELD:
            found = [_summed(found)]
            held = found[0].shape[1] // 2  # what can't be added is not tried for every row
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(found)], names=["c", "j", "slot", "n", "low", "high"])


class Columns:
    """The columns of a table, packed and kept on disk until they are released."""

    def __init__(self, df: DataFrame, columns: list[str]):
        n = len(columns)
        self.columns = columns
        self.held = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).mapInArrow(lambda batches: _packed(batches, n), _PACKED).persist(StorageLevel.DISK_ONLY)

    def release(self) -> None:
        self.held.unpersist()

    def _read(self, chosen: list[int]) -> DataFrame:
        return self.held if len(chosen) == len(self.columns) else self.held.filter(F.col("c").isin(chosen))

    def rows(self) -> int:
        return self.held.filter("c = 0").agg(F.sum("n")).first()[0] or 0

    def percentiles(self, shares: list[float], middles: dict[int, float] | None = None) -> dict[int, list[float]]:
        """The exact interpolated percentiles of each column that has a value; with middles, of the values' distances from them."""
        wanted = {c: [(_ALL.min, _ALL.max, 0)] for c in (range(len(self.columns)) if middles is None else middles)}
        sought: dict[int, dict[int, tuple[int, int]] | None] = dict.fromkeys(wanted)  # of each rank its interval and the rank in it
        keys: dict[int, dict[int, int]] = {c: {} for c in wanted}
        last: dict[int, int] = {}
        while wanted:
            run = lambda batches, wanted=wanted: _slots(batches, wanted, middles)
            slots = self._read(sorted(wanted)).mapInArrow(run, "c bigint, j bigint, slot bigint, n bigint, low bigint, high bigint")
            got = slots.groupBy("c", "j", "slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
            table = np.vstack([got.column(x).to_numpy() for x in ("c", "j", "slot", "n", "low", "high")])
            table = table[:, np.lexsort((table[2], table[1], table[0]))]
            again = {}
            for c in wanted:
                mine = table[:, table[0] == c]
                if not mine.shape[1]:
                    continue
                if sought[c] is None:
                    last[c] = int(mine[3].sum()) - 1
                    sought[c] = {cut(last[c] * s): (0, cut(last[c] * s)) for s in shares for cut in (math.floor, math.ceil)}
                opened, deeper = [], {}
                for rank, (j, place) in sought[c].items():
                    part = mine[:, mine[1] == j]
                    ends = np.cumsum(part[3])
                    at = int(np.searchsorted(ends, place, "right"))
                    low, high, n = int(part[4, at]), int(part[5, at]), int(part[3, at])
                    if low == high:
                        keys[c][rank] = low
                        continue
                    slot = (low, high, 1 if n <= FEW else (high - low) // SLOTS + 1)
                    if slot not in opened:
                        opened.append(slot)
                    deeper[rank] = (opened.index(slot), place - int(ends[at]) + n)
                sought[c] = deeper
                if opened:
                    again[c] = opened
            wanted = again
        return {c: [_between(keys[c], last[c] * s) for s in shares] for c in last}

    def moments(self, chosen: list[int]) -> dict[int, tuple[int, float, float]]:
        """Count, mean and standard deviation (NaN of one value) of the chosen columns that have a value."""

        def run(batches):
            sums: dict[int, tuple] = {}
            for c, _, (v, times) in _unpacked(batches):
                if c in wanted and len(v):
                    mean = float((v * times).sum() / times.sum())
                    sums[c] = _joined(sums.get(c, (0, 0.0, 0.0)), (int(times.sum()), mean, float((times * (v - mean) ** 2).sum())))
            if sums:
                yield _rows([(c, *x) for c, x in sums.items()], "c n mean squares")

        wanted, out = set(chosen), {}
        for c, *part in zip(*self._read(chosen).mapInArrow(run, "c bigint, n bigint, mean double, squares double").toArrow().to_pydict().values(), strict=True):
            out[c] = _joined(out.get(c, (0, 0.0, 0.0)), tuple(part))
        return {c: (n, mean, math.sqrt(squares / (n - 1)) if n > 1 else math.nan) for c, (n, mean, squares) in out.items()}

    def shares(self, limits: dict[int, tuple[float, float, float]]) -> dict[int, float]:
        """Of each column with limits (middle, scale, z): the share of its values that lie over z scales from the middle, NaN being far."""

        def run(batches):
            sums: dict[int, tuple] = {}
            for c, _, (v, times) in _unpacked(batches):
                if c in limits and len(v):
                    middle, scale, z = limits[c]
                    far, n = sums.get(c, (0, 0))
                    sums[c] = (far + int(times[~(np.abs(v - middle) / scale <= z)].sum()), n + int(times.sum()))
            if sums:
                yield _rows([(c, *x) for c, x in sums.items()], "c far n")

        got = self._read(sorted(limits)).mapInArrow(run, "c bigint, far bigint, n bigint").groupBy("c").agg(F.sum("far"), F.sum("n")).collect()
        return {c: far / n for c, far, n in got}


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names.split())


def _joined(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squares about it, of two parts that have them."""
    n, gap = a[0] + b[0], b[1] - a[1]
    if not a[0]:
        return b
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _between(keys: dict[int, int], at: float) -> float:
    low, high = keys[math.floor(at)], keys[math.ceil(at)]
    if low == high:
        return _value(low)
    return (math.ceil(at) - at) * _value(low) + (at - math.floor(at)) * _value(high)

