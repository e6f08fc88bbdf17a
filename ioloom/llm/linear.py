"""Fitting linear models on a bounded sample of hashed texts, the sums of each step being Spark's.

The sample's texts are chosen by key alone, turned into features where they lie and written to the
shared folder. A step broadcasts the weights; every task returns the sums of its rows' gradients, a
vector of fixed size, so what reaches the driver depends neither on the texts' lengths nor on their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import discarded, written
from ioloom.llm.ngrams import BITS, KINDS, sparse_features

STEPS, RATE, DECAY = 100, 0.4, 1e-5
SIZE = KINDS << BITS
#: Files of a featurised sample, hence vectors a step that reach the driver at most.
PARTS = 8
#: Texts that a task holds as features at once.
ROWS = 64


def _featurised(batches):
    """(body, mark, held) -> distinct places and their values, each as bytes, with mark and held."""
    for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
        places, values = [], []
        for p, v in sparse_features([t or "" for t in batch.column(0).to_pylist()]):
            places.append(p.astype("<i4").tobytes())
            values.append(v.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(values, pa.binary()), batch.column(1), batch.column(2)], names=["places", "v", "mark", "held"])


def _blocks(batches):
    """(places, values, features of each row, mark, held) of ROWS rows at a time. Every row has features."""
    for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
        places, v = (batch.column(i).to_pylist() for i in (0, 1))
        counts = np.array([len(p) // 4 for p in places], np.int64)
        yield np.frombuffer(b"".join(places), "<i4"), np.frombuffer(b"".join(v), "<f4"), counts, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)


def _scores(places, v, counts, w, b):
    return np.add.reduceat(v * w[places], np.cumsum(counts) - counts) + b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _sums(batches, w: np.ndarray | None, b: float, by_mark: bool):
    """Over the task's rows that aren't held, in all or by mark: the number of rows, the sums of
    s(z), of log(1 + e^z) and of s(z) x, where s is the sigmoid of the score z, or 1 without weights."""
    groups = 2 if by_mark else 1
    few, x = np.zeros((groups, 3)), np.zeros((groups, SIZE))
    for places, v, counts, mark, held in _blocks(batches):
        z = _scores(places, v, counts, w, b) if w is not None else None
        up = sigmoid(z) if w is not None else np.ones(len(counts))
        loss = np.logaddexp(0, z) if w is not None else np.zeros(len(counts))
        for k in range(groups):
            mine = ~held & (mark == k) if by_mark else ~held
            if mine.any():
                few[k] += mine.sum(), up[mine].sum(), loss[mine].sum()
                x[k] += np.bincount(places, v * np.repeat(np.where(mine, up, 0), counts), minlength=SIZE)
    at = [np.flatnonzero(row) for row in x]
    columns = [pa.array(range(groups), pa.int32()), *[pa.array([c.tobytes() for c in cs], pa.binary()) for cs in (few, [i.astype("<i4") for i in at], [row[i].astype("<f4") for row, i in zip(x, at, strict=True)])]]
    yield pa.RecordBatch.from_arrays(columns, names=["k", "few", "places", "x"])


def _held_scores(batches, w: np.ndarray, b: float):
    for places, v, counts, mark, held in _blocks(batches):
        z = _scores(places, v, counts, w, b)
        yield pa.RecordBatch.from_arrays([pa.array(z[held]), pa.array(mark[held], pa.int32())], names=["z", "mark"])


class Sums:
    """n, up = sum of s(z), loss and x = sum of s(z) x of a group of rows."""

    def __init__(self):
        self.n, self.up, self.loss, self.x = 0.0, 0.0, 0.0, np.zeros(SIZE)


class Sample:
    """A featurised sample in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sums(self, w: np.ndarray | None, b: float = 0.0, by_mark: bool = False) -> list[Sums]:
        """The Sums of marks 0 and 1, or of all rows and an empty group."""
        shared = self.rows.sparkSession.sparkContext.broadcast((None if w is None else w.astype(np.float32), b))
        out = [Sums(), Sums()]
        for r in self.rows.mapInArrow(lambda batches: _sums(batches, *shared.value, by_mark), "k int, few binary, places binary, x binary").toArrow().to_pylist():
            few, s = np.frombuffer(r["few"]), out[r["k"]]
            s.n, s.up, s.loss = s.n + few[0], s.up + few[1], s.loss + few[2]
            s.x[np.frombuffer(r["places"], "<i4")] += np.frombuffer(r["x"], "<f4")
        shared.destroy()
        return out

    def held_scores(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(score, mark) of the held rows, which are a share of the bounded sample."""
        shared = self.rows.sparkSession.sparkContext.broadcast((w, b))
        got = self.rows.mapInArrow(lambda batches: _held_scores(batches, *shared.value), "z double, mark int").toArrow()
        shared.destroy()
        order = np.lexsort((got.column("mark").to_numpy(), got.column("z").to_numpy()))
        return got.column("z").to_numpy()[order], got.column("mark").to_numpy()[order]

    def discard(self) -> None:
        discarded(self.rows)


def sample(docs: DataFrame, parts: list[tuple[DataFrame, int]], id_col: str, text_col: str, held_share: int = 0) -> Sample:
    """The featurised texts of the first size rows of each of parts, (marked, size), marked having id and mark.

    Rows come first by a hash of the id; rows that agree in id, text and mark are one. Only keys are ordered: the
    chosen ids, then the chosen (id, text hash) pairs, size at most, are broadcast to the scan of docs.
    One of held_share rows (0: none) is held out by another hash of its id.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("body"))
    order = [F.xxhash64("id"), F.col("id"), F.col("h")]
    picks = []
    for marked, size in parts:
        ids = marked.filter("mark is not null").select(F.col("id"), F.col("mark").cast("int").alias("mark")).distinct().orderBy(F.xxhash64("id"), "id", "mark").limit(size)
        picks.append(keyed.select("id", "h").join(F.broadcast(ids), "id").distinct().orderBy(*order, "mark").limit(size))
    chosen = reduce(DataFrame.unionAll, picks)
    rows = keyed.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "mark").agg(F.first("body").alias("body"))
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(held_share)) == 0 if held_share else F.lit(False)
    rows = rows.repartition(PARTS, "id", "h").sortWithinPartitions(*order, "mark").select("body", "mark", held.alias("held"))
    return Sample(written(rows.mapInArrow(_featurised, "places binary, v binary, mark int, held boolean"), "sample"))


def descend(slope: Callable[[np.ndarray, float], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Adam over whole sums. slope: weights, bias -> the risk's derivatives in both."""
    w, b = np.zeros(SIZE), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        g, gb = slope(w, b)
        g = g + DECAY * w
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1))) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        b -= rate * mb / (np.sqrt(sb / (1 - 0.99**t)) + 1e-9)
    return w, float(b)
