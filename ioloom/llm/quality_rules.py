"""Quality rules: base counts of a text, then a calibrated logistic regression over hashed n-grams.

The model is fitted on SAMPLE_ROWS labelled rows at most (those first by a hash of the id): four in
five fit the weights, the fifth calibrates the score by Platt's logistic map. Every text is then
scored whole, in Arrow batches, and kept from a fixed probability of good quality on.

Defined results: null and empty texts have no words and so fail the base rules; very long texts are counted and
scored whole; labels that are null or not 0 or 1 are passed over; with no labels, or labels of one kind only
among the rows that fit, the base rules alone decide; with one kind only among those that calibrate, the score
stays as it is; repeated rows get equal results; an empty table gives no rows; columns other than those named are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import mapped_in_place
from ioloom.llm.linear import descend, sample, sigmoid
from ioloom.llm.ngrams import BLOCK_TEXTS, KINDS, linear_scores

SAMPLE_ROWS = 3000
#: One of so many sampled rows calibrates the score instead of fitting the weights.
CALIBRATION = 5
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * (linear_scores(texts, self.weights) + self.bias) + self.shift)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b) by Newton steps on Platt's smoothed targets."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, theta = np.stack([score, np.ones(len(score))], 1), np.array([1.0, 0.0])
    loss = lambda t: np.logaddexp(0, x @ t).sum() - target @ (x @ t)
    for _ in range(50):
        p = sigmoid(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("mark"))
    data = sample(docs, [(marked, size)], id_col, text_col, CALIBRATION)
    bad, good = data.sums(None, by_mark=True)
    if not bad.n or not good.n:
        data.discard()
        return None

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        now, _ = data.sums(w, b)
        return (now.x - good.x) / now.n, (now.up - good.n) / now.n

    w, b = descend(slope)
    z, y = data.held_scores(w, b)
    data.discard()
    return QualityModel(w.reshape(KINDS, -1).astype(np.float32), b, *(platt(z, y) if len(set(y.tolist())) == 2 else (1.0, 0.0)))


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(raw.count(s) for s in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)
        if n < 1 << 20:
            key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            key = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1][:-1] * n + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= again
            repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rows(batches, at: int, model: QualityModel | None, keep_from: float):
    """(batch, its texts' judgement columns) of each batch; at: the text's column."""
    for batch in (whole.slice(i, BLOCK_TEXTS) for whole in batches for i in range(0, whole.num_rows, BLOCK_TEXTS)):
        column = batch.column(at).fill_null("")
        texts, raws = column.to_pylist(), column.cast(pa.binary()).to_pylist()
        base = np.array([base_counts(t, r) for t, r in zip(texts, raws, strict=True)], np.int64).reshape(-1, 5)
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
        p = model.probability(texts) if model else np.ones(len(texts))
        yield batch, base, failed, ~failed & (p >= keep_from), p


def _judged(batches, model, keep_from):
    for batch, base, failed, kept, p in _rows(batches, 1, model, keep_from):
        columns = [batch.column(0), *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(kept), pa.array(p)]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *_NAMES, "base_failed", "kept", "probability"])


def _filtered(batches, at, model, keep_from):
    for batch, _, _, kept, _ in _rows(batches, at, model, keep_from):
        yield batch.filter(pa.array(kept, pa.bool_()))


def judge(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five counts, base_failed, kept, probability for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in _NAMES) + ", base_failed boolean, kept boolean, probability double"
    return docs.select(id_col, text_col).mapInArrow(lambda batches: _judged(batches, shared.value, keep_from), schema)


def keep_good(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, columns as they were."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    return mapped_in_place(docs, lambda batches: _filtered(batches, at, shared.value, keep_from))
