"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; unlabelled rows are those that labels lists, whatever their
label. With class prior p and logistic losses, the risk is p R+(positives) + max(0, R-(unlabelled) -
p R-(positives)); where the second term would be negative, a step raises it instead. Labels of held-out
rows (crc32 of the id modulo 3 is 1) are never read. The prior is estimated as the share of 1 over all
other labelled rows, and kept from 0.01 to 0.99 so that both classes have weight; the 0 labels serve nothing
else. That the unlabelled rows come from labels makes the prior theirs.

The fit takes POSITIVES and UNLABELLED rows of labels at most, those first by a hash of the id. Every whole text is scored.
Defined results: null and empty texts are scored as empty, very long ones whole; null labels are passed over;
without positives every score is the prior, 0.5 with no labels at all; repeated rows get equal scores; an empty
table gives no rows; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ioloom.llm.linear import Sums, descend, sample, sigmoid
from ioloom.llm.ngrams import BLOCK_TEXTS, KINDS, linear_scores

POSITIVES, UNLABELLED = 1500, 3000
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def risk_slope(prior: float, positive: Sums, unlabelled: Sums, positive_x: np.ndarray) -> tuple[np.ndarray, float]:
    """The derivatives of the non-negative risk in weights and bias, from the sums at them.

    positive_x: the sum of the positives' features.
    """
    n_p, n_u = positive.n, unlabelled.n
    sign = 1.0 if unlabelled.loss / n_u - prior * positive.loss / n_p >= 0 else -1.0
    rest_x, rest_b = unlabelled.x / n_u - prior * positive.x / n_p, unlabelled.up / n_u - prior * positive.up / n_p
    if sign < 0:
        return -rest_x, -rest_b
    return prior * (positive.x - positive_x) / n_p + rest_x, prior * (positive.up - n_p) / n_p + rest_b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, bias)."""
    seen = labels.filter(~held_out(F.col(id_col)))
    prior = seen.filter(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    flat = np.zeros((KINDS, 1), np.float32)
    if prior is None:
        return flat, 0.0
    prior = min(max(prior, 0.01), 0.99)
    trusted = seen.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id"), F.lit(1).alias("mark"))
    others = seen.select(F.col(id_col).alias("id"), F.lit(0).alias("mark"))
    data = sample(docs, [(trusted, POSITIVES), (others, UNLABELLED)], id_col, text_col)
    _, whole = counts = data.sums(None, by_mark=True)
    if not all(c.n for c in counts):
        data.discard()
        return flat, float(np.log(prior / (1 - prior)))

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        unlabelled, positive = data.sums(w, b, by_mark=True)
        return risk_slope(prior, positive, unlabelled, whole.x)

    w, b = descend(slope)
    data.discard()
    return w.reshape(KINDS, -1).astype(np.float32), b


def _scored(batches, weights: np.ndarray, bias: float):
    for batch in (whole.slice(i, BLOCK_TEXTS) for whole in batches for i in range(0, whole.num_rows, BLOCK_TEXTS)):
        texts = batch.column(1).fill_null("").to_pylist()
        z = linear_scores(texts, weights) if weights.shape[1] > 1 else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z + bias))], names=[batch.schema.names[0], "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(lambda batches: _scored(batches, *shared.value), f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
