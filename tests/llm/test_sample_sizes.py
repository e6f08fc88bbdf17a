"""The fitted models rest on whole samples, and their sums over tasks are those over all rows at once."""

import numpy as np
import pyarrow as pa
import pytest
from test_text_ops import docs_of, quality_case

from ioloom.llm import linear, ngrams, quality_pu, quality_rules


def test_fitted_models_rest_on_whole_samples():
    assert quality_rules.SAMPLE_ROWS == 3000 and quality_rules.fit.__defaults__[0] == 3000
    assert (quality_pu.POSITIVES, quality_pu.UNLABELLED) == (1500, 3000)


def test_features_are_made_in_parts_and_in_order(monkeypatch):
    texts = [None, "", *(f"word{i} and more words {i}" for i in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int32()), pa.array([False] * len(texts))], names=["body", "mark", "held"])
    whole = pa.Table.from_batches(linear._featurised([batch]))
    monkeypatch.setattr(linear, "ROWS", 5)
    parts = list(linear._featurised([batch]))
    assert max(p.num_rows for p in parts) == 5 and pa.Table.from_batches(parts).equals(whole)
    assert whole.column("mark").to_pylist() == list(range(len(texts)))


def dense(texts):
    x = np.zeros((len(texts), linear.SIZE))
    for row, (places, v) in zip(x, ngrams.sparse_features([t or "" for t in texts]), strict=True):
        row[places] = v
    return x


def test_sums_are_those_of_the_dense_matrix(spark):
    rows = [(i, t) for i, t in enumerate(["alpha beta", "", None, "gamma gamma delta", "alpha beta"])] + [(3, "gamma gamma delta"), (3, "another text")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(9, 1), (1, None)], "id bigint, mark int")
    data = linear.sample(docs_of(spark, rows), [(marks, 100)], "doc_id", "text")
    x, y = dense([t for _, t in rows[:5]] + [rows[6][1]]), np.array([0, 1, 0, 1, 0, 1])
    w = np.random.default_rng(3).normal(size=linear.SIZE)
    z = x @ w.astype(np.float32) + 0.25
    for k, got in enumerate(data.sums(w, 0.25, by_mark=True)):
        up = linear.sigmoid(z)[y == k]
        assert got.n == (y == k).sum() and got.up == pytest.approx(up.sum(), rel=1e-5) and got.loss == pytest.approx(np.logaddexp(0, z)[y == k].sum(), rel=1e-5)
        assert np.allclose(got.x, up @ x[y == k], atol=1e-5)
    few = linear.sample(docs_of(spark, rows), [(marks, 2), (marks, 1)], "doc_id", "text")
    assert sum(s.n for s in few.sums(None, by_mark=True)) == 2


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_slope_is_that_of_the_brute_force_risk(prior):
    rng = np.random.default_rng(int(prior * 10))
    x, y = rng.normal(size=(12, linear.SIZE)) * (rng.random(linear.SIZE) < 1e-5), np.arange(12) % 3 == 0
    at = np.flatnonzero(np.abs(x).sum(axis=0))
    w, b = np.zeros(linear.SIZE), 0.1
    w[at] = rng.normal(size=len(at))

    def parts(w, b):
        z = x @ w + b
        rest = np.logaddexp(0, z[~y]).mean() - prior * np.logaddexp(0, z[y]).mean()
        return prior * np.logaddexp(0, -z[y]).mean(), rest

    def sums(mine):
        s, z = linear.Sums(), x[mine] @ w + b
        s.n, s.up, s.loss, s.x = mine.sum(), linear.sigmoid(z).sum(), np.logaddexp(0, z).sum(), linear.sigmoid(z) @ x[mine]
        return s

    # The risk's own slope, or that which raises its second term where that is negative.
    value = lambda w, b: sum(parts(w, b)) if parts(w, b)[1] >= 0 else -parts(w, b)[1]
    g, gb = quality_pu.risk_slope(prior, sums(y), sums(~y), x[y].sum(axis=0))
    assert gb == pytest.approx((value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6, abs=1e-5)
    for i in at[:4]:
        step = np.eye(1, linear.SIZE, i)[0] * 1e-6
        assert g[i] == pytest.approx((value(w + step, b) - value(w - step, b)) / 2e-6, abs=1e-5)


def test_a_long_or_repeated_text_takes_one_place_in_the_sample(spark):
    docs, labels, _ = quality_case(spark, 40)
    more = docs.unionByName(docs_of(spark, [(1, "long " * 200_000)] * 3))
    data = linear.sample(more, [(labels.selectExpr("doc_id as id", "quality as mark"), 1000)], "doc_id", "text", 5)
    bad, good = data.sums(None, by_mark=True)
    z, _ = data.held_scores(np.zeros(linear.SIZE), 0.0)
    # The long text, three times there, is one row more.
    assert bad.n + good.n + len(z) == labels.filter("quality in (0, 1)").count() + 1
