"""Retrieval by blocks against all pairs, in one slice and in several; knowledge-base entries; text diagnoses' edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ioloom.operators import diagnoses, retrieval

NAMES, KEYS = ["a", "b", "c"], ["x", "y", "z"]


def similar(p, q):
    both = [(abs(p.get(k, 0.0)), abs(q.get(k, 0.0))) for k in KEYS if p.get(k, 0.0) or q.get(k, 0.0)]
    total = 0.0
    for u, v in both:
        total += min(u, v) / max(u, v, 1e-9)
    return math.floor((total / len(both) if both else 0) * 10000 + 0.5) / 10000


@pytest.mark.parametrize("size", [None, 37])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "CELLS", 500)
    rng = random.Random(size or 0)
    dims = lambda: [d for d in NAMES if rng.random() < 0.4]
    sig = lambda: {k: rng.choice([0.0, 1.0, 2.0, -2.0, rng.uniform(0, 3)]) for k in KEYS if rng.random() < 0.8}
    kb = [(f"e{i}", i, dims(), sig()) for i in range(200)]
    jobs = [(i, dims(), sig()) for i in range(90)]
    found = retrieval.retrieve(spark.createDataFrame(jobs, "job_id bigint, dims array<string>, signature map<string,double>"), spark.createDataFrame(kb, "entry_id string, ordinal int, dims array<string>, signature map<string,double>"), NAMES, KEYS, 3, size)
    got = {r.job_id: [(e.entry_id, e.matched, e.similarity) for e in r.evidence] for r in found.collect()}
    for job, ds, s in jobs:
        ranked = sorted((-len(set(ds) & set(es)), -similar(s, t), o, e) for e, o, es, t in kb if set(ds) & set(es))[:3]
        assert got[job] == [(e, -m, -x) for m, x, _, e in ranked]


@pytest.mark.parametrize("near", [1, 8])
def test_slices_give_what_all_pairs_give_and_meet_few_leaves(spark, monkeypatch, near):
    monkeypatch.setattr(retrieval, "LEAF", 8)
    monkeypatch.setattr(retrieval, "GROUP", 4)
    monkeypatch.setattr(retrieval, "NEAR", near)
    rng = random.Random(near)
    dims = lambda: [d for d in NAMES if rng.random() < 0.4]
    sig = lambda: {k: rng.choice([0.0, 1.0, -2.0, *[round(rng.uniform(0, 3), 2) for _ in range(9)]]) for k in KEYS}
    kb = [(f"e{i}", i, dims(), sig()) for i in range(3000)]
    kb += [(f"e{3000 + i}", 3000 + i, ["a", "b", "c"], kb[i % 5][3]) for i in range(40)]  # equal ones
    jobs = [(i, *kb[7 * i][2:]) for i in range(60)] + [(60, [], {}), (61, ["a", "b", "c"], {}), (62, ["a"], sig())]
    met, plain = spark.sparkContext.accumulator(0), retrieval._asking

    def counted(batches, *args):
        for b in plain(batches, *args):
            met.add(b.num_rows)
            yield b

    monkeypatch.setattr(retrieval, "_asking", counted)
    found = retrieval.retrieve(spark.createDataFrame(jobs, "job_id bigint, dims array<string>, signature map<string,double>"), spark.createDataFrame(kb, "entry_id string, ordinal int, dims array<string>, signature map<string,double>"), NAMES, KEYS, 3, 400)
    got = {r.job_id: [(e.entry_id, e.matched, e.similarity) for e in r.evidence] for r in found.collect()}
    for job, ds, s in jobs:
        ranked = sorted((-len(set(ds) & set(es)), -similar(s, t), o, e) for e, o, es, t in kb if set(ds) & set(es))[:3]
        assert got[job] == [(e, -m, -x) for m, x, _, e in ranked]
    assert met.value < 63 * 3000 / 8 / 2  # of some 380 leaves or more a question


def test_entries_and_diagnoses(spark, tmp_path):
    rows = spark.createDataFrame([("ior", "s", 0, 1, 0, 1.00004, None), ("ior", "s", 1, 0, 0, float("nan"), 2.0)], "benchmark string, scenario string, idx bigint, m int, healthy int, x double, y double")
    fixes = spark.createDataFrame([("m", "cache it")], "dimension string, fix string")
    kb = retrieval.knowledge_base(rows, fixes, ["m", "healthy"], ["x", "y"], spark.createDataFrame([("ior", "repo")], "benchmark string, source string"))
    a, b = sorted(kb.collect(), key=lambda r: r.ordinal)
    assert (a.entry_id, a.dims, a.signature, [f.fix for f in a.fixes], a.source) == ("ior_s_0", ["m"], {"x": 1.0}, ["cache it"], "repo") and (b.dims, b.signature, b.fixes) == (["healthy"], {"y": 2.0}, [])
    retrieval.export(kb, str(tmp_path / "kb"))
    assert spark.read.json(str(tmp_path / "kb" / "full")).count() == 2 and {p.name for p in (tmp_path / "kb" / "by_dim").iterdir() if p.is_dir()} == {"dim=m", "dim=healthy"}
    jobs = spark.createDataFrame([(1, ["m"], {"x": 1.0}), (2, ["healthy"], {}), (3, [], {}), (4, ["other"], {})], "job_id bigint, dims array<string>, signature map<string,double>")
    got = {r.job_id: r for r in retrieval.diagnose(jobs, kb, fixes, ["m", "healthy", "other"], ["x", "y"]).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["bottlenecks", "healthy", "healthy", "bottlenecks"]
    assert [(r.dimension, r.fix, r.citations) for r in got[1].recommendations] == [("m", "cache it", ["ior_s_0"])] and got[2].evidence[0].entry_id == "ior_s_1"
    assert got[3].evidence == got[4].evidence == [] and [(r.dimension, r.fix, r.citations) for r in got[4].recommendations] == [("other", None, [])]


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "no cue but High metadata load here"), (2, "x problem"), (3, "Negligible issue:\nmetadata time is long"), (4, None)], "k int, t string")
    assert {r.k: r.dims for r in diagnoses.paragraph_dims(df, "k", "t").collect()} == {1: [], 2: [], 3: ["metadata_intensity"], 4: []}
    assert diagnoses.telling(["small io", "io", "x"]) == ["io", "x"]
    assert df.select(diagnoses.report_dims(F.col("t")).alias("d")).first().d == ["metadata_intensity"]


def test_few_leaves_are_looked_at_and_ties_go_to_the_least_ordinal(monkeypatch):
    rng = np.random.default_rng(5)
    n = 20_000
    signatures = np.round(np.where(rng.random((n, 3)) < 0.1, 0, rng.random((n, 3))), 2)
    table = pa.table({"entry_id": [f"e{i}" for i in range(n)], "ordinal": rng.permutation(n), "pattern": rng.integers(1, 4, n), "signature": signatures.tolist()})
    kb = retrieval._loaded(type("Rows", (), {"toArrow": lambda self: table})())
    assert kb.stop[-1] == n and (kb.stop - kb.start).max() <= retrieval.LEAF
    seen, plain = [], retrieval.similarities
    monkeypatch.setattr(retrieval, "similarities", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    asked = signatures[rng.integers(0, n, 40)]
    got = retrieval._best(asked, 1, kb, 3)
    shares = table["pattern"].to_numpy() & 1 == 1
    ordinals = table["ordinal"].to_numpy()
    for x, mine in zip(asked, got, strict=True):
        every = plain(x[None], signatures)[0]
        best = [i for i in np.lexsort((ordinals, -every)) if shares[i]][:3]
        assert [(e, s) for e, _, s, _ in mine] == [(f"e{i}", float(every[i])) for i in best]
    assert sum(seen) < len(asked) * n / 4


def test_export_computes_entries_once_and_packs_them(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kb = spark.createDataFrame([("e1", ["m", "n"], {"x": 0.1}), ("e2", ["m"], {})], "entry_id string, dims array<string>, signature map<string,double>").mapInArrow(counted, "entry_id string, dims array<string>, signature map<string,double>")
    retrieval.export(kb, str(tmp_path / "kb"))
    assert seen.value == 2 and not list((tmp_path / "kb").rglob("*.json")) and list((tmp_path / "kb").rglob("*.json.gz"))
    back = spark.read.schema("entry_id string, dims array<string>, signature map<string,double>, dim string").json(str(tmp_path / "kb" / "by_dim")).collect()
    assert sorted((r.entry_id, r.dim, r.signature) for r in back) == [("e1", "m", {"x": 0.1}), ("e1", "n", {"x": 0.1}), ("e2", "m", {})]
