"""Collocations against counts of all phrases in plain Python, and the trie against a dictionary."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from ioloom.llm import base, collocations, hat_trie
from ioloom.llm.queries import OP12_SQL, op12_collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    longer = collections.Counter()
    for (lang, *w), a in f.items():
        if len(w) == 3 and a >= 10:
            for pair in (w[:2], w[1:]):
                longer[lang, *pair] = max(longer[lang, *pair], a)
    out = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) == 1 or a < 10:
            continue
        if len(w) == 2 and 100 * longer[lang, *w] >= 50 * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def sample(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "b", "été", "ÉTÉ", "x\x00", "\x85", "日本", "-"] + [f"w{i}" for i in range(6)]
    say = lambda: "".join(rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "? "]) for _ in range(rng.randint(0, 80)))
    rows = [(say() + rng.choice(["", " new york city", " New York", " a b a b a b"]), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(400)]
    return [*rows, (None, "en"), ("", None), ("only once", "xx"), ("long " * 3_000, "en"), *[("again and again", "de")] * 12]


@pytest.mark.parametrize("small", [False, True])
def test_counts_scores_and_order(spark, monkeypatch, tmp_path, small):
    if small:
        for name, v in (("SLICE", 50), ("ENTRIES", 60), ("WORDS", 40), ("OUT_ROWS", 7), ("HOT_ROWS", 5)):
            monkeypatch.setattr(collocations, name, v)
        monkeypatch.setattr(hat_trie.HatTrie.__init__, "__defaults__", (8,))
    rows = sample(int(small))
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string").withColumns({c: base.F.lit(c) for c in ("phrase", "part", "n", "size", "a.b", "c`d")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_collocations(spark, str(tmp_path)).collect()))
    assert len(got) > 60 and got == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(OP12_SQL).fetchall()) == got
    assert sorted(map(tuple, collocations.collocations(docs, top=5).collect())) == expected(rows, 5)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_large_counts_score_exactly(spark, monkeypatch):
    huge = spark.createDataFrame([("en", 2, "a b", 10**15), ("en", 1, "a", 10**16 - 1), ("en", 1, "b", 3 * 10**15), ("en", 0, "", 10**17)], "lang string, size int, phrase string, n bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: huge)
    (row,) = collocations.collocations(huge).collect()
    assert row.score == 10**6 * 10**30 // ((10**16 - 1) * 3 * 10**15) and (row.l, row.r) == (10**16 - 1, 3 * 10**15)


def test_trie_counts_like_a_dictionary():
    rng = np.random.default_rng(2)
    trie, plain, spilled = hat_trie.HatTrie(burst=50), collections.Counter(), collections.Counter()
    for _ in range(60):
        ids = np.minimum(rng.geometric(0.05, (400, 3)), 200).astype(np.int64)
        ids[rng.random(400) < 0.2, 0] = 7
        codes = (ids[:, 0] << 42) | (ids[:, 1] << 21) | ids[:, 2]
        trie.add(codes)
        plain.update(codes.tolist())
        if rng.random() < 0.2:
            for c, n in trie.spill(500):
                assert (np.diff(c) > 0).all()
                spilled.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
            assert len(trie) <= 500
    for c, n in trie.spill():
        spilled.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
    assert spilled == plain and len(trie) == 0 and len(trie.containers) > 20
