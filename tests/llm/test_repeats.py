"""Relative Lempel-Ziv dedup against a count of all windows."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from ioloom.llm import base, repeats
from ioloom.llm.queries import OP11_SQL, op11_relative_lz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def answered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(rng):
    """Copies, near copies, passages in other surroundings, periodic text, repeats within a text, odd white space."""
    word = lambda k=400: f"w{rng.randint(0, k)}"
    say = lambda n, k=400: [word(k) for _ in range(n)]
    shared = [say(n) for n in (34, 35, 36, 60, 120)]
    rows = [say(rng.randint(0, 90)) for _ in range(20)]
    for _ in range(60):
        rows.append([*say(rng.randint(0, 40)), *rng.choice(shared), *say(rng.randint(0, 40)), *rng.choice([[], rng.choice(shared)])])
    near = say(150)
    for _ in range(12):
        copy = list(near)
        copy[rng.randint(0, 149)] = word()
        rows.append(copy)
    rows += [["a", "b"] * 60, ["a"] * 34, ["a"] * 35, ["a"] * 36, ["a"] * 500, ["c"] * 35, say(60, 2), say(200, 1), [*near[:80], *near[40:120], *near[:60]]]
    out = [rng.choice([" ", "\n", "\t \x0b", "\r\n"]).join(x) for x in rows]
    return [*out, out[3], near and " ".join(near), " ".join(near), "\x85".join(say(80)), None, "", " \n", " ".join(say(30_000, 60_000)), "é ß\x00  ".join(say(50))]


@pytest.mark.parametrize("hot", [1000, 2])
def test_removed_words_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ENTRIES", hot)
    monkeypatch.setattr(base, "HOT_ROWS", 5)
    monkeypatch.setattr(repeats, "BLOCK_WORDS", 300)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts(random.Random(hot)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: repeats.F.lit(c) for c in ("key", "copies", "row", "anchor", "a.b", "c`d")})
    assert answered(repeats.remove_repeats(docs)) == expected(rows)


def test_a_window_across_a_boundary_is_found():
    """The greedy parse takes a long match that ends within a window which another entry has whole."""
    a = [f"x{i}".encode() for i in range(100)]
    one, two, three = a[:60], [*a[:30], b"y"], [b"z", *a[20:60]]
    block = repeats.Block([(0, 0, one), (0, 0, two), (0, 19, three)])
    assert {j for e, s, n in block.repeated() if e == 0 for j in range(s, s + n)} == set(range(20, 60))
    assert [tuple(x) for x in zip(*[c.tolist() for c in block.factors()], strict=True)][:2] == [(0, 0, 30), (0, 30, 30)]


def test_registered_query_on_given_tables(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(1)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = answered(op11_relative_lz(spark, str(tmp_path)))
    assert got == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(OP11_SQL).fetchall(), key=repr) == got
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
