"""Clashing column names and types, empty tables, null ids, odd characters and very long inputs."""

import itertools
import random
import time

import numpy as np
import pytest
from test_text_ops import docs_of, quality_case

import corpus_pipeline
from ioloom.llm import chat, decontaminate, dom_blocks, html_extract, packing, quality_rules, secret_scan, simhash, tokens
from ioloom.llm.queries import OP1_SQL, OP2_SQL, PROBE, tokenizer_path

CLASHING = ["_judged_text", "_hash", "_known", "_null", "row", "i", "u", "h", "n", "salt", "fp", "name", "root", "doc", "body", "a.b", "c`d", "c0"]


def clashing(spark, rows):
    docs = docs_of(spark, rows).withColumn("n_chars", chat.F.lit("many"))
    return docs.withColumns({c: chat.F.lit(f"own {c}") for c in CLASHING})


def test_filtering_stages_keep_clashing_columns(spark):
    say = lambda k: " ".join(f"word{k}{i}" for i in range(60))
    docs = clashing(spark, [(1, say(1)), (1, say(1)), (2, say(2) + " token=abcdefg"), (None, say(3)), (3, None), (4, ""), (5, "long " * 100_000)])
    bench = spark.createDataFrame([(1, say(2))], "item_id bigint, text string")
    for out, n in ((quality_rules.keep_good(docs, None), 4), (simhash.keep_one(docs), 5), (decontaminate.drop_contaminated(docs, bench), 6), (decontaminate.drop_contaminated(docs, bench, matcher_bytes=100), 6), (secret_scan.redact_secrets(docs), 7)):
        got = out.collect()
        assert out.dtypes == docs.dtypes and len(got) == n
        assert all(r[c] == f"own {c}" for r in got for c in CLASHING) and {r.n_chars for r in got} == {"many"}


def test_every_stage_takes_an_empty_table(spark):
    docs = clashing(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for out in (quality_rules.keep_good(docs, None), simhash.keep_one(docs), simhash.simhash_components(docs), decontaminate.drop_contaminated(docs, bench), secret_scan.redact_secrets(docs), secret_scan.scan_secrets(docs), packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))):
        assert out.count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(turns.withColumn("parts", chat.text_part(chat.F.col("text")))).count() == 0


def test_many_copies_of_one_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    from ioloom.llm import base

    monkeypatch.setattr(base, "HOT_ROWS", 3)
    monkeypatch.setattr(base, "HOT_KEYS", 100)
    rows = [(7, "same words here again")] * 20 + [(i, f"a text of its own {i} with words {i * i}") for i in range(100, 140)] + [(i, "many copies of this line") for i in range(20)] + [(None, None)] * 9
    docs = docs_of(spark, rows)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(docs).collect())
    out = simhash.simhash_components(docs).collect()
    assert len(out) == len(rows) and {r.component_id for r in out if r.doc_id is not None and r.doc_id < 20 and r.doc_id != 7} == {0}
    assert len(kept) == len({r.component_id for r in out}) and (False, 7) in kept


# ---- token ids


def test_token_ids_of_a_fuzz_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(7)
    pieces = "İ|ı|ß|ǅ|ŉ|é|é|́|̇|'s|'|’|!|?!|...|<||>|<\\|endoftext\\|>| |  |\n|\t| |　| |\x1c|a|B|Word|日本|한|ﬁ|Å|Å|K|1|23|½|²|_|-|\"|‍|😀|﻿|\x85|'LL|'ll|don't|ͅ|ͺ|Σ|ς".split("|")
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        mine, whole = tokens.WordEncoder(tokenizer_path(name), spaced), Tokenizer.from_file(tokenizer_path(name))
        for _ in range(5000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
            assert np.frombuffer(mine.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)
    assert tokens._MARKED.fullmatch("é!") and not tokens._MARKED.fullmatch("İ!")


# ---- pages


def texts(page):
    return [b.text for b in dom_blocks.blocks(page)]


def test_hidden_inline_elements_and_short_comments():
    assert texts("<!-->shown--><p>x</p>") == ["shown-->", "x"] and texts("<!--->shown<p>x</p>") == ["shown", "x"] and texts("<!-- a --><p>x</p>") == ["x"]
    page = "<p>one <span hidden>two <span>three</span> four</span> five</p><p>six</p>"
    assert texts(page) == ["two three four", "one five", "six"] and dom_blocks.blocks(page)[0].node.words == "hidden"
    assert texts("<p>one<i hidden>two<p>three<i hidden/>four</p>") == ["two", "one", "threefour"]


def test_bad_markup_loses_no_text():
    assert texts("<p title='it's'>Hello</p><p>don't go</p>") == ["Hello", "don't go"]
    assert texts('<p class="a"b">Hello world</p>') == ["Hello world"]
    assert texts("<article><p>one</p><svg><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert texts('<p title="abc>Hello</p><p>more') == ["Hello", "more"]
    assert texts("<p>x<!-- open <p>y</p>") == ["xy"]
    assert texts("<video><p>a</p><video></video>b<svg/>c<svg><text>no</text></svg>d") == ["a", "bcd"]
    assert texts("<script>var a=1;<p>text</p>") == ["text"]
    assert texts("<p>a 　  b\n</p>") == ["a b"]


@pytest.mark.parametrize("page", ["<p>one</p>" + "<a " * 350_000 + "<p>two</p>", "<p>one</p>" + "<!--" * 200_000 + "<p>two</p>", "<p>one</p>" + "<svg>" * 200_000 + "<p>two</p>", "<p>one</p>" + "<div>" * 150_000 + "</x>" * 100_000 + "two", "<p>one</p>" + "<p title=\">" * 90_000 + "two"], ids=["tags", "comments", "unclosed", "nested", "quotes"])
def test_a_megabyte_of_bad_markup_takes_linear_time(page):
    begin = time.time()
    assert texts(page) == ["one", "two"]
    assert [html_extract.features(b) for b in dom_blocks.blocks(page)] and time.time() - begin < 20


def chains(seed, n=3):
    rng = random.Random(seed)
    return [([sorted(rng.sample(range(6), rng.randint(1, 3))) for _ in range(k)], [rng.randint(0, 1) for _ in range(k)]) for k in [rng.randint(1, 5) for _ in range(n)]]


def enumerated(fs, state, step):
    """(score, labels) of every label sequence."""
    for y in itertools.product((0, 1), repeat=len(fs)):
        yield sum(state[x] for f, k in zip(fs, y, strict=True) if k for x in f) + sum(step[a][b] for a, b in itertools.pairwise(y)), y


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_and_likelihood_are_those_of_all_label_sequences(seed):
    rng = np.random.default_rng(seed)
    theta = rng.normal(size=10)
    state, step = theta[:-4], theta[-4:].reshape(2, 2)
    some = chains(seed)
    want = 0.0
    for fs, ys in some:
        scores = list(enumerated(fs, state, step))
        assert html_extract.Crf(state, step).decode(fs) == list(max(scores)[1])
        want += next(s for s, y in scores if list(y) == ys) - np.logaddexp.reduce([s for s, _ in scores])
    value = lambda t: html_extract.chain_sums(*html_extract.packed(some), t)[0]
    got, gradient = html_extract.chain_sums(*html_extract.packed(some), theta)
    assert got == pytest.approx(want)
    for i in range(10):
        d = np.eye(10)[i] * 1e-6
        assert gradient[i] == pytest.approx((value(theta + d) - value(theta - d)) / 2e-6, abs=1e-5)


# ---- chat, secrets, packing


def test_roles_with_any_characters_come_back(spark):
    roles = ["a\x00b", "\\", "\\n", "\n", "\\\\n\n\\", "<\\|im_end|>\n", "x\\\x00\\n"]
    turns = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_part(chat.F.col("text")))
    out = chat.format_conversations(turns).select("conv_id", chat.parse_turns(chat.F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [t.role for t in r.t] for r in out} == {i: [r] for i, r in enumerate(roles)}


def test_candidates_of_the_tables_are_measured(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secret_scan.scan_secrets(docs.unionByName(docs.filter("doc_id < 9"))).filter("measured <> ''").collect()
    assert len(got) >= 5
    for r in got:
        assert all(len(m.split(":")) == 3 and int(m.split(":")[2]) > 0 for m in r.measured.split(","))


def test_a_secret_before_its_word_is_found_and_long_texts_take_linear_time():
    spans = lambda t: secret_scan.spans_of(t, t.encode())
    assert spans("8ZxT0vYw3LmP9sKd2RfH7nB is my password") == [(0, 23, "novel")]
    begin = time.time()
    assert len(spans("password = abcdef123456789 " * 100_000)) == 100_000 and spans("token" * 500_000) == []
    assert time.time() - begin < 30


def test_pieces_are_numbered_within_their_bucket(spark, tmp_path):
    rows = [(i, "some words here " * (i % 7)) for i in range(40)] + [(None, None)]
    out = packing.pack(docs_of(spark, rows).repartition(3), tokenizer_path("byte_bpe_50k.json")).collect()
    lengths = sorted({r.length for r in out})
    first = 0
    for n in lengths:
        bucket = [r for r in out if r.length == n]
        assert sorted(r.bucket_place for r in bucket) == list(range(len(bucket))) and sorted(r.sequence_id for r in bucket) == list(range(first, first + len(bucket)))
        assert all(len(r.ids) == 4 * n for r in bucket)
        first += len(bucket)
    packing.write_buckets(docs_of(spark, rows), str(tmp_path / "b"), tokenizer_path("byte_bpe_50k.json"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == sorted(f"length={n}" for n in lengths)


# ---- SQL and the pipeline


def test_sql_of_the_first_two_operators_agrees(spark, tmp_path):
    import duckdb

    from ioloom.llm import queries

    rows = [(1, "x two words y"), (2, None), (2, ""), (3, " ".join("abcdefghijkl")), (3, " ".join("ABCDEFGHIJKL")), (None, "two Words")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "two words"), (2, None), (3, "a b c d e f g h i j k"), (3, "b c d e f g h i j k l")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "a\x00\\n", PROBE), (1, 1, "assistant", None), (1, 1, "assistant", "<\\|x"), (2, None, "assistant", "é" * 100_000)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path / name}.parquet/*.parquet')")
    for query, sql in ((queries.op1_decontaminate, OP1_SQL), (queries.op2_chat_format, OP2_SQL)):
        out = query(spark, str(tmp_path))
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in out.select(*names).collect())


def test_pipeline_fits_its_model_and_takes_odd_tables(spark, tmp_path):
    docs, labels, y = quality_case(spark, 120)
    odd = docs_of(spark, [(None, "quiet river stone " + " ".join(f"w{i}" for i in range(80))), (500, None), (501, ""), (502, " ".join(f"word{i}" for i in range(60_000)))])
    whole = docs.unionByName(odd).withColumn("row", chat.F.lit(1)).withColumn("_hash", chat.F.lit("x"))
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("toxic", chat.F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    kept = {r.doc_id for r in quality_rules.keep_good(whole, quality_rules.fit(whole, labels)).collect()}
    assert got <= kept and {500, 501}.isdisjoint(got) and sum(y[i] for i in got if i is not None and i < 120) >= 0.9 * sum(y)
    assert not any(i in got for i in range(120) if not y[i])
