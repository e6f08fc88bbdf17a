"""Operators over whole tables: near-duplicates, shards, page extraction and the pipeline."""

import itertools
import random
import zlib

import pytest
import xxhash
from test_text_ops import brute_base, brute_contamination, docs_of

import corpus_pipeline
from ioloom.llm import dom_blocks, html_extract, kd_shards, packing, quality_rules, secret_scan, simhash

# ---- SimHash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def near_copies(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (None, "one two three"), (6, "one two three"), (7, "A b c d"), (7, "A b c d")]
    for k in range(12):
        base = [word() for _ in range(rng.choice([60, 300]))]
        for _ in range(rng.choice([1, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_components_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = near_copies()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps), strict=True)))
    got = sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.simhash_components(docs_of(spark, rows)).collect())
    assert got == want and len(set(fps)) < len(rows)


def test_covering_links_lose_no_pair_within_the_radius(spark):
    rng = random.Random(9)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    nodes = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in nodes], "fp bigint"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(nodes, nodes)
    by_class = {}
    for x, c in zip(nodes, want, strict=True):
        by_class.setdefault(c, set()).add(signed(x))
    for members in by_class.values():
        assert {got.get(m, m) for m in members} == {min(members)}
    for mask_free in itertools.combinations(range(0, 64, 5), 4):
        assert any(not m & sum(1 << b for b in mask_free) for m in simhash.masks())


def test_keep_one_row_of_each_component(spark):
    rows = near_copies(6)
    docs = docs_of(spark, rows)
    kept = simhash.keep_one(docs)
    comp = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert simhash.keep_one(docs.limit(0)).count() == 0


# ---- shards


def test_kd_shards_are_even_and_gapless(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 900)) for i in range(700)] + [(7, "same")] * 300 + [(None, None), (1001, "")]
    docs = docs_of(spark, rows)
    out = kd_shards.kd_shards(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    by = {k: [r for r in out if r.shard == k] for k in range(16)}
    sums = [sum(r.size for r in by[k]) for k in range(16)]
    assert max(sums) - min(sums) <= 4 * max(size(t) for _, t in rows)
    assert all(sorted(r.slot for r in by[k]) == list(range(len(by[k]))) for k in by)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    few = kd_shards.kd_shards(docs_of(spark, rows[:3])).collect()
    assert len(few) == 3 and kd_shards.kd_shards(docs.limit(0)).count() == 0
    assert len({r.shard for r in kd_shards.kd_shards(docs, target_bytes=sum(map(lambda r: size(r[1]), rows)) // 5 + 1).collect()}) == 5


# ---- pages


def test_blocks_of_malformed_pages():
    text = lambda page: [b.text for b in dom_blocks.blocks(page)]
    assert text(None) == text("") == []
    assert text("<p><b>one\n two<br>three<p>four &amp;&nbsp;&lt;5</p></b> tail") == ["one two three", "four & <5", "tail"]
    assert text("<head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><!-- c --><div>a<i>b</i></div></body>") == ["ab"]
    assert text("<ul><li>x<li>y</ul><td>z <a href='>'>w</a>") == ["x", "y", "z w"]
    assert text("a < b <p>c<div class=") == ["a < b", "c"]
    assert text("<p>" + "long " * 100000)[0] == ("long " * 100000).strip()


def page_case(spark, n=60):
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choice("river stone light winter garden amber quiet letter".split()) for _ in range(k)) + "."
    pages, truth = [], {}
    for i in range(n):
        main = [say(6), *[say(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]]
        extra = {"comments": f'<div class="comments"><p>{say(30)}</p><p>{say(9)}</p></div>', "aside": f"<aside><h3>{say(2)}</h3><p>{say(20)}</p></aside>", "cookie": f'<div class="cookie-notice">{say(15)}</div>', "form": f"<form><label>{say(2)}</label><button>go</button></form>", "ad": f'<div class="ad">{say(12)}</div>'}
        article = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
        tag = "article" if i % 4 else "main"
        page = f"<html><head><title>t</title></head><body><header><p>{say(3)}</p></header><nav><ul><li><a href='/'>{say(1)}</a></li></ul></nav>" + "".join(extra[k] for k in rng.sample(list(extra), 2)) + f"<{tag}>{article}{extra['ad'] if i % 3 == 0 else ''}</{tag}>" + extra["comments"] * (i % 2) + f"<footer>© {say(4)}</footer></body></html>"
        pages.append((i, f"http://x/{i}", page))
        truth[i] = "\n".join(main)
    return spark.createDataFrame(pages + [(900, None, None), (901, "u", ""), (1, pages[1][1], pages[1][2])], "page_id bigint, url string, html string").withColumn("text", html_extract.F.lit("clash")), truth


def test_extracted_text_is_the_article(spark):
    pages, truth = page_case(spark)
    out = html_extract.extract(pages, html_extract.fit(pages)).collect()
    assert len(out) == len(truth) + 3 and all(r.n_chars == len(r.text) for r in out)
    right = sum(r.text == truth[r.page_id] for r in out if r.page_id in truth)
    assert right >= 0.97 * (len(truth) + 1)
    assert {r.text for r in out if r.page_id >= 900} == {""}
    assert html_extract.fit(pages.limit(0)) is None and html_extract.extract(pages.limit(0), None).count() == 0


# ---- the pipeline


def test_pipeline_is_the_chain_of_its_stages(spark, tmp_path):
    rng = random.Random(11)
    say = lambda k: " ".join(rng.choice("river stone light winter garden amber quiet letter morning road".split()) + str(rng.randint(0, 99)) for _ in range(k))
    passage = say(14)
    rows = [(i, say(90)) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1]), (103, rows[5][1] + " " + passage), (104, say(80) + " password = abcdef123"), (105, "WIN!! CASH!! " * 60), (106, None), (107, say(20)), (108, say(70)), (108, say(70))]
    docs_of(spark, rows).drop("n_words").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if not brute_base(r[1])[-1]]
    comp = brute_components([i for i, _ in kept], [brute_fingerprint(t) for _, t in kept])
    first, seen = [], set()
    for (i, t), c in sorted(zip(kept, comp, strict=True), key=lambda x: (x[0][0], x[1])):
        if (i == c) and (c, t) not in seen:
            seen.add((c, t))
            first.append((i, t))
    clean = [(i, secret_scan.redacted(t, secret_scan.spans_of(t, t.encode()))) for i, t in first if not brute_contamination(t, [(1, passage)])[-1]]
    from tokenizers import Tokenizer

    from ioloom.llm.queries import tokenizer_path

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((i, a, n) for i, t in clean for a, n in packing.decompose(len(tk.encode(t, add_special_tokens=False).ids) + 1))
    single = [w for w in want if w[0] != 108]
    assert sorted((r.doc_id, r.start, r.length) for r in got if r.doc_id != 108) == single
    assert {103, 105, 106, 107, 100, 101, 102}.isdisjoint(r.doc_id for r in got) and 104 in {r.doc_id for r in got}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "secret_scan", "packing"]
    assert quality_rules.KEEP_FROM == 0.5
