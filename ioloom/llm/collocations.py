"""Phrase collocations: words that stand together more often than their own counts explain, by language.

Every task counts the phrases of its texts in HAT-tries (hat_trie.py), one a language. When their entries or the
task's dictionary of words grow too large, whole subtrees leave as sorted runs; their rows name the prefix partition, a hash of the first two
words, in which Spark merges the runs by adding the counts of equal phrases. A pair that begins a large share of all phrases is
divided by its third word as well.

Words and pairs are counted first. A phrase of three words is no more frequent than its two pairs, so only phrases
whose pairs may both reach LEAST are counted next: a filter of fixed size tells tasks which pairs do; what it lets through
needlessly fails the bound when it has been counted. Counts are over all texts, and nothing is capped.

Scores are floor(10**6 a a / (l r)) in decimals of 38 digits; a, l and r may have 16 digits.

Defined results: null and empty texts have no words; a null language is `und`; very long texts are read in slices that share their last two
words; repeated rows count as often as they occur; ties go by phrase; fewer candidates than TOP are all
returned; an empty table gives no rows; columns other than text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ioloom.llm.base import HOT_KEYS, HOT_ROWS, bit_filter, passing, written
from ioloom.llm.hat_trie import ID_BITS, HatTrie

#: A phrase's least count, and how many phrases of a language are returned.
LEAST, TOP = 10, 2000
#: A candidate goes if a longer one that holds it has this share of its count, in hundredths.
SHARE = 50
#: Bytes of text counted at once, entries and words that a task holds, and rows in an output batch.
SLICE, ENTRIES, WORDS, OUT_ROWS = 1 << 20, 1_500_000, 500_000, 100_000

#: A-Z to lower case, marks that end a piece to a line feed, a tab to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_NAMES = ["lang", "part", "size", "phrase", "n"]
_SCHEMA = "lang string, part bigint, size int, phrase string, n bigint"


def _mixed(*parts) -> np.ndarray:
    """A hash of hashes."""
    with np.errstate(over="ignore"):
        x = sum(p * m for p, m in zip(parts, _MIX, strict=False))
        x = (x ^ (x >> np.uint64(29))) * _MIX[-1]
        return x ^ (x >> np.uint64(32))


class _Lexicon(dict):
    """word -> id; a word that isn't there gets the next one. 0 ends a piece."""

    def __init__(self):
        self.words, self.hashes = [b""], [0]
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return len(self.words) - 1


def _slices(raw: bytes) -> Iterator[bytes]:
    """raw cut after white space into pieces of about SLICE bytes."""
    start = 0
    while len(raw) - start > SLICE:
        cut = [x for x in (raw.find(b" ", start + SLICE), raw.find(b"\n", start + SLICE)) if x >= 0]
        if not cut:
            break
        yield raw[start : min(cut) + 1]
        start = min(cut) + 1
    yield raw[start:]


class _Counter:
    """What one task counts: words and pairs, or phrases of three words."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray] | None):
        self.frequent = frequent
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.tries, self.own = _Lexicon(), {}, {}

    def read(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(2, np.int64)
        for part in _slices(b"\n".join(texts).translate(_FOLD) + b"\n"):
            words = part.replace(b"\n", b" \n ").split(b" ")
            ids = np.concatenate([before, np.array(list(map(self.lexicon.__getitem__, filter(None, words))), np.int64)])
            before = ids[-2:]
            trie = self.tries.setdefault(lang, HatTrie())
            if self.frequent is None:
                own = self.own.get(lang, np.zeros(0, np.int64))
                more = np.bincount(ids[2:], minlength=len(own))
                more[: len(own)] += own
                self.own[lang] = more
                trie.add(((ids[1:-1] << 2 * ID_BITS) | (ids[2:] << ID_BITS))[(ids[1:-1] > 0) & (ids[2:] > 0)])
            else:
                pairs = passing(self.frequent[0], self._pairs(lang, ids[:-1], ids[1:])) & (ids[:-1] > 0) & (ids[1:] > 0)
                trie.add(((ids[:-2] << 2 * ID_BITS) | (ids[1:-1] << ID_BITS) | ids[2:])[pairs[:-1] & pairs[1:]])
            if len(self.lexicon.words) > WORDS:
                before_words = [self.lexicon.words[i] if i else b"\n" for i in before.tolist()]
                yield from self.spill(0)
                self.forget()
                before = np.array([self.lexicon[w] for w in before_words], np.int64)
            elif sum(map(len, self.tries.values())) > ENTRIES:
                yield from self.spill(ENTRIES // 2)

    def _pairs(self, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        import xxhash

        hashes = np.array(self.lexicon.hashes, np.uint64)
        return _mixed(hashes[first], hashes[second], np.uint64(xxhash.xxh64_intdigest(lang)))

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, until keep entries stay; with keep = 0 the words' own counts too."""
        words = pa.array(self.lexicon.words, pa.binary()).cast(pa.string())
        mask = (1 << ID_BITS) - 1
        if not keep:
            for lang, own in self.own.items():
                ids = np.flatnonzero(own[1:]) + 1
                yield from self._run(lang, words, own[ids], ids)
                if len(ids):
                    yield self._batch(lang, np.zeros(1, np.uint64), 0, pa.array([""]), np.array([own[1:].sum()]))
        room = keep // max(1, len(self.tries))
        for lang, trie in self.tries.items():
            for codes, counts in trie.spill(room):
                ids = [codes >> 2 * ID_BITS, codes >> ID_BITS & mask, codes & mask]
                yield from self._run(lang, words, counts, *ids[: 2 if self.frequent is None else 3])

    def _run(self, lang: str, words: pa.Array, counts: np.ndarray, *ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(counts), OUT_ROWS):
            mine = [x[i : i + OUT_ROWS] for x in ids]
            part = self._pairs(lang, mine[0], mine[1] if len(mine) > 1 else np.zeros(len(mine[0]), np.int64))
            if len(mine) == 3:
                hot = np.isin(part, self.frequent[1])
                part[hot] = _mixed(part[hot], np.array(self.lexicon.hashes, np.uint64)[mine[2][hot]])
            said = [words.take(pa.array(x)) for x in mine]
            yield self._batch(lang, part, len(mine), pc.binary_join_element_wise(*said, " ") if len(said) > 1 else said[0], counts[i : i + OUT_ROWS])

    @staticmethod
    def _batch(lang: str, part: np.ndarray, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        rows = len(n)
        return pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array(part.astype(np.int64)), pa.array(np.full(rows, size, np.int32)), phrase, pa.array(n.astype(np.int64))], names=_NAMES)


def _runs(batches, frequent):
    counter = _Counter(frequent)
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            yield from counter.read(lang, texts)
    yield from counter.spill(0)


def _merged(texts: DataFrame, frequent) -> DataFrame:
    """(lang, part, size, phrase, n) of phrases of LEAST or more; size 0 has a language's number of words."""
    runs = texts.mapInArrow(lambda batches: _runs(batches, None if frequent is None else frequent.value), _SCHEMA)
    return runs.repartition("part").groupBy("part", "lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST) | (F.col("size") == 0)).select("lang", "part", "size", "phrase", "n")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n) of the phrases of one to three words that occur LEAST times or more, and, as size 0, of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("body"))
    few = written(_merged(texts, None), "phrases")
    pairs = few.filter("size = 2")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = pairs.filter(F.col("n") > max(HOT_ROWS, -(-total // HOT_KEYS))).select("part")  # HOT_KEYS rows at most
    frequent = docs.sparkSession.sparkContext.broadcast((bit_filter(pairs, "part"), np.array([r[0] for r in hot.collect()], np.int64).astype(np.uint64)))
    return few.unionAll(written(_merged(texts, frequent), "phrases")).drop("part")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    counts = phrase_counts(docs, text_col, lang_col)
    known, n = counts.filter("size > 0").drop("size"), counts.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = F.split("phrase", " ")
    candidates = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("w"))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(1000000BD * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))

    # A pair goes if a phrase of three words that holds it is frequent enough; those have no longer candidates.
    inner = candidates.filter("size = 3").select("lang", F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {SHARE} * a").select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    # The first of each slice of a language, then the first of all.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
