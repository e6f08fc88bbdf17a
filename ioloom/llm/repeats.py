"""Substring dedup by relative Lempel-Ziv parsing: words of repeated windows are removed.

Texts that are equal in full are one text with a number of copies. Every window of WINDOW words has an anchor, the
GRAM-word gram of the least hash in it, so two equal windows have equal anchors at equal places. A place is an anchor with the words that
its windows can reach, LEFT before and WINDOW from its first word on. Anchors that occur once, as most do, are put aside by counting.
Equal places are one entry of the reference, and places of several occurrences are repeated in full.

The other entries of an anchor are a reference block. A block that lacks a place's anchor cannot hold any of its windows, so each place
is factored against the one block that has it: a suffix array of the block's entries gives the longest match of each
position with another entry, and the greedy parse takes factor after factor. A factor of WINDOW words or more is a
repeated span; a repeated window that lies in no factor crosses just one boundary, as the factor behind the boundary
reaches its end at least, so the starts before such boundaries are looked up too. Words are compared as symbols that hold their distance from the anchor:
an entry never matches itself shifted, which would be the same words of the text.

An anchor of more than HOT_ENTRIES entries, a passage in many different surroundings, would be one large block. Its blocks
are divided down to one window each: windows are counted by a 128-bit digest, with partial sums, and nothing is left out.

Only counts and places are shuffled after the texts have been laid out by key once. Which anchors repeat is told to
tasks by a filter of fixed size; what it lets through needlessly has one entry and marks nothing.

Defined results: null, empty and wordless texts have no words and the hash of the empty string; texts of fewer than WINDOW words stay;
very long texts are parsed whole; repeated rows are copies, so each of their windows starts elsewhere; null ids are rows like others; an
empty table gives no rows; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import bit_filter, bucketed, passing, salted_join, written

WINDOW, GRAM = 35, 8
#: Entries of one anchor that a task parses together.
HOT_ENTRIES = 1000
#: Words of the entries that are indexed at once.
BLOCK_WORDS = 1 << 16
#: Windows whose anchors are sought at once, and rows in an output batch.
STRIDE, OUT_ROWS = 1 << 16, 50_000


class Words:
    """The words of a text as bytes, joined by single spaces, with their places."""

    def __init__(self, raw: bytes | None):
        self.words = raw.split() if raw else []
        self.line = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1

    def cut(self, start: int, end: int) -> bytes:
        return self.line[int(self.ends[start - 1]) + 1 if start else 0 : int(self.ends[end - 1])]


def anchors(text: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are first with the least hash in some window."""
    import xxhash

    n, reach = len(text.words), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.concatenate([[0], text.ends[: n - gram] + 1]).tolist()
    digest, line = xxhash.xxh64_intdigest, text.line
    hashes = np.fromiter((digest(line[a:b]) for a, b in zip(starts, text.ends[gram - 1 :].tolist(), strict=True)), np.uint64, n - gram + 1)
    views = np.lib.stride_tricks.sliding_window_view(hashes, reach)
    found = [i + np.arange(len(views[i : i + STRIDE])) + views[i : i + STRIDE].argmin(axis=1) for i in range(0, len(views), STRIDE)]
    places = np.unique(np.concatenate(found))
    return places, hashes[places]


def _rows(batches, make, names: list[str], types: list[pa.DataType]):
    """Batches of OUT_ROWS or a few more of the rows that make(batch) yields as lists of columns."""
    held: list[list] = [[] for _ in names]

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], names=names)
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for columns in make(batch):
            for c, more in zip(held, columns, strict=True):
                c.extend(more)
            if len(held[0]) >= OUT_ROWS:
                yield flush()
    if held[0]:
        yield flush()


def _count(batches):
    def make(batch):
        for raw, copies in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            _, hashes = anchors(Words(raw.as_py()))
            yield hashes.astype(np.int64).tolist(), [copies] * len(hashes)

    return _rows(batches, make, ["anchor", "n"], [pa.int64(), pa.int64()])


def _entry_digest(text: Words, at: int) -> int:
    """A hash of a place: its words and how many of them lie before the anchor."""
    import xxhash

    left = max(0, at - (WINDOW - GRAM))
    return xxhash.xxh64_intdigest(text.cut(left, min(len(text.words), at + WINDOW)), at - left)


def _places(batches, repeated: np.ndarray):
    def make(batch):
        for key, raw, copies in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            text = Words(raw.as_py())
            places, hashes = anchors(text)
            mine = passing(repeated, hashes)
            at = places[mine].tolist()
            yield [key.as_py()] * len(at), at, hashes[mine].astype(np.int64).tolist(), np.array([_entry_digest(text, p) for p in at], np.uint64).astype(np.int64).tolist(), [copies] * len(at)

    return _rows(batches, make, ["key", "at", "anchor", "entry", "copies"], [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])


def _entries(batches):
    """(body, places) of texts -> for each place its words, or each of its windows' digests if its anchor is hot."""
    import xxhash

    def make(batch):
        for key, raw, wanted in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            text, columns = Words(raw.as_py()), [[] for _ in range(7)]
            for x in wanted:
                at, n = x["at"], len(text.words)
                left = max(0, at - (WINDOW - GRAM))
                rows = [(left, text.cut(left, min(n, at + WINDOW)), None)]
                if x["hot"]:
                    rows = [(s, None, xxhash.xxh3_128_digest(text.cut(s, s + WINDOW), at - s)) for s in range(left, min(at, n - WINDOW) + 1)]
                for start, words, window in rows:
                    for c, v in zip(columns, (key.as_py(), at, x["anchor"], x["lone"], start, words, window), strict=True):
                        c.append(v)
            yield columns

    return _rows(batches, make, ["key", "at", "anchor", "lone", "start", "words", "window"], [pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()])


class Block:
    """A suffix array over entries (group, distance of the first word from the anchor, words): matches and factors.

    longest[i] is the length of the longest match of position i with another position of the block.
    """

    def __init__(self, entries: list[tuple[int, int, list[bytes]]]):
        known: dict[bytes, int] = {}
        sizes = np.array([len(w) for _, _, w in entries], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.stops = self.starts + sizes
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        group, distance = np.zeros_like(ids), np.zeros_like(ids)
        for (g, d, words), a, b in zip(entries, self.starts.tolist(), self.stops.tolist(), strict=True):
            ids[a:b] = [known.setdefault(w, len(known)) for w in words]
            group[a : b + 1] = g
            distance[a : b + 1] = np.arange(d, d + b + 1 - a)
        # A symbol is a word at its distance from the group's anchor; every entry ends in a symbol of its own.
        ids[self.stops] = len(known) + np.arange(len(entries))
        distance -= distance.min()
        symbols = (group * (int(distance.max()) + 1) + distance) * (len(known) + len(entries)) + ids
        ranks = [np.unique(symbols, return_inverse=True)[1]]
        n, longest_entry = len(ids), int(sizes.max()) + 1
        while 1 << len(ranks) - 1 < longest_entry:
            step, last = 1 << len(ranks) - 1, ranks[-1]
            behind = np.full(n, -1, np.int64)
            behind[: n - step] = last[step:]
            ranks.append(np.unique(last * (n + 1) + behind + 1, return_inverse=True)[1])
        order = np.argsort(ranks[-1], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            common += same << k
            a, b = a + (same << k), b + (same << k)
        self.longest = np.zeros(n, np.int64)
        self.longest[order[:-1]] = common
        self.longest[order[1:]] = np.maximum(self.longest[order[1:]], common)

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, start, length) of the greedy parse of all entries; a word without a match is a factor of length 0."""
        entry, at = np.arange(len(self.starts)), self.starts.copy()
        out = []
        while len(entry):
            size = self.longest[at]
            out.append(np.stack([entry, at, size]))
            at = at + np.maximum(size, 1)
            going = at < self.stops[entry]
            entry, at = entry[going], at[going]
        found = np.concatenate(out, axis=1)
        return tuple(found[:, np.lexsort((found[1], found[0]))])

    def repeated(self, window: int = WINDOW) -> list[tuple[int, int, int]]:
        """(entry, start, length) of spans whose windows all match elsewhere, starts counted within the entry."""
        entry, start, size = self.factors()
        long = size >= window
        found = [np.stack([entry[long], start[long], size[long]])]
        # Windows across a boundary: of the factor before it less than window words, of the one behind it the rest.
        joined = np.flatnonzero((entry[1:] == entry[:-1]) & (size[:-1] > 0) & (size[:-1] + size[1:] >= window))
        e, edge, before, behind = entry[joined], start[joined + 1], size[joined], size[joined + 1]
        for d in range(1, window):
            able = (d < before) & (window - d <= behind)
            hit = able & (self.longest[edge - d] >= window)
            found.append(np.stack([e[hit], (edge - d)[hit], self.longest[edge - d][hit]]))
        rows = np.concatenate(found, axis=1)
        rows[1] -= self.starts[rows[0]]
        return [tuple(r) for r in rows.T.tolist()]


def _parse(batches):
    """Entries sorted by anchor -> (key, first, last) spans of the places that occur once, block by block."""
    held: list[tuple] = []  # (anchor, key, at, lone, start, words)

    def spans(rows: list[tuple]):
        groups: dict[int, int] = {}
        block = Block([(groups.setdefault(r[0], len(groups)), r[4] - r[2], r[5]) for r in rows])
        found = [(rows[e], a, size) for e, a, size in block.repeated() if rows[e][3]]
        columns = [r[1] for r, _, _ in found], [r[4] + a for r, a, _ in found], [r[4] + a + size for r, a, size in found]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["key", "first", "last"])

    size = 0
    for batch in batches:
        for key, at, anchor, lone, start, words in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if size >= BLOCK_WORDS and anchor != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append((anchor, key, at, lone, start, words.split(b" ")))
            size += len(held[-1][5])
    if held:
        yield spans(held)


def _removed(batches):
    """key, copies, n_words, n_removed, kept_sha256 of texts with their repeated spans."""
    for batch in batches:
        n_words, n_removed, sha = [], [], []
        for raw, spans in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            words = (raw.as_py() or b"").split()
            n = len(words)
            if spans:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.clip([x["first"] for x in spans], 0, n), 1)
                np.add.at(edge, np.clip([x["last"] for x in spans], 0, n), -1)
                kept = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                words = [words[i] for i in kept.tolist()]
            n_words.append(n)
            n_removed.append(n - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["key", "copies", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, first, last) word spans, which may overlap, that cover what repeats in texts (key, body, copies), one row a key."""
    spark = texts.sparkSession
    counted = texts.select("body", "copies").mapInArrow(_count, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = spark.sparkContext.broadcast(bit_filter(counted, "anchor"))
    places = written(texts.select("key", "body", "copies").mapInArrow(lambda batches: _places(batches, shared.value), "key binary, at int, anchor bigint, entry bigint, copies bigint"), "places")
    entries = written(places.groupBy("anchor", "entry").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("of")), "entries")

    # What occurs more than once in full is repeated in full.
    full = entries.filter("copies > 1").select(F.struct("anchor", "entry").alias("e"), "n")
    total = places.count()
    whole = salted_join(places.select("key", "at", F.struct("anchor", "entry").alias("e")), full, "e", "n", "key", total)
    whole = whole.select("key", (F.col("at") - (WINDOW - GRAM)).cast("bigint").alias("first"), (F.col("at") + WINDOW).cast("bigint").alias("last"))

    # Of the anchors with several entries, those that occur once are parsed against all.
    blocks = entries.groupBy("anchor").agg(F.count("*").alias("size"), F.min("copies").alias("least")).filter("size > 1 AND least = 1").select("anchor", "size")
    wanted = salted_join(entries, blocks, "anchor", "size", "entry", total)
    wanted = wanted.groupBy(F.col("of.key").alias("key")).agg(F.collect_list(F.struct(F.col("of.at").alias("at"), "anchor", (F.col("copies") == 1).alias("lone"), (F.col("size") > HOT_ENTRIES).alias("hot"))).alias("wanted"))
    cut = written(texts.select("key", "body").join(wanted, "key").mapInArrow(_entries, "key binary, at int, anchor bigint, lone boolean, start int, words binary, window binary"), "entry-words")
    parsed = cut.filter("window IS NULL").drop("window").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_parse, "key binary, first bigint, last bigint")

    windows = cut.filter("window IS NOT NULL")
    # An entry that occurs more often counts as two: all that matters is whether there is another.
    often = windows.groupBy("window").agg(F.sum(F.when(F.col("lone"), 1).otherwise(2)).alias("n"), F.count("*").alias("rows")).filter("n > 1").select("window", "rows")
    lone = salted_join(windows.filter("lone").select("key", "start", "window"), often, "window", "rows", "key", total)
    single = lone.select("key", F.col("start").cast("bigint").alias("first"), (F.col("start") + WINDOW).cast("bigint").alias("last"))
    return whole.unionAll(parsed).unionAll(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every document once the words of its repeated windows are removed."""
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("row"))
    texts = bucketed(rows.groupBy("key").agg(F.first("body").alias("body"), F.count("*").alias("copies")), "texts", "key")
    spans = repeated_spans(texts).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kept = texts.join(spans, "key", "left").select("key", "copies", "body", "spans").mapInArrow(_removed, "key binary, copies bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    kept = written(kept, "kept")
    out = salted_join(rows.select("id", "key", "row"), kept, "key", "copies", "row", rows.count())
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
