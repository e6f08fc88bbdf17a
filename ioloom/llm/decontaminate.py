"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark item, or all words of a shorter
item. Patterns of one length share a shift table over blocks of two words: it says how far the
search may skip when a block cannot end a pattern. Where the shift is zero, the suffix block's
bucket names the patterns that may end here, and they are compared directly.

Defined results: null or wordless texts have no words and no hits; very long texts are searched whole; a null
item text yields no pattern; a null item id is listed as the empty string; items that share an id count once; repeated
documents are judged one by one; an empty benchmark contaminates nothing; an empty table gives no rows. Input columns
other than id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import mapped_in_place, quoted, written

WINDOW = 10
#: Bytes of benchmark text compiled into one matcher; a larger benchmark is searched block by block.
MATCHER_BYTES = 2 << 20

#: A-Z to lower case, every other byte that can't be in a word to a space; bytes of 0x80 and more stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class LengthClass:
    """All patterns of one length in words, with their shift table and suffix buckets."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, tuple[str, ...]]] = {}
        for pattern, items in patterns.items():
            words = pattern.split(b" ")
            for end in range(self.block, length + 1):
                block = b" ".join(words[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.bucket.setdefault(b" ".join(words[-self.block :]), {})[pattern] = tuple(sorted(items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(index of the first word, items) of every occurrence."""
        n, length, far, two, get = len(words), self.length, self.far, self.block == 2, self.shift.get
        end = length - 1
        while end < n:
            block = words[end - 1] + b" " + words[end] if two else words[end]
            skip = get(block, far)
            if skip:
                end += skip
                continue
            start = end - length + 1
            items = self.bucket[block].get(b" ".join(words[start : end + 1]))
            if items is not None:
                yield start, items
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                by_length.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add("" if item is None else str(item))
        self.classes = [LengthClass(n, p) for n, p in sorted(by_length.items())]

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        for c in self.classes:
            for start, items in c.occurrences(words):
                yield start, start + c.length, items


def _covered(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of spans, as sorted runs that don't touch."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


_FOUND = "n_words bigint, runs array<struct<first:bigint,last:bigint>>, items array<string>"


def _overlap_batch(ids: pa.Array, name: str, n_words: list, runs: list, items: list) -> pa.RecordBatch:
    spans = [[{"first": a, "last": b} for a, b in x] for x in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=[name, "n_words", "runs", "items"])


def _unite(batches):
    """Findings of several matchers, a document a row: runs united, items sorted and distinct."""
    for batch in batches:
        runs = [_covered([(x["first"], x["last"]) for x in r]) for r in batch.column(2).to_pylist()]
        yield _overlap_batch(batch.column(0), batch.schema.names[0], batch.column(1).to_pylist(), runs, [sorted(set(x)) for x in batch.column(3).to_pylist()])


def _search(batches, matcher: Matcher, every: bool):
    """A row for every document, or for those with a finding."""
    for batch in batches:
        n_words, runs, items = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = words_of(text)
            found, names = [], set()
            for a, b, ids in matcher.spans(words):
                found.append((a, b))
                names.update(ids)
            n_words.append(len(words))
            runs.append(_covered(found))
            items.append(sorted(names))
        out = _overlap_batch(batch.column(0), batch.schema.names[0], n_words, runs, items)
        yield out if every else out.filter(pa.array([bool(r) for r in runs], pa.bool_()))


def _matchers(benchmark: DataFrame, item_col: str, text_col: str, window: int, matcher_bytes: int) -> list[Callable[[], Matcher]]:
    """What makes the benchmark's matchers, one at a time, each of about matcher_bytes of item texts."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("body"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    n = max(1, -(-size // matcher_bytes))
    part = lambda k: items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k)
    return [lambda k=k: Matcher([(r[0], r[1].encode() if r[1] is not None else None) for r in part(k).collect()], window) for k in range(n)]


def _findings(rows: DataFrame, key: str, text: str, makers: list[Callable[[], Matcher]]) -> DataFrame:
    """key, n_words, runs, items of the rows with findings of any matcher, several rows a key where several found some.

    Each block of the benchmark searches rows; its findings, few, are written before the next is compiled.
    """
    kind, out = rows.schema[key].dataType.simpleString(), None
    for make in makers:
        shared = rows.sparkSession.sparkContext.broadcast(make())
        one = rows.select(key, text).mapInArrow(lambda batches, shared=shared: _search(batches, shared.value, False), f"`{key}` {kind}, {_FOUND}")
        one = written(one, "findings")
        shared.destroy()
        out = one if out is None else out.unionAll(one)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, matcher_bytes: int = MATCHER_BYTES) -> DataFrame:
    """One row per document: id, n_words, runs (hit word spans, last exclusive), items (sorted ids).

    The benchmark's size is measured first. Up to matcher_bytes it is compiled once and broadcast. Beyond,
    documents are numbered and written once, every block of items of about that size searches them, and a
    document's findings are united and joined back by its number.
    """
    makers = _matchers(benchmark, item_col, item_text_col, window, matcher_bytes)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_FOUND}"
    if len(makers) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(makers[0]())
        return docs.select(id_col, text_col).mapInArrow(lambda batches: _search(batches, shared.value, True), schema)
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body")), "numbered")
    found = _findings(rows, "row", "body", makers)
    gathered = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    gathered = gathered.mapInArrow(_unite, f"row bigint, {_FOUND}").drop("n_words")
    empty = Matcher([])
    counted = rows.select(F.struct("row", "id").alias("row"), "body").mapInArrow(lambda batches: _search(batches, empty, True), f"row struct<row:bigint,id:{docs.schema[id_col].dataType.simpleString()}>, {_FOUND}")
    out = counted.select(F.col("row.row").alias("row"), F.col("row.id").alias(id_col), "n_words").join(gathered, "row", "left")
    return out.select(id_col, "n_words", *[F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c) for c, kind in (("runs", "array<struct<first:bigint,last:bigint>>"), ("items", "array<string>"))])


def contamination(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: the digest of find_overlaps()."""
    id_col = kwargs.get("id_col", "doc_id")
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return find_overlaps(docs, benchmark, **kwargs).select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", matcher_bytes: int = MATCHER_BYTES) -> DataFrame:
    """docs without its contaminated rows, columns as they were.

    With one matcher the search runs on the same scan as the filter: the text goes through Python once and no
    join or shuffle is needed. With more, rows are numbered and written once and the found numbers are dropped.
    """
    makers = _matchers(benchmark, item_col, item_text_col, WINDOW, matcher_bytes)
    if len(makers) == 1:
        shared, at = docs.sparkSession.sparkContext.broadcast(makers[0]()), docs.columns.index(text_col)
        return mapped_in_place(docs, lambda batches: _keep_clean(batches, at, shared.value))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc")), "numbered")
    found = _findings(rows.select("row", F.col(f"doc.{quoted(text_col)}").alias("body")), "row", "body", makers)
    return rows.join(found.select("row"), "row", "left_anti").select("doc.*")


def _keep_clean(batches, at: int, matcher: Matcher):
    for batch in batches:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        yield batch.filter(pa.array([next(matcher.spans(words_of(t)), None) is None for t in texts], pa.bool_()))
