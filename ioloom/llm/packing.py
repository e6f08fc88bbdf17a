"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // MAX_LENGTH pieces of MAX_LENGTH and, for the rest, one piece
for each set bit, longest first. Every piece fills a sequence of its own length, so no sequence holds
two documents and none is padded. Pieces of one length are a bucket: their token ids are written partitioned by length to
the shared folder, numbered within their bucket, and read back from there; a batch is a range of a bucket. Checksums are taken
of the ids that were read back.

A piece is numbered in its bucket by the pieces of earlier input splits plus its place among those of its
own split, which the task that cut it wrote down with it; sequence_id goes through the buckets, shortest first.

Defined results: null text is the end id alone; very long texts are encoded whole; repeated rows are packed as rows of
their own; an empty table gives no pieces; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ioloom.llm.base import scratch_path
from ioloom.llm.tokens import encoder

MAX_LENGTH = 1024
END_ID = 0
#: Pieces and bytes of ids in an output batch at most, but for one piece.
BATCH_PIECES, BATCH_BYTES = 50_000, 16 << 20


def decompose(n: int, longest: int = MAX_LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if n - start >= 1 << bit:
            yield start, 1 << bit
            start += 1 << bit


def _pieces(batches, path: str, longest: int):
    encode, part = encoder(path, True).encode, TaskContext.get().partitionId()
    numbers: dict[int, int] = {}  # pieces so far, by length
    for batch in batches:
        rows, start, length, nth, total, ids, size = [], [], [], [], [], [], 0

        def flush(ids_of=batch.column(0)):
            columns = [ids_of.take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, nth, total)], pa.array([part] * len(rows), pa.int64()), pa.array(ids, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "nth", "doc_tokens", "part", "ids"])
            for column in (rows, start, length, nth, total, ids):
                column.clear()
            return out

        for row, text in enumerate(batch.column(1)):
            tokens = np.append(np.frombuffer(encode(text.as_py() or ""), "<u2").astype("<u4"), np.uint32(END_ID)).astype("<u4").tobytes()
            n = len(tokens) // 4
            for at, many in decompose(n, longest):
                rows.append(row)
                start.append(at)
                length.append(many)
                nth.append(numbers.get(many, 0))
                numbers[many] = nth[-1] + 1
                total.append(n)
                ids.append(tokens[4 * at : 4 * (at + many)])
                size += 4 * many
                if len(rows) >= BATCH_PIECES or size >= BATCH_BYTES:
                    yield flush()
                    size = 0
        if rows:
            yield flush()


def write_buckets(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH) -> None:
    """Writes the pieces of all documents to path, a folder length=<n> per bucket; ids are little-endian unsigned 32-bit integers."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, nth bigint, doc_tokens bigint, part bigint, ids binary"
    pieces = docs.select(id_col, text_col).mapInArrow(lambda batches: _pieces(batches, tokenizer_path, longest), schema)
    # An empty table has no bucket; the file without rows keeps the columns readable.
    pieces.write.option("compression", "zstd").partitionBy("length").parquet(path)


def read_buckets(spark: SparkSession, path: str, kind: str, id_col: str = "doc_id") -> DataFrame:
    """id (of a kind), start, length, ids, ids_crc32, doc_tokens, bucket_place, sequence_id, offset of every piece at path."""
    pieces = spark.read.schema(f"id {kind}, start bigint, nth bigint, doc_tokens bigint, part bigint, ids binary, length bigint").parquet(path)
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    within = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    buckets = sizes.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("bucket"))
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before")).join(F.broadcast(buckets), "length")
    placed = pieces.withColumn("ids_crc32", F.crc32("ids")).join(base, ["length", "part"])
    place = F.col("before") + F.col("nth")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids", "ids_crc32", "doc_tokens", place.alias("bucket_place"), (F.col("bucket") + place).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece, as read_buckets() reads it back from buckets in the shared folder."""
    path = scratch_path(docs.sparkSession, "buckets")
    write_buckets(docs, path, tokenizer_path, id_col, text_col, longest)
    return read_buckets(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString(), id_col)
