"""Token-id files: documents in id order as one concatenated id array with Elias-Fano boundaries.

The format is a Parquet table of chunks, so Spark's writers and readers and any Hadoop store can
hold it. A chunk has part and chunk (their order is the order of the ids), doc_ids, n_tokens, ids
(little-endian unsigned integers of id_bytes each) and the Elias-Fano form of the documents' end
offsets: low_bits, low, high, samples. A chunk closes once it holds CHUNK_TOKENS; a document is
never divided. Offsets over the whole array are a chunk's base, a sum over earlier chunks, plus select(i).

Defined results: null text is the end id alone; rows that share an id stay in input order; null ids
come first; an empty table gives no chunks; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ioloom.llm.elias_fano import EliasFano
from ioloom.llm.tokens import encoder

CHUNK_TOKENS = 1 << 19
ID_BYTES = 2
END_ID = 2


def _chunks(batches, path: str, id_type: pa.DataType):
    encode, part, number = encoder(path, False).encode, TaskContext.get().partitionId(), 0
    end = np.array([END_ID], f"<u{ID_BYTES}").tobytes()
    doc_ids, ids, ends, size = [], [], [], 0

    def chunk():
        coded = EliasFano.encode(np.array(ends, np.uint64))
        row = {"part": [part], "chunk": [number], "n_tokens": [size], "id_bytes": [ID_BYTES], "low_bits": [coded.low_bits], "low": [coded.low], "high": [coded.high], "samples": [coded.samples], "ids": [b"".join(ids)]}
        kinds = {"part": pa.int32(), "chunk": pa.int32(), "n_tokens": pa.int64(), "id_bytes": pa.int32(), "low_bits": pa.int32(), "low": pa.binary(), "high": pa.binary(), "samples": pa.binary(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([doc_ids], pa.list_(id_type)), *[pa.array(v, kinds[k]) for k, v in row.items()]], names=["doc_ids", *row])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            coded = encode(text.as_py() or "")
            doc_ids.append(doc_id)
            ids += coded, end
            size += len(coded) // ID_BYTES + 1
            ends.append(size)
            if size >= CHUNK_TOKENS:
                yield chunk()
                doc_ids, ids, ends, size, number = [], [], [], 0, number + 1
    if doc_ids:
        yield chunk()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the chunks of all documents to path. Texts are range-partitioned by id once, as text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "body")
    schema = f"doc_ids array<{kind}>, part int, chunk int, n_tokens bigint, id_bytes int, low_bits int, low binary, high binary, samples binary, ids binary"
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    ordered.mapInArrow(lambda batches: _chunks(batches, tokenizer_path, arrow_kind), schema).write.option("compression", "zstd").parquet(path)


def _documents(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ends = EliasFano(len(r["doc_ids"]), r["low_bits"], r["low"], r["high"], r["samples"]).select(0, len(r["doc_ids"])).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            n = len(ends)
            columns = [pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array([r["part"]] * n, pa.int32()), pa.array([r["chunk"]] * n, pa.int32()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "chunk", "local", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files at path.

    Chunk bases are running sums: over parts, then within each part, never over all chunks at once.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", "chunk", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", earlier(Window.orderBy("part")).alias("before"))
    within = sizes.select("part", "chunk", earlier(Window.partitionBy("part").orderBy("chunk")).alias("inside"))
    base = within.join(parts, "part").select("part", "chunk", (F.col("before") + F.col("inside")).alias("base"))
    rows = files.mapInArrow(_documents, f"doc_id {kind}, part int, chunk int, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(base, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
