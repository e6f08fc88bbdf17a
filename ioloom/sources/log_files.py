"""Log files: a listing, one pass over their contents, and a quarantine for those that cannot be read.

A listing reads names and sizes only. The pass reads each file once, as one row, in the task that lists it: what can be
decoded leaves as lines, any other file as one row with its error. Both kinds are written side by side, so that
neither is read twice. A file is decoded within a task, so it has to fit there; logs of one job do.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR_CHARS = 200
#: Lines in an output batch, at most but for those of one file's rest.
OUT_LINES = 50_000
#: Tasks of a pass at most, for each core.
TASKS = 8
_SCHEMA = "file string, line_no bigint, value string, error string"


def listing(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """file, bytes, modified of all files below paths (folders, files or globs) whose names match pattern (a glob)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    read = read.option("pathGlobFilter", pattern) if pattern else read
    return read.load(paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def path_list(spark: SparkSession, list_file: str) -> list[str]:
    """The paths that a text file lists, one a line, without blank lines. Like any list of inputs, they are the driver's."""
    return [r[0] for r in spark.read.text(list_file).select(F.trim("value").alias("p")).filter("p <> ''").collect()]


def first_files(files: DataFrame, cap: int) -> list[str]:
    """The first cap files of a listing by name."""
    return [r[0] for r in files.orderBy("file").limit(cap).select("file").collect()]


def _decoded(content: bytes, must_match: re.Pattern | None) -> list[str]:
    """The lines of a file's content; ValueError if it is no log."""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"broken gzip: {e}") from e
    if not content.strip():
        raise ValueError("empty file")
    lines = content.decode("utf-8").splitlines()
    if must_match and not any(must_match.search(x) for x in lines):
        raise ValueError(f"no log lines: {next(x for x in lines if x.strip()).strip()}")
    return lines


def _scan(batches, must_match: str | None) -> Iterator[pa.RecordBatch]:
    pattern = re.compile(must_match) if must_match else None
    held: tuple[list, ...] = ([], [], [], [])

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "line_no", "value", "error"])
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows = [(file, i, x, None) for i, x in enumerate(_decoded(content.as_py() or b"", pattern))]
            except ValueError as e:  # what is wrong with the content; any other error is the job's
                rows = [(file, None, None, str(e)[:ERROR_CHARS])]
            for i in range(0, len(rows), OUT_LINES):
                for c, more in zip(held, zip(*rows[i : i + OUT_LINES], strict=True), strict=True):
                    c.extend(more)
                if len(held[0]) >= OUT_LINES:
                    yield flush()
    if held[0]:
        yield flush()


def scan(spark: SparkSession, paths: list[str], out: str, pattern: str | None = None, cap: int | None = None, must_match: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, quarantine) of the files below paths, written to out in one pass.

    lines: file, line_no, value. quarantine: file_path, error, timestamp, a row for each file that is empty, is not text
    in UTF-8 (or gzip of it), or has no line that must_match (a regular expression) finds. cap: only the first files by name.
    """
    paths = first_files(listing(spark, paths, pattern), cap) if cap is not None else paths
    if not paths:
        rows = spark.createDataFrame([], _SCHEMA)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        read = read.option("pathGlobFilter", pattern) if pattern and cap is None else read
        # Spark packs few small files into a task; more of them go to one, or there would be a task and two files for every 32 logs.
        rows = read.load(paths).select("path", "content").coalesce(TASKS * spark.sparkContext.defaultParallelism).mapInArrow(lambda batches: _scan(batches, must_match), _SCHEMA)
    rows.withColumn("timestamp", F.current_timestamp()).withColumn("good", F.col("error").isNull()).write.partitionBy("good").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(out)
    read = spark.read.schema(f"{_SCHEMA}, timestamp timestamp, good boolean").parquet(out)
    return read.filter("good").select("file", "line_no", "value"), read.filter("not good").select(F.col("file").alias("file_path"), "error", "timestamp")
