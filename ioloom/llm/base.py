"""What the operators of this subpackage share: tables, the shared scratch folder and joins that hot keys can't stall."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SCRATCH = "ioloom-"
#: A key is hot from this many rows on, and from a 2000th of all rows on: there are 2000 hot keys at most.
HOT_ROWS, HOT_KEYS = 1000, 2000


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, unless they can already.

    On a cluster the package is installed or passed by --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = f"{env.get('PYTHONPATH', '')}:{os.environ.get('PYTHONPATH', '')}".split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only a local session that names no such folder, as in tests, gets one; a cluster's must name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix=SCRATCH)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{SCRATCH}{name}-{uuid.uuid4().hex}"


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def mapped_in_place(df: DataFrame, make: Callable) -> DataFrame:
    """df through mapInArrow with the columns that it has. They travel under plain names: Spark takes a dot for a field."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema.fields)])
    return df.toDF(*plain.names).mapInArrow(make, plain).toDF(*df.columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Its files stay until discarded(), or until the owner of the shared folder clears it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith(SCRATCH):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread_by: str, total: int) -> DataFrame:
    """rows with the other columns of keyed (one row a key; count: how many of rows have the key).

    A hot key's rows are spread by a hash of spread_by over so many salts that each holds few, and the
    key's row is repeated for each salt. The list of hot keys is broadcast: it has HOT_KEYS rows at most.
    """
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    if total <= limit:
        return rows.join(keyed, key)
    salts = F.ceil(F.col(count) / limit).cast("int")
    hot = keyed.filter(F.col(count) > limit).select(F.col(key).alias("hot_key"), salts.alias("hot_salts"))
    left = rows.join(F.broadcast(hot), rows[key] == F.col("hot_key"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("hot_salts")), F.lit(0)).cast("int"))
    right = keyed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(salts - 1, F.lit(0)))).alias("salt"))
    return left.drop("hot_key", "hot_salts").join(right, [key, "salt"]).drop("salt")


#: Bits of a filter that is broadcast, whatever the input's size: 32 MB.
FILTER_BITS = 1 << 28
_BUCKET_BITS = 1 << 15


def bit_filter(hashes: DataFrame, column: str):
    """A bit for each value of a bigint column, by its lowest bits, as bytes of FILTER_BITS / 8 in all.

    A filter of fixed size: values that share a bit let more pass and never less, so what passes is always checked further.
    """
    import numpy as np

    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    buckets = hashes.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    step = _BUCKET_BITS // 8
    for r in buckets.toLocalIterator():  # FILTER_BITS / 2**15 rows of 4 kB at most
        out[(r.bucket - 1) * step : r.bucket * step] = np.frombuffer(r.bits, np.uint8)
    return out


def passing(filter_bytes, hashes):
    """Which of the uint64 hashes have their bit in bit_filter()'s bytes."""
    import numpy as np

    bit = hashes & np.uint64(FILTER_BITS - 1)
    return (filter_bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as written() makes it, in files by a hash of key: joins on key read it where it lies and shuffle the other side only.

    The files are in the shared folder; the session's catalog names the table only while it is looked up.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    named = f"{SCRATCH}{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(named)
    out = spark.table(named)
    out.schema  # noqa: B018 - resolved before the name goes
    spark.sql(f"DROP TABLE {named}")  # an external table: its files stay
    return out
