"""The registry of queries, and rounding that engines agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: The JVM compiles no method of more bytes. Generated code of the wide merge exceeds it and would be interpreted.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tuned(spark: SparkSession) -> SparkSession:
    """spark, planning smaller methods for wide expressions unless the session has its own setting."""
    if spark.conf.get(COMPILED[0], None) in (None, "65535"):
        spark.conf.set(*COMPILED)
    return spark


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(tuned(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def rounded(*columns: str):
    return [r6(F.col(c)).alias(c) for c in columns]


def r6(c: Column) -> Column:
    """Rounding to 6 places that engines agree on."""
    return F.floor(c.cast("double") * 1000000.0 + 0.5) / 1000000.0
