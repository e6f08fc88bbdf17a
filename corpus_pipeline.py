"""A training-corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that its predecessor kept. The first three drop documents, the fourth
replaces secrets in the text of those that stay, the last cuts them into packed pieces.

Defined results: null and empty texts fail the quality rules and go; very long texts pass every stage whole; documents
with a null id are kept like others, one of each group of near-duplicates; rows that agree in id and text are one after
the second stage; an empty documents table gives no pieces; with empty labels the base rules alone judge, and an empty
benchmark contaminates nothing; further columns are carried through to the last stage, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ioloom.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from ioloom.llm.base import discarded, table, written
from ioloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fitted model."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their text."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_stage), ("simhash_dedup", dedup_stage), ("decontaminate", decontaminate_stage), ("secret_scan", secrets_stage), ("packing", packing_stage)]

#: No SQL expresses the fitted stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discarded(docs)
        docs = after
    pieces = written(STAGES[-1][1](spark, docs, sf_dir), "stage-pieces")
    discarded(docs)
    return pieces
