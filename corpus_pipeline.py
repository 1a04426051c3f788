"""A corpus pipeline of the operators: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import language_id, mixing, near_dedup, packing, secret_scan
from cohortlens.llm.common import documents, fresh, stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 9): documents that no learned language accepts go."""
    (rejected,) = fresh(docs, "rejected")
    return language_id.identify(docs).filter(~F.col(rejected)).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (operator 4): one document of each group stays."""
    return near_dedup.unique(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (operator 7): all documents stay, their secrets are replaced."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 10): sources are repeated or thinned to their targets."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 1): one row per piece of the mix, with its ids and its place in a sequence."""
    return packing.pack(docs, keep_ids=True)


STAGES = [("language_id", known_language), ("near_dedup", deduplicated), ("secret_scan", without_secrets),
          ("mixing", mixed), ("packing", packed)]

#: Language models, signatures and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to what the one before it wrote."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
