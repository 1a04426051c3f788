"""The registered query of each operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    fill_in_middle, fingerprints, language_id, license_scan, mixing, near_dedup, packing, pii, quality_rules, secret_scan,
    token_alignment, top_k, toxicity,
)
from cohortlens.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit decreasing of all documents' ids into windows of 2048."""
    return packing.pack(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learned from a bounded sample of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.grade(documents(spark, sf_dir), labels)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that disclose it, in every document."""
    return pii.digest(pii.protect(documents(spark, sf_dir)))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.components(documents(spark, sf_dir).select("doc_id", "text")).drop("node")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every document, and the verdict at risk-controlled cutoffs."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules.judge(documents(spark, sf_dir), labels).withColumn(
        "failed_rules", F.array_join("failed_rules", ","))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return license_scan.digest(license_scan.scan(documents(spark, sf_dir)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return language_id.identify(docs.select("doc_id", "text", "lang"), ["doc_id"]).withColumn(
        "held_out", language_id.held_out(F.col("doc_id")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix_sizes(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and reordered, and rebuilt from that."""
    return fill_in_middle.digest(fill_in_middle.transform(documents(spark, sf_dir)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with corpus-wide counts."""
    return token_alignment.linked(documents(spark, sf_dir))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of highest inner product for every hundredth one, among all."""
    return top_k.search(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_pii, op4_near_dedup, op5_quality_rules, op6_license_scan, op7_secret_scan,
    op8_fingerprints, op9_language_id, op10_source_mixing, op11_fill_in_middle, op12_token_alignment, op13_top_k)}

#: DuckDB twins of the queries that SQL can express.
ORACLE: dict[str, str] = {"op10_source_mixing": mixing.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE,
                          "op13_top_k": top_k.ORACLE}
