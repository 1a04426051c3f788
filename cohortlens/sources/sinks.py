"""Writing tables and the submission log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import round_even
from . import storage


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                single_file: bool = False, partition_by: list[str] | None = None) -> str:
    """Write a table; ``single_file`` only for result-sized tables."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def format_log(scored: DataFrame) -> DataFrame:
    """S10 row format: ``%s,%d,%s,%.2f,%.2f,%.2f,%d,%s`` as text columns.

    Numbers are rounded half to even first, so the text is the same in any
    engine; the header names follow the form's log.
    """
    return scored.select(
        F.date_format(F.col("timestamp"), S.SUBMISSION_TS_FORMAT).alias("timestamp"),
        F.format_string("%d", F.col("age")).alias("age"),
        F.col("gender"),
        F.format_string("%.2f", round_even(F.col("height_cm"), 2)).alias("height_cm"),
        F.format_string("%.2f", round_even(F.col("weight_kg"), 2)).alias("weight_kg"),
        F.format_string("%.2f", round_even(F.col("bmi"), 2)).alias("bmi"),
        F.format_string("%d", F.col("index")).alias("index"),
        F.col("category"),
    )


def append_scored(scored: DataFrame, path: str, batch_id: str | int | None = None) -> str:
    """Append formatted rows as one batch; every part file carries the header once.

    The rows are written aside and published by a commit under ``batch_id`` (see
    ``storage``): a batch that is killed shows nothing, and one that is repeated,
    by a retry or a restarted stream, changes nothing.  Without an id every call
    is a batch of its own.
    """
    name = f"batch-{uuid.uuid4().hex if batch_id is None else batch_id}"
    storage.publish(format_log(scored), path, name, lambda df, folder: df.write.option("header", True).csv(folder))
    return path


def _log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folders = sorted(storage.committed(spark, path).values())
    if not folders:
        return spark.createDataFrame([], schema)
    return (spark.read.option("header", True).schema(schema)
            .option("timestampNTZFormat", S.SUBMISSION_TS_FORMAT).csv(folders))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read the published batches of the submission log back with their typed schema."""
    return _log(spark, path, S.SUBMISSION_SCHEMA)


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """The published batches of the submission log as text columns."""
    return _log(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in S.SUBMISSION_SCHEMA.fields]))
