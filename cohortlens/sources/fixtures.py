"""Stand-in inputs over the driver's tables.

The driver's tables hold no people, so two views give rows in the schemas the
jobs expect: ``measurements`` (one person per order) and ``submissions`` (one
form submission per event).  They only shape rows; every operator works on
any data of these schemas and takes nothing from how the rows are made.
The same arithmetic is written as SQL in ``plans.oracle`` for DuckDB.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read as Parquet (filters and columns push down)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _spread(a, b, ka: int, kb: int, mod: int, lo: float) -> "F.Column":
    return F.lit(lo) + ((a * F.lit(ka) + b * F.lit(kb)) % F.lit(mod)) / F.lit(10.0)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People table F2: person_id, gender, age, height, weight."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("person_id"),
        F.when(c % 50 == 0, F.lit(None).cast("string"))
         .when(c % 20 < 9, F.lit("female")).otherwise(F.lit("male")).alias("gender"),
        F.when(k % 97 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(15) + k % 50).cast("int")).alias("age"),
        _spread(k, c, 7919, 31, 750, 140.0).alias("height"),
        _spread(k, c, 104729, 17, 950, 30.0).alias("weight"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission stream F4 stand-in: user_id, event_id, ts, height, weight."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        "user_id", "event_id", "ts",
        _spread(i, u, 7919, 31, 750, 140.0).alias("height"),
        _spread(i, u, 104729, 17, 950, 30.0).alias("weight"),
    )


def submission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions in the form's log schema (F4), one row per event.

    Age and gender are taken from the event row (``user_id``), the measures
    from ``submissions``; score columns are left for the jobs to compute.
    """
    s = submissions(spark, sf_dir)
    u = F.col("user_id")
    return s.select(
        "user_id", "event_id",
        F.col("ts").alias("timestamp"),
        (F.lit(15) + u % 50).cast("int").alias("age"),
        F.when(u % 20 < 9, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.col("height").alias("height_cm"),
        F.col("weight").alias("weight_kg"),
    )
