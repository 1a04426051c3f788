"""The tables every registered query starts from.

``people``      F2 rows (the ``measurements`` stand-in over ``orders``)
``population``  valid people with BMI, band and age interval (C2, P1, P2, P5)
``log``         submissions in the form's log schema (over ``events``)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import band_label
from ..operators.clean import valid
from ..operators.enrich import enrich
from ..sources import fixtures


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.measurements(spark, sf_dir)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(valid(people(spark, sf_dir)))


def population_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population with the short BMI label (chart step)."""
    x = population(spark, sf_dir)
    return x.withColumn("BMI_Category", band_label(F.col("BMI_Index"), S.BMI_LABELS_SHORT))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.submissions(spark, sf_dir)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.submission_log(spark, sf_dir)
