"""Derived columns of the population table (the BMI step of the batch job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import age_interval, band_label, bmi, bmi_index, round_even


def enrich(df: DataFrame, height: str = "height", weight: str = "weight",
           age: str = "age") -> DataFrame:
    """Add ``BMI`` (P1), ``BMI_Index`` (P2) and ``age_interval`` (P5)."""
    return (df.withColumn("BMI", bmi(F.col(height), F.col(weight)))
              .withColumn("BMI_Index", bmi_index(F.col("BMI")))
              .withColumn("age_interval", age_interval(F.col(age))))


def with_category(df: DataFrame, idx: str = "BMI_Index", out: str = "BMI_Category",
                  labels=S.BMI_LABELS_SHORT, missing: str | None = None) -> DataFrame:
    """Label column from the band index."""
    return df.withColumn(out, band_label(F.col(idx), labels, missing))


def score(df: DataFrame, height: str = "height", weight: str = "weight",
          labels=S.BMI_LABELS_SHORT, round_first: bool = False) -> DataFrame:
    """BMI rounded to 2 decimals, its band and label in one projection.

    ``round_first=True`` bands the rounded BMI, as the chart step of the
    original does (D11); by default the unrounded BMI is banded.
    """
    raw = bmi(F.col(height), F.col(weight))
    rounded = round_even(raw, 2)
    idx = bmi_index(rounded if round_first else raw)
    return df.select(
        "*",
        rounded.alias("bmi"),
        idx.alias("bmi_index"),
        band_label(idx, labels).alias("bmi_category"),
    )
