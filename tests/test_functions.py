"""Column functions: boundaries, nulls, NaN, ties (FIXTURES F6.5-F6.8)."""

import math

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions import (
    age_interval, band_label, bmi, bmi_index, finite_positive, fmt2, fmt_pct1, percentile_text,
    restrict, round_even, safe_double, safe_int, with_default,
)


def one_col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_safe_double_cases(spark):
    df = one_col(spark, ["abc", " 1.5 ", "1e3", "-inf", "1.0d", "1f", "", None, "NaN", "170", ".5"], "string")
    got = [r[0] for r in df.select(safe_double("v")).collect()]
    assert got[0] is None and got[1] == 1.5 and got[2] == 1000.0 and got[3] == -math.inf
    assert got[4] is None and got[5] is None and got[6] is None and got[7] is None
    assert math.isnan(got[8]) and got[9] == 170.0 and got[10] == 0.5


def test_safe_int(spark):
    df = one_col(spark, ["25", " 7 ", "2.5", "x", "-3"], "string")
    assert [r[0] for r in df.select(safe_int("v")).collect()] == [25, 7, None, None, -3]


def test_bmi_values_and_zero_height(spark):
    df = spark.createDataFrame([(160.0, 68.0), (0.0, 50.0), (None, 50.0)], "h double, w double")
    got = [r[0] for r in df.select(bmi("h", "w")).collect()]
    assert got[0] == 68.0 / ((160.0 / 100) * (160.0 / 100))
    assert got[1] is None and got[2] is None


def test_band_edges_null_nan(spark):
    vals = [18.4999, 18.5, 24.999, 25.0, 29.99, 30.0, 34.99, 35.0, 80.0, None, float("nan")]
    got = [r[0] for r in one_col(spark, vals).select(bmi_index("v")).collect()]
    assert got == [1, 2, 2, 3, 3, 4, 4, 5, 5, None, 5]


def test_band_labels(spark):
    df = spark.createDataFrame([(1,), (4,), (5,), (None,)], "i int")
    short = [r[0] for r in df.select(band_label("i", S.BMI_LABELS_SHORT)).collect()]
    long_ = [r[0] for r in df.select(band_label("i", S.BMI_LABELS_LONG, "Missing")).collect()]
    assert short == ["Underweight", "Obese I", "Obese II+", None]
    assert long_ == ["Underweight", "Obese Class I", "Obese Class II+", "Missing"]


def test_age_interval_edges(spark):
    vals = [18.0, 24.9, 25.0, 35.0, 45.0, 55.0, 60.0, 10.0, None]
    got = [r[0] for r in one_col(spark, vals).select(age_interval("v")).collect()]
    assert got == ["18–24", "18–24", "25–34", "35–44", "45–54", "55–69", "55–69", "18–24", None]


def test_percentile_text(spark):
    got = [r[0] for r in one_col(spark, [0.0, 10.0, 49.99, 50.0, 89.9, 90.0]).select(
        percentile_text("v")).collect()]
    assert got[0] == S.PERCENTILE_TEXTS[0] and got[1] == S.PERCENTILE_TEXTS[1]
    assert got[2] == S.PERCENTILE_TEXTS[2] and got[3] == S.PERCENTILE_TEXTS[3]
    assert got[4] == S.PERCENTILE_TEXTS[4] and got[5] == S.PERCENTILE_TEXTS[5]


def test_round_half_even(spark):
    df = one_col(spark, [0.25, 170.5, 171.5, 2.5, 0.35])
    r1 = [r[0] for r in df.select(round_even("v", 1)).collect()]
    r0 = [r[0] for r in df.select(round_even("v", 0)).collect()]
    assert r1[0] == 0.2  # Spark's round() would give 0.3
    assert r0[1] == 170.0 and r0[2] == 172.0 and r0[3] == 2.0


def test_finite_positive(spark):
    vals = [1.0, 0.0, -2.0, float("nan"), float("inf"), None]
    got = [r[0] for r in one_col(spark, vals).select(finite_positive("v")).collect()]
    assert got[0] is True and got[1] is False and got[2] is False
    assert got[3] is False and got[4] is False and got[5] in (False, None)


def test_defaults_and_restrict(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(with_default("c", "Unknown")).collect()] == ["a", "z", "Unknown"]
    assert [r[0] for r in df.select(restrict("c", ["a"])).collect()] == ["a", "Other", None]


def test_format(spark):
    df = one_col(spark, [26.5625])
    assert df.select(fmt2(round_even("v", 2))).first()[0] == "26.56"
    assert df.select(fmt_pct1(F.col("v"))).first()[0] == "26.6%"
