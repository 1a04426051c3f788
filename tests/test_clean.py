"""Cleaning operators: validity and its exact complement, profile, preview."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean as C
from cohortlens.plans import views


def people(spark):
    rows = [
        (1, "female", 18.0, 144.0, 34.0),   # all edges, valid
        (2, "male", 60.0, 210.0, 120.0),    # upper edges, valid
        (3, "male", 17.9, 170.0, 70.0),     # age out of range
        (4, None, None, 170.0, 70.0),       # missing age
        (5, "female", 30.0, None, 70.0),    # missing height
        (6, "male", 30.0, 211.0, 121.0),    # two ranges
    ]
    return spark.createDataFrame(rows, "person_id long, gender string, age double, height double, weight double")


def test_valid_and_quarantine_partition(spark):
    df = people(spark)
    ok = {r.person_id for r in C.valid(df).collect()}
    bad = {r.person_id: r.reasons for r in C.quarantine(df).collect()}
    assert ok == {1, 2}
    assert set(bad) == {3, 4, 5, 6}
    assert bad[3] == "age:range" and bad[4] == "age:missing"
    assert bad[5] == "height:missing" and bad[6] == "height:range,weight:range"


def test_complement_on_test_data(spark):
    m = views.people(spark, "/root/testdata/sf0.001")
    assert C.valid(m).count() + C.quarantine(m).count() == m.count()


def test_profile(spark):
    p = {r.column: r for r in C.profile(people(spark)).collect()}
    assert p["age"].n_rows == 6 and p["age"].n_missing == 1
    assert p["height"].min == 144.0 and p["height"].max == 211.0
    assert p["gender"].min is None and p["gender"].n_missing == 1


def test_head_is_ordered(spark):
    got = [r.person_id for r in C.head(people(spark), 3, ["person_id"]).collect()]
    assert got == [1, 2, 3]


def test_require_rows(spark):
    empty = people(spark).filter(F.lit(False))
    with pytest.raises(ValueError):
        C.require_rows(empty, "empty")
    with pytest.raises(Exception):
        C.require_rows_lazy(empty, "empty").collect()
    assert C.require_rows_lazy(people(spark)).first().n == 6


def test_valid_submission(spark):
    df = spark.createDataFrame([("25", "170", "70"), ("0", "170", "70"), ("2.5", "170", "70"),
                                ("30", "-1", "70"), ("30", "abc", "70")],
                               "age string, height_cm string, weight_kg string")
    got = C.valid_submissions(df).collect()
    assert len(got) == 1 and got[0].age == 25 and got[0].height_cm == 170.0


def test_round_and_fill(spark):
    df = spark.createDataFrame([(170.5, 70.5, None), (171.5, 69.5, 22.0)],
                               "height double, weight double, BMI double")
    r = C.fill_bmi(C.round_measures(df, digits=0)).collect()
    assert (r[0].height, r[0].weight) == (170, 70) and (r[1].height, r[1].weight) == (172, 70)
    assert r[0].BMI == 70 / ((170 / 100) * (170 / 100)) and r[1].BMI == 22.0


def test_profile_approx_median(spark):
    df = spark.range(1, 1002).selectExpr("id", "cast(id as double) * 2 AS v", "'x' AS s")
    p = {r.column: r for r in C.profile(df, approx_median=True).collect()}
    assert abs(p["v"].median_approx - 1002.0) <= 2 * 1001 / 10000 * 2 + 2
    assert p["s"].median_approx is None and p["id"].n_rows == 1001


def test_quartiles_of_all_columns_from_one_scan(spark):
    df = spark.range(1, 102).selectExpr("id", "cast(id % 7 as double) as v", "cast(null as double) as w", "'x' as s",
                                        "case when id > 3 then cast(id as int) end as k")
    out = C.profile(df, quartiles=True)
    p = {r.column: (r.q1, r.median, r.q3) for r in out.collect()}
    assert p == {"id": (26.0, 51.0, 76.0), "v": (1.0, 3.0, 5.0), "w": (None,) * 3, "s": (None,) * 3, "k": (28.25, 52.5, 76.75)}
    texts = C.profile(df.select("s"), quartiles=True).first()
    assert texts.n_rows == 101 and texts.median is None
