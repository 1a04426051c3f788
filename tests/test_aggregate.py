"""Counts, pivots, percentages and the dense contingency table."""

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import aggregate as A

# FIXED VALUES: the gender x band counts of the original's pivot file.
F1_COUNTS = {1: (54, 274), 2: (2012, 3099), 3: (2327, 1466), 4: (561, 157), 5: (46, 4)}
F1_FEMALE_PROPORTION = [0.16463414634146342, 0.39366073175503813, 0.6134985499604535,
                        0.7813370473537604, 0.92]


def f1_people(spark):
    """One row per person, expanded from the F1 counts with Spark's explode."""
    rows = [(b, g, n) for b, (f, m) in F1_COUNTS.items() for g, n in (("female", f), ("male", m))]
    cnt = spark.createDataFrame(rows, "BMI_Index int, gender string, n int")
    return cnt.select("BMI_Index", "gender", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_f1_golden_proportions(spark):
    piv = A.gender_pivot(f1_people(spark)).collect()
    assert [r.BMI_Index for r in piv] == [1, 2, 3, 4, 5]
    assert [(r.Female_Count, r.Male_Count) for r in piv] == [F1_COUNTS[i] for i in range(1, 6)]
    assert [r.Female_Proportion for r in piv] == F1_FEMALE_PROPORTION


def test_crosstab_empty_cell_is_null(spark):
    df = spark.createDataFrame([(1, "female"), (1, "male"), (2, "female"), (3, None), (3, "other")],
                               "b int, gender string")
    got = {r.b: (r.Female_Count, r.Male_Count) for r in
           A.crosstab(df, "b", "gender", S.GENDER_LEVELS, S.GENDER_PIVOT_NAMES).collect()}
    assert got == {1: (1, 1), 2: (1, None), 3: (None, None)}
    prop = {r.b: r.Male_Proportion for r in A.with_proportions(
        A.crosstab(df, "b", "gender", S.GENDER_LEVELS, S.GENDER_PIVOT_NAMES)).collect()}
    assert prop[2] is None


def test_pct_within_sums_to_100(spark):
    df = f1_people(spark).withColumn("k", (F.col("i") % 3).cast("string"))
    pct = A.pct_within(A.counts(df, "BMI_Index", "k"), ["BMI_Index"]).collect()
    by = {}
    for r in pct:
        by.setdefault(r.BMI_Index, 0.0)
        by[r.BMI_Index] += r.pct_within_bmi
    assert all(abs(v - 100) <= 0.3 for v in by.values())


def test_contingency_fills_absent_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 2)], "x string, y int")
    got = {(r.x, r.y): r.n for r in A.contingency(df, "x", "y").collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1, ("b", 2): 0}


def test_multi_counts_equal_separate_counts(spark):
    df = f1_people(spark).withColumn("k", (F.col("i") % 2).cast("int"))
    mc = A.multi_counts(df, [["gender"], ["BMI_Index", "k"]]).collect()
    g = {r.gender: r["count"] for r in mc if r.BMI_Index is None and r.k is None}
    assert g == {"female": 5000, "male": 5000}
    assert sum(r["count"] for r in mc if r.gender is None) == 10000


def test_pct_of_total_and_share(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = {r.c: (r.Count, r.Percent) for r in A.pct_of_total(df, "c").collect()}
    assert got == {"a": (2, 66.67), "b": (1, 33.33)}
    s = A.share(spark.range(4).withColumnRenamed("id", "v"), F.col("v") >= 1).first()[0]
    assert s == 75.0


def test_mean_by(spark):
    df = spark.createDataFrame([(20, 60.0), (20, 70.0), (30, None), (None, 50.0)], "age int, weight double")
    assert [(r.age, r.Mean_Weight) for r in A.mean_by(df).collect()] == [(20, 65.0)]
