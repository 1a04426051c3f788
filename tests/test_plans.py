"""The batch application and the analysis script end to end."""

import os

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import aggregate as A
from cohortlens.plans import views
from cohortlens.plans.analysis import run_analysis
from cohortlens.plans.batch import run_batch

SF = "/root/testdata/sf0.001"


def test_batch_run_writes_and_matches_operators(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    views.people(spark, SF).write.option("header", True).csv(raw)
    out = os.path.join(tmp_dir, "out")
    frames = run_batch(spark, raw, out)
    for name in ("clean_dataset", "updated_gender_classification_data", "gender_bmi_pivot_table"):
        assert os.path.isdir(os.path.join(out, name))
    want = {tuple(r) for r in A.gender_pivot(views.population(spark, SF)).collect()}
    got = {tuple(r) for r in spark.read.option("header", True)
           .schema("BMI_Index int, Female_Count bigint, Male_Count bigint, "
                   "Female_Proportion double, Male_Proportion double")
           .csv(os.path.join(out, "gender_bmi_pivot_table")).collect()}
    assert got == want
    assert frames["clean"].count() + frames["invalid"].count() == frames["raw"].count()
    ex = frames["example_person"].first()
    assert ex.bmi == 26.56 and ex.category == "Overweight" and ex.interpretation in S.PERCENTILE_TEXTS
    t = frames["chisq_gender_band"].first()
    assert t.dof == 4 and t.interpretation in S.VERDICT_GENDER_BAND


def test_analysis_script_on_dirty_files(spark, tmp_dir):
    pop = os.path.join(tmp_dir, "pop.csv")
    with open(pop, "w", encoding="utf-8") as f:
        f.write("Height CM;Weight_kg;Gender;Age;Column1\n")
        f.write("170;70;female;30;x\n180.4;90.6;male;40;x\nNA;80;male;Missing;x\n160;abc;female;22;x\n")
    log = os.path.join(tmp_dir, "user.csv")
    with open(log, "w", encoding="utf-8") as f:
        f.write("timestamp,age,gender,height_cm,weight_kg,bmi,index,category\n")
        f.write("2024-01-01 10:00:00,30,Male,180.00,75.00,23.15,2,Normal\n")
        f.write("2024-01-02 10:00:00,31,Female,170.00,70.00,,,\n")
    frames = run_analysis(spark, pop, log)
    s = frames["summary"].first()
    # newest row has no BMI: it is computed from whole-number height and weight
    assert s.user_bmi == 70 / (1.7 * 1.7) and s.user_category == "Normal"
    # population: rows 1 and 2 have BMI (rounded 180 cm, 91 kg for row 2); 3 and 4 do not
    assert s.N == 2
    assert s.percentile == 50.0 and s.below == 0.0 and s.above == 100.0
    assert s.summary.startswith("User BMI = 24.22 (Normal). Percentile = 50.0%")
    assert frames["counts_category_gender"].agg(F.sum("count")).first()[0] == 2


def test_batch_cli(spark, tmp_dir, capsys):
    from cohortlens.plans import batch

    raw = os.path.join(tmp_dir, "raw")
    views.people(spark, SF).write.option("header", True).csv(raw)
    out = os.path.join(tmp_dir, "out")
    batch.main(["--input", raw, "--output", out, "--show", "--charts"])
    text = capsys.readouterr().out
    assert "gender_pivot" in text and "Female_Proportion" in text
    assert sorted(os.listdir(os.path.join(out, "charts"))) == sorted(batch.CHART_FRAMES)
    assert spark.read.parquet(os.path.join(out, "charts", "bmi_cdf")).count() > 0


def test_analysis_cli_writes_frames(spark, tmp_dir, capsys):
    from cohortlens.plans import analysis

    pop = os.path.join(tmp_dir, "pop.csv")
    with open(pop, "w", encoding="utf-8") as f:
        f.write("height,weight,gender,age\n170,70,female,30\n180,90,male,40\n165,60,female,25\n")
    log = os.path.join(tmp_dir, "user.csv")
    with open(log, "w", encoding="utf-8") as f:
        f.write("timestamp;age;gender;height_cm;weight_kg\n2024-01-02 10:00:00;31;Female;170.00;70.00\n")
    out = os.path.join(tmp_dir, "out")
    analysis.main(["--dataset", pop, "--user", log, "--output", out])
    assert "User BMI = 24.22 (Normal)" in capsys.readouterr().out
    assert "summary" in os.listdir(out) and "violin_by_gender" in os.listdir(out)


def test_analyse_scans_its_input_once(spark, tmp_dir):
    from cohortlens.operators import clean as C
    from cohortlens.operators import hypothesis as T
    from cohortlens.operators.enrich import enrich
    from cohortlens.plans import batch

    raw = os.path.join(tmp_dir, "raw")
    views.people(spark, SF).write.parquet(raw)
    clean = C.valid(spark.read.parquet(raw))
    frames = batch.analyse(clean)
    for name, df in frames.items():
        scanned = {f.split("/")[-2] for f in df.inputFiles()}
        assert (scanned == {"raw"}) == (name == "enriched"), name  # all others read the stored cells only
    x = enrich(clean)
    known = x.filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    want = {
        "pct_pivot": A.crosstab_pct(x, "BMI_Index", "age_interval", S.AGE_LABELS),
        "age_band_counts": A.crosstab_counts(x, "age_interval", "BMI_Index", [1, 2, 3, 4, 5]),
        "genders": A.levels(x, "gender"), "count_by_gender": A.counts(x, "gender", name="Count"),
        "count_gender_band": A.counts(x, "gender", "BMI_Index", name="Count"), "gender_pivot": A.gender_pivot(x),
        "chisq_gender_band": T.report(T.verdict(T.chi_square(known, "gender", "BMI_Index")), 4, 6),
        "chisq_age_band": T.report(T.verdict(T.chi_square(x, "age_interval", "BMI_Index"), S.VERDICT_AGE_BAND), 4, 4)}
    for name, df in want.items():
        assert df.schema.simpleString() == frames[name].schema.simpleString()
        assert sorted(map(str, df.collect())) == sorted(map(str, frames[name].collect())), name


def test_the_users_own_point(spark, tmp_dir):
    from cohortlens.plans import analysis

    pop = os.path.join(tmp_dir, "pop.csv")
    with open(pop, "w", encoding="utf-8") as f:
        f.write("height,weight,gender,age\n" + "".join(f"170,{60 + i},female,30\n" for i in range(40)))
    marks = {}
    for name, weight in (("in", "70.00"), ("top", "99.00"), ("out", "30.00")):
        log = os.path.join(tmp_dir, f"{name}.csv")
        with open(log, "w", encoding="utf-8") as f:
            f.write("timestamp;age;gender;height_cm;weight_kg\n2024-01-02 10:00:00;31;Female;170.00;" + weight + "\n")
        frames = analysis.run_analysis(spark, pop, log)
        (mark,) = frames["user_point"].collect()
        marks[name] = mark
        bins = {r.bin: (r.lo, r.hi) for r in frames["histogram"].collect()}
        if name != "out":
            assert bins[mark.bin][0] <= mark.BMI <= bins[mark.bin][1] + 1e-9
    assert (marks["in"].height, marks["in"].weight, marks["in"].user_category) == (170, 70, "Normal")
    assert marks["top"].bin == max(bins) and marks["out"].bin is None and marks["out"].user_category == "Underweight"
