"""The batch application: read, clean, enrich, analyse, write, chart frames.

``run_batch`` is the whole batch run of the original application as one
Spark job graph: every step is a DataFrame, the CSV outputs are written
with Spark, and the chart steps return the frames the charts are drawn
from instead of drawing them.

    python -m cohortlens.plans.batch --input people.csv --output out/
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import band_label, bmi, bmi_index, percentile_text, round_even
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import distribution as Q
from ..operators import hypothesis as T
from ..operators.enrich import enrich, with_category
from ..session import release, scratch_path
from ..sources import ingest, sinks

# The example person of the chart step (age 21, 68 kg, 160 cm).
EXAMPLE_PERSON = {"age": 21, "weight": 68.0, "height": 160.0}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder: later results read it, and no executor has to keep it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def analyse(clean: DataFrame, enriched: DataFrame | None = None) -> dict[str, DataFrame]:
    """The analysis step on valid rows: derived columns, pivots and both tests.

    The rows are scanned once, for the cells of gender, band and age interval; every
    count, pivot and test is read off that small stored table.
    """
    x = enrich(clean) if enriched is None else enriched
    cells = stored(A.cell_cube(x, "gender", "BMI_Index", "age_interval"), "cells")
    age_band = T.verdict(T.chi_square(cells, "age_interval", "BMI_Index", "n"), S.VERDICT_AGE_BAND)
    known = cells.filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    gender_band = T.verdict(T.chi_square(known, "gender", "BMI_Index", "n"), S.VERDICT_GENDER_BAND)
    return {
        "enriched": x,
        "pct_pivot": A.crosstab_pct(cells, "BMI_Index", "age_interval", S.AGE_LABELS, weight="n"),
        "age_band_counts": A.crosstab_counts(cells, "age_interval", "BMI_Index", [1, 2, 3, 4, 5], weight="n"),
        "chisq_age_band": T.report(age_band, 4, 4),
        "genders": A.levels(cells, "gender"),
        "count_by_gender": A.counts(cells, "gender", name="Count", weight="n"),
        "count_gender_band": A.counts(cells, "gender", "BMI_Index", name="Count", weight="n"),
        "gender_pivot": A.gender_pivot(cells, weight="n"),
        "chisq_gender_band": T.report(gender_band, 4, 6),
    }


def chart_frames(x: DataFrame, person: dict = EXAMPLE_PERSON) -> dict[str, DataFrame]:
    """The frames behind the five charts of the batch run."""
    C.require_rows(x, "The population has no rows to draw charts from.")
    known = x.filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    labelled = with_category(x)
    spark = x.sparkSession
    p = spark.createDataFrame([(person["age"], person["height"], person["weight"])],
                              "age int, height double, weight double")
    b = round_even(bmi("height", "weight"), 2)
    probe = p.select("age", b.alias("bmi"))
    probe = (probe.withColumn("index", bmi_index("bmi"))
                  .withColumn("category", band_label("index", S.BMI_LABELS_SHORT)))
    ranked = Q.percentile_many(x, "BMI", probe, "bmi")
    ranked = (ranked.withColumn("percentile", round_even("percentile", 2))
                    .withColumn("interpretation", percentile_text("percentile")))
    return {
        "scatter_height_weight": Q.scatter_points(known, "weight", "height", ["gender"]),
        "mean_weight_by_age": A.mean_by(x, "age", "weight"),
        "box_height_by_gender": Q.box_stats(known, "height", ["gender"]),
        "bmi_distribution": A.pct_of_total(labelled, "BMI_Category"),
        "bmi_cdf": Q.ecdf(x, "BMI"),
        "bmi_p10_p90": Q.quantiles(x, "BMI", [0.1, 0.9]),
        "example_person": ranked,
    }


CHART_FRAMES = ("scatter_height_weight", "mean_weight_by_age", "box_height_by_gender",
                "bmi_distribution", "bmi_cdf", "bmi_p10_p90", "example_person")


def run_batch(spark: SparkSession, raw_path: str, out_dir: str | None = None,
              charts: bool = False) -> dict[str, DataFrame]:
    """Read a people CSV, clean, analyse, write the three CSVs, return all frames.

    With ``charts`` the frames behind the charts are also written, one
    Parquet table each under ``<out_dir>/charts/``.  The enriched rows are stored
    as Parquet once, and what follows reads its columns from there, not the CSV.
    """
    raw = ingest.read_people(spark, raw_path)
    clean = C.valid(raw)
    enriched = stored(enrich(clean), "enriched")
    frames = {"raw": raw, "invalid": C.quarantine(raw), "clean": clean,
              "profile": C.profile(clean)}
    frames.update(analyse(clean, enriched))
    frames.update(chart_frames(frames["enriched"]))
    if out_dir:
        sinks.write_table(clean, os.path.join(out_dir, "clean_dataset"), fmt="csv")
        sinks.write_table(frames["enriched"], os.path.join(out_dir, "updated_gender_classification_data"),
                          fmt="csv")
        sinks.write_table(frames["gender_pivot"], os.path.join(out_dir, "gender_bmi_pivot_table"),
                          fmt="csv", single_file=True)
        if charts:
            for name in CHART_FRAMES:
                sinks.write_table(frames[name], os.path.join(out_dir, "charts", name))
    return frames


def main(argv=None) -> None:
    from ..session import get_session

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--input", required=True, help="people CSV file or folder")
    ap.add_argument("--output", required=True, help="output folder")
    ap.add_argument("--show", action="store_true", help="print the small result tables")
    ap.add_argument("--charts", action="store_true", help="also write the chart frames (Parquet)")
    ap.add_argument("--master", default=None,
                    help="e.g. local[8]; leave out under spark-submit on a cluster")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    frames = run_batch(spark, args.input, args.output, charts=args.charts)
    if args.show:
        for name in ("pct_pivot", "chisq_age_band", "count_by_gender", "gender_pivot",
                     "chisq_gender_band", "bmi_p10_p90", "example_person"):
            print(f"== {name}")
            frames[name].show(truncate=False)
    release()


if __name__ == "__main__":
    main()
