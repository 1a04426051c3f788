"""The analysis script: a population file and a submission log, in any dialect.

``run_analysis`` reads both files (delimiter detected, headers harmonised,
null tokens removed, numbers coerced), rounds height and weight to whole
numbers, fills a missing BMI from them, takes the newest submission as the
current user and scores it against the population.  It returns the summary
row and the frames behind the six charts.

    python -m cohortlens.plans.analysis --dataset pop.csv --user log.csv
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import band_label, bmi_index, fmt2, fmt_pct1, restrict, round_even
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import distribution as Q
from ..operators import users as R
from ..session import release
from ..sources import ingest


def load(spark: SparkSession, path: str, collapse_repeated: bool = False) -> DataFrame:
    """One file: dialect, harmonised headers, null tokens, numbers, whole-number
    height and weight, BMI filled from them where absent (S2-S6, C1, C5, C6)."""
    df = ingest.read_mixed(spark, [path], collapse_repeated=collapse_repeated, source_col=None)
    return C.fill_bmi(C.round_measures(df, ["height", "weight"], digits=0))


def newest(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The newest row of a whole table (one row): ``max_by`` over ``order``,
    ties broken by all columns in order; a partial aggregate, so no task
    holds more than its own rows."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*keys, *[F.col(c) for c in df.columns])
    return df.agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), key).alias("r")).select("r.*")


def summary(pop: DataFrame, user: DataFrame) -> DataFrame:
    """User BMI, band, label, percentile (<=), overweight share, below (<), above."""
    valid = C.finite_positive_rows(pop, "BMI")
    C.require_rows(valid, "The population has no valid BMI.")
    C.require_rows(user.filter(F.col("BMI").isNotNull()),
                   "The newest submission has no BMI and no measures to compute it from.")
    u = user.select(F.col("BMI").alias("user_bmi"))
    u = (u.withColumn("user_index", bmi_index("user_bmi"))
          .withColumn("user_category",
                      band_label("user_index", S.BMI_LABELS_SHORT, S.MISSING_CATEGORY)))
    s = R.cohort_summary(valid, u, "user_bmi", "BMI", S.OVERWEIGHT_CUT)
    line1 = F.format_string("User BMI = %s (%s). Percentile = %s",
                            fmt2(round_even("user_bmi", 2)), F.col("user_category"),
                            fmt_pct1(round_even("percentile", 1)))
    line2 = F.format_string("Overweight+ share = %s | Below user = %s | Above user = %s",
                            fmt_pct1(round_even("overweight_share", 1)),
                            fmt_pct1(round_even("below", 1)), fmt_pct1(round_even("above", 1)))
    return s.withColumn("summary", line1).withColumn("shares", line2)


def user_point(user: DataFrame, summarised: DataFrame, bins: DataFrame) -> DataFrame:
    """The user's own mark on the charts, one row: height, weight and BMI (scatter), category
    (box), and the histogram ``bin`` that the BMI falls in, null beyond the bins."""
    u = user.select("height", "weight", F.col("BMI").cast("double").alias("BMI"))
    marks = summarised.select("user_index", "user_category", "percentile")
    one = u.join(F.broadcast(marks))  # one row each
    found = F.max(F.when((F.col("BMI") >= F.col("lo")) & (F.col("BMI") <= F.col("hi")), F.col("bin")))
    hit = bins.select("bin", "lo", "hi").join(F.broadcast(one.select("BMI"))).agg(found.alias("bin"))  # a row per bin
    return one.join(F.broadcast(hit))


def _inputs(spark, dataset_path, user_path, order, collapse_repeated):
    pop = load(spark, dataset_path, collapse_repeated)
    log = load(spark, user_path, collapse_repeated)
    C.require_rows(log, "The submission log has no rows.")
    return pop, newest(log, list(order))


def analysis_summary(spark: SparkSession, dataset_path: str, user_path: str,
                     order: Sequence[Column | str] = ("timestamp",),
                     collapse_repeated: bool = False) -> DataFrame:
    """Both files -> the one-row summary only (no chart frames)."""
    pop, user = _inputs(spark, dataset_path, user_path, order, collapse_repeated)
    return summary(pop, user)


def run_analysis(spark: SparkSession, dataset_path: str, user_path: str,
                 order: Sequence[Column | str] = ("timestamp",), collapse_repeated: bool = False
                 ) -> dict[str, DataFrame]:
    """Both files -> summary row and chart frames."""
    pop, user = _inputs(spark, dataset_path, user_path, order, collapse_repeated)
    valid = C.finite_positive_rows(pop, "BMI")
    cat = band_label(bmi_index("BMI"), S.BMI_LABELS_SHORT, S.MISSING_CATEGORY)
    labelled = valid.withColumn("BMI_cat", restrict(cat, S.BMI_LABELS_SHORT))
    known = valid.filter(F.col("gender").isNotNull())
    summarised, bins = summary(pop, user), Q.histogram(valid, "BMI", S.HISTOGRAM_BINS)
    return {
        "summary": summarised,
        "user_point": user_point(user, summarised, bins),
        "histogram": bins,
        "ecdf": Q.ecdf(valid, "BMI"),
        "scatter": Q.scatter_points(pop, "height", "weight", value="BMI"),
        "box_by_category": Q.box_stats(labelled, "BMI", ["BMI_cat"]),
        "outliers_by_category": Q.outliers(labelled, "BMI", ["BMI_cat"]),
        "counts_category_gender": A.category_gender_counts(labelled, "BMI_cat", "gender"),
        "violin_by_gender": Q.density(known, "BMI", ["gender"]),
        "box_by_gender": Q.box_stats(known, "BMI", ["gender"]),
    }


def main(argv=None) -> None:
    from ..session import get_session

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--dataset", required=True)
    ap.add_argument("--user", required=True)
    ap.add_argument("--collapse-repeated", action="store_true")
    ap.add_argument("--output", default=None,
                    help="folder for the summary and chart frames (Parquet, one table each)")
    ap.add_argument("--master", default=None,
                    help="e.g. local[8]; leave out under spark-submit on a cluster")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    frames = run_analysis(spark, args.dataset, args.user, collapse_repeated=args.collapse_repeated)
    for r in frames["summary"].collect():
        print(r["summary"])
        print(r["shares"])
    if args.output:
        import os

        from ..sources.sinks import write_table

        for name, df in frames.items():
            write_table(df, os.path.join(args.output, name))
    release()


if __name__ == "__main__":
    main()
