"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver's tables through the views
in ``views`` and returns a DataFrame whose columns are named exactly as in
the matching DuckDB SQL of ``oracle``.  Round trips through files write to a
new folder under the shared checkpoint directory.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import (
    age_interval, band, band_label, bmi, bmi_index, fmt2, fmt_pct1, percentile_text, restrict,
    round_even, safe_double, safe_int, with_default,
)
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import distribution as Q
from ..operators import hypothesis as T
from ..operators import users as R
from ..operators.enrich import score
from ..session import scratch_path
from ..sources import ingest, sinks
from ..sources.fixtures import table
from ..streaming import stream as W
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]

# The example person of the chart step: 68 kg, 160 cm (BMI 26.5625).
EXAMPLE_BMI = 68.0 / ((160.0 / 100.0) * (160.0 / 100.0))


# ---------------------------------------------------------------- sources ---

def read_people_q(spark, sf):
    """The people table written as CSV text, read back and coerced."""
    path = scratch_path(spark, "people-csv")
    sinks.write_table(V.people(spark, sf), path, fmt="csv")
    return ingest.read_people(spark, path)


def _people_by_dialect(people: DataFrame, root: str) -> None:
    """All people dealt out to three files' worth of one folder, each with its own delimiter and headers."""
    dealt = people.withColumn("__part", F.pmod(F.xxhash64("person_id"), F.lit(3)))
    for part, (name, sep, token) in enumerate((("tab", "\t", "NA"), ("semicolon", ";", "Missing"), ("comma", ",", "Nil"))):
        heads = {"Height CM": "height", "Weight_kg": "weight"} if part != 1 else {"weight": "weight", "HEIGHT_cm": "height"}
        (dealt.filter(F.col("__part") == part)
              .select(F.col("person_id").alias("Person ID"), F.col("gender").alias("Gender"), F.col("age").alias("Age"),
                      *[F.col(c).alias(h) for h, c in heads.items()], F.lit(f"{sep}x").alias(f"Column{part}"))
              .write.option("header", True).option("sep", sep).option("nullValue", token).csv(os.path.join(root, name)))


def read_mixed_q(spark, sf):
    """One folder of tab, ``;`` and ``,`` files with messy headers, and a ``;`` log, read as one table."""
    p1 = scratch_path(spark, "mixed-people")
    p2 = scratch_path(spark, "mixed-log")
    _people_by_dialect(V.people(spark, sf), p1)
    lg = V.log(spark, sf).select(
        "user_id", "event_id", F.date_format("timestamp", S.SUBMISSION_TS_FORMAT).alias("timestamp"),
        "age", "gender", "height_cm", "weight_kg")
    (lg.write.option("header", True).option("sep", ";").option("nullValue", "Missing").csv(p2))
    out = ingest.read_mixed(spark, [p1, p2], source_col=None)
    return out.select(
        F.when(F.col("person_id").isNotNull(), F.lit("people")).otherwise(F.lit("log")).alias("source"),
        safe_int(F.coalesce(F.col("person_id"), F.col("event_id")), "bigint").alias("row_id"),
        "height", "weight", "BMI", "BMI_index", "gender", "age")


def write_clean_q(spark, sf):
    """Valid rows written as Parquet and read back."""
    path = scratch_path(spark, "clean")
    sinks.write_table(C.valid(V.people(spark, sf)), path)
    return spark.read.parquet(path)


def write_enriched_q(spark, sf):
    """Enriched rows written as Parquet and read back."""
    path = scratch_path(spark, "enriched")
    sinks.write_table(V.population(spark, sf), path)
    return spark.read.parquet(path)


def write_pivot_q(spark, sf):
    """The gender pivot written as one CSV file with header and read back."""
    path = scratch_path(spark, "pivot")
    sinks.write_table(A.gender_pivot(V.population(spark, sf)), path, fmt="csv", single_file=True)
    return (spark.read.option("header", True)
            .schema("BMI_Index int, Female_Count bigint, Male_Count bigint, "
                    "Female_Proportion double, Male_Proportion double").csv(path))


def append_submissions_q(spark, sf):
    """Scored submissions appended in two batches, the first of them twice; the log read back as text."""
    path = scratch_path(spark, "user-log")
    scored = W.score_submissions(V.log(spark, sf))
    first = F.coalesce(F.col("timestamp") < F.lit("2024-01-04").cast("timestamp_ntz"), F.lit(False))
    for batch_id, rows in ((0, scored.filter(first)), (1, scored.filter(~first)), (0, scored.filter(first))):
        sinks.append_scored(rows, path, batch_id)
    return sinks.read_log_text(spark, path)


# --------------------------------------------------------------- cleaning ---

def safe_numeric_q(spark, sf):
    """Numeric text and JSON text of ``events`` through ``safe_double``."""
    e = table(spark, sf, "events")
    return e.select("event_id", safe_double(F.col("value").cast("string")).alias("value_num"),
                    safe_double(F.col("props")).alias("props_num"))


def valid_rows_q(spark, sf):
    return C.valid(V.people(spark, sf))


def invalid_rows_q(spark, sf):
    return C.quarantine(V.people(spark, sf))


def round_measure_q(spark, sf):
    return C.round_measures(V.people(spark, sf), digits=1)


def round_int_q(spark, sf):
    return C.round_measures(V.people(spark, sf), digits=0)


# Given values as a dirty file has them, dealt out to rows by their id; the rest have none.
GIVEN_BMI = ("22.5", "0", "-3.25", "abc", " 1e2 ", "31.0x")
NOT_FINITE = ("NaN", "inf", "-Infinity")
BAD_AGES, BAD_MEASURES = ("0", "-4", "31.5", "old"), ("0", "-1.5", "tall", "")
GIVEN_CATEGORIES = ("Normal", "Gigantic", "normal")


def _dealt(key: str, values: tuple[str, ...], of: int) -> "F.Column":
    """The i-th value for keys whose rest by ``of`` is i, null for all others."""
    out = None
    for i, v in enumerate(values):
        hit = F.pmod(F.col(key), F.lit(of)) == i
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


def _people_with_given(spark, sf, given: tuple[str, ...]):
    rounded = C.round_measures(V.people(spark, sf), digits=0)
    return rounded.withColumn("BMI", safe_double(_dealt("person_id", given, 13)))


def fill_derived_q(spark, sf):
    """C6 after C5: a given BMI (zero, negative, odd text too) is kept if it is a number, else
    computed from whole-number height and weight."""
    return C.fill_bmi(_people_with_given(spark, sf, GIVEN_BMI))


def finite_positive_q(spark, sf):
    """Given and computed BMI; zero, negative, NaN and infinite ones go."""
    return C.finite_positive_rows(C.fill_bmi(_people_with_given(spark, sf, GIVEN_BMI + NOT_FINITE)))


def require_rows_q(spark, sf):
    return C.require_rows_lazy(C.require_rows(V.people(spark, sf), "empty population"))


def valid_submission_q(spark, sf):
    """The form's rows as text, with ages and measures that it refuses among them."""
    text = V.log(spark, sf).select(
        "user_id", "event_id",
        F.coalesce(_dealt("event_id", BAD_AGES, 29), F.col("age").cast("string")).alias("age"),
        F.coalesce(_dealt("event_id", BAD_MEASURES, 31), F.col("height_cm").cast("string")).alias("height_cm"),
        F.coalesce(_dealt("event_id", BAD_MEASURES, 37), F.col("weight_kg").cast("string")).alias("weight_kg"))
    return C.valid_submissions(text)


def complete_cases_q(spark, sf):
    return C.complete_cases(V.people(spark, sf), ["gender", "age"])


def gender_subset_q(spark, sf):
    return C.subset_equal(V.population(spark, sf), "gender", "male")


def profile_q(spark, sf):
    """C12 with the exact quartiles of all numeric columns from one order pass."""
    p = C.profile(V.people(spark, sf), quartiles=True)
    return p.withColumn("mean", round_even(F.col("mean"), 6))


def preview_q(spark, sf):
    return C.head(V.population(spark, sf), 5, ["person_id"])


# ------------------------------------------------------------ projections ---

def bmi_q(spark, sf):
    m = V.people(spark, sf)
    return m.select("person_id", bmi("height", "weight").alias("BMI"))


def band_index_q(spark, sf):
    m = V.people(spark, sf)
    return m.select("person_id", bmi_index(bmi("height", "weight")).alias("BMI_Index"))


def band_label_q(spark, sf):
    x = V.population(spark, sf)
    return x.select("person_id", band_label("BMI_Index", S.BMI_LABELS_SHORT).alias("BMI_Category"))


def band_label_long_q(spark, sf):
    x = V.population(spark, sf)
    return x.select("person_id", band_label("BMI_Index", S.BMI_LABELS_LONG).alias("category"))


def age_interval_q(spark, sf):
    m = V.people(spark, sf)
    return m.select("person_id", age_interval("age").alias("age_interval"))


def percentile_text_q(spark, sf):
    """P6 on every person's own percentile in the population."""
    x = V.population(spark, sf)
    ranked = Q.percentile_many(x, "BMI", x.select("person_id", "BMI"), "BMI")
    return ranked.select("person_id", "percentile",
                         percentile_text("percentile").alias("interpretation"))


def default_level_q(spark, sf):
    """Null gender -> ``Unknown``; a label outside the five (``Missing``
    for a null BMI) -> ``Other``, as the category chart does."""
    x = V.people(spark, sf).withColumn("BMI_Index", bmi_index(bmi("height", "weight")))
    given = _dealt("person_id", GIVEN_CATEGORIES, 17)  # as a file may bring them; one of them is known
    cat = F.coalesce(given, band_label("BMI_Index", S.BMI_LABELS_SHORT, S.MISSING_CATEGORY))
    return x.select("person_id",
                    with_default("gender", S.UNKNOWN_GENDER).alias("gender"),
                    restrict(cat, S.BMI_LABELS_SHORT).alias("category"))


def score_person_q(spark, sf):
    s = score(V.submissions(spark, sf), labels=S.BMI_LABELS_SHORT)
    return s.select("user_id", "event_id", "bmi", "bmi_index", "bmi_category")


def format_report_q(spark, sf):
    """Each user's summary line values as text."""
    r = _users(spark, sf)
    return r.select("user_id",
                    fmt2(round_even("user_bmi", 2)).alias("bmi_text"),
                    fmt_pct1(round_even("percentile", 1)).alias("percentile_text"),
                    fmt_pct1(round_even("below", 1)).alias("below_text"))


# ----------------------------------------------------------- aggregations ---

def distinct_levels_q(spark, sf):
    return A.levels(V.population(spark, sf), "gender")


def count_by_gender_q(spark, sf):
    return A.counts(V.population(spark, sf), "gender", name="Count")


def count_band_age_q(spark, sf):
    return A.counts(V.population(spark, sf), "BMI_Index", "age_interval")


def count_gender_band_q(spark, sf):
    return A.counts(V.population(spark, sf), "gender", "BMI_Index", name="Count")


def count_category_gender_q(spark, sf):
    x = V.population(spark, sf).withColumn(
        "BMI_cat", band_label("BMI_Index", S.BMI_LABELS_SHORT, S.MISSING_CATEGORY))
    return A.category_gender_counts(x)


def all_counts_q(spark, sf):
    return A.multi_counts(V.population(spark, sf),
                          [["gender"], ["BMI_Index", "age_interval"], ["gender", "BMI_Index"]])


def cell_cube_counts_q(spark, sf):
    """A6 from the cell cube: one scan gives the cells, and every count is a sum of them."""
    cells = A.cell_cube(V.population(spark, sf), "gender", "BMI_Index", "age_interval")
    return A.multi_counts(cells, [["gender"], ["BMI_Index", "age_interval"], ["gender", "BMI_Index"]], weight="n")


def pct_within_band_q(spark, sf):
    return A.pct_within(A.counts(V.population(spark, sf), "BMI_Index", "age_interval"), ["BMI_Index"])


def pct_pivot_q(spark, sf):
    return A.crosstab_pct(V.population(spark, sf), "BMI_Index", "age_interval", S.AGE_LABELS)


def pct_of_total_q(spark, sf):
    return A.pct_of_total(V.population_labelled(spark, sf), "BMI_Category")


def gender_pivot_q(spark, sf):
    return A.crosstab(V.population(spark, sf), "BMI_Index", "gender",
                      S.GENDER_LEVELS, S.GENDER_PIVOT_NAMES)


def gender_proportions_q(spark, sf):
    return A.gender_pivot(V.population(spark, sf))


def contingency_q(spark, sf):
    return A.contingency(V.population(spark, sf), "age_interval", "BMI_Index")


def mean_by_age_q(spark, sf):
    m = A.mean_by(V.population(spark, sf), "age", "weight")
    return m.withColumn("Mean_Weight", round_even("Mean_Weight", 9))


def share_at_least_q(spark, sf):
    return A.share(V.population(spark, sf), F.col("BMI") >= F.lit(S.OVERWEIGHT_CUT), "overweight_share")


def cohort_summary_q(spark, sf):
    probes = R.latest(V.submissions(spark, sf), "user_id", ["ts", "event_id"])
    probes = probes.select("user_id", bmi("height", "weight").alias("user_bmi"))
    return R.cohort_summary(V.population(spark, sf), probes, "user_bmi")


# ----------------------------------------------------------- distribution ---

def quantiles_q(spark, sf):
    return Q.quantiles(V.population(spark, sf), "BMI", [0.1, 0.9])


# Rank errors that the approximate quantiles are held to: 1 / accuracy, and the sketch's default size.
APPROX_ERROR, SKETCH_ERROR = 1 / 10_000, 0.02


def quantiles_approx_q(spark, sf):
    """Q2: approximate quantiles, each with the certificate of its exact ranks."""
    x = V.population(spark, sf)
    found = Q.quantiles_approx(x, "BMI", [0.1, 0.5, 0.9])
    return Q.rank_certificates(found, Q.cumulative(x, "BMI"), APPROX_ERROR).select("p", "n", "within")


def quantiles_sketch_q(spark, sf):
    """Q2 at scale: one KLL sketch per event type and day, merged per type, with certificates."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = Q.quantile_sketches(e, "value", ["event_type", "day"])
    found = Q.sketch_quantiles(daily, [0.1, 0.5, 0.9], ["event_type"])
    cum = Q.cumulative(e.filter(~F.isnan("value")), "value", ["event_type"])
    return Q.rank_certificates(found, cum, SKETCH_ERROR, ["event_type"]).select("event_type", "p", "n", "within")


def ecdf_q(spark, sf):
    return Q.ecdf(V.population(spark, sf), "BMI")


def percentile_of_q(spark, sf):
    return Q.percentile_of(V.population(spark, sf), "BMI", round(EXAMPLE_BMI, 2))


def percentile_many_q(spark, sf):
    probes = V.submissions(spark, sf).select(
        "user_id", "event_id", bmi("height", "weight").alias("bmi"))
    return Q.percentile_many(V.population(spark, sf), "BMI", probes, "bmi")


def below_above_q(spark, sf):
    return Q.below_above(V.population(spark, sf), "BMI", EXAMPLE_BMI)


def histogram_q(spark, sf):
    return Q.histogram(V.population(spark, sf), "BMI", S.HISTOGRAM_BINS)


def box_by_gender_q(spark, sf):
    x = V.population(spark, sf).filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    return Q.box_stats(x, "height", ["gender"]).withColumn("mean", round_even("mean", 9))


def box_by_category_q(spark, sf):
    x = V.population_labelled(spark, sf)
    return Q.box_stats(x, "BMI", ["BMI_Category"]).withColumn("mean", round_even("mean", 9))


def box_outliers_q(spark, sf):
    x = V.population_labelled(spark, sf)
    return Q.outliers(x, "BMI", ["BMI_Category"]).select("person_id", "BMI_Category", "BMI")


def violin_by_gender_q(spark, sf):
    x = V.population(spark, sf).filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    d = Q.density(x, "BMI", ["gender"], grid=64)
    return d.select("gender", "point", round_even("x", 9).alias("x"),
                    round_even("density", 5).alias("density"))


def scatter_gender_q(spark, sf):
    x = V.population(spark, sf).filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    return Q.scatter_bins(x, "weight", "height", ["gender"], 1.0, 1.0)


def scatter_bmi_q(spark, sf):
    d = Q.scatter_bins(V.population(spark, sf), "height", "weight", [], 1.0, 1.0, value="BMI")
    return d.withColumn("mean_BMI", round_even("mean_BMI", 9))


# -------------------------------------------------------------- tests -------

def _chisq(spark, sf, a, b, name, texts):
    res = T.chi_square(V.population(spark, sf), a, b)
    return T.report(T.verdict(res, texts)).select(F.lit(name).alias("test"), "*")


def chisq_age_band_q(spark, sf):
    return _chisq(spark, sf, "age_interval", "BMI_Index", "age_interval x BMI_Index",
                  S.VERDICT_AGE_BAND)


def chisq_gender_band_q(spark, sf):
    x = V.population(spark, sf).filter(F.col("gender").isin(list(S.GENDER_LEVELS)))
    res = T.chi_square(x, "gender", "BMI_Index")
    return T.report(T.verdict(res, S.VERDICT_GENDER_BAND)).select(
        F.lit("gender x BMI_Index").alias("test"), "*")


def verdict_q(spark, sf):
    a = chisq_age_band_q(spark, sf)
    g = chisq_gender_band_q(spark, sf)
    return a.unionByName(g).select("test", "p_value", "significant", "interpretation")


# ------------------------------------------------------------- users --------

def _users(spark, sf):
    return R.compare_users(V.submissions(spark, sf), V.population(spark, sf))


def latest_row_q(spark, sf):
    return R.latest(V.submissions(spark, sf), "user_id", ["ts", "event_id"])


def user_vs_population_q(spark, sf):
    return _users(spark, sf).select("user_id", "event_id", "user_bmi", "user_index",
                                    "user_category", "percentile", "below", "above",
                                    "interpretation")


def sort_values_q(spark, sf):
    """BMI values in global order, each with its position and rank."""
    x = V.population(spark, sf).select("person_id", "BMI")
    return Q.global_order(x, "BMI", ["person_id"])


# ---------------------------------------------------------- streaming -------

def _log_source(spark, sf) -> tuple[str, DataFrame]:
    """Submission log files in two batches (by time) in a new folder."""
    src = scratch_path(spark, "log-src")
    lg = V.log(spark, sf)
    first = F.col("timestamp") < F.lit("2024-01-04").cast("timestamp_ntz")
    lg.filter(first).write.parquet(os.path.join(src, "part=0"))
    lg.filter(~F.coalesce(first, F.lit(False))).write.parquet(os.path.join(src, "part=1"))
    return src, lg


def _stream_src(spark, src, schema, by_file=True):
    """The log as a stream, a file per micro-batch; files are not in order of time, so a
    query with a watermark takes all that are there."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (r.option("maxFilesPerTrigger", 1) if by_file else r).parquet(src)


def stream_score_q(spark, sf):
    src, lg = _log_source(spark, sf)
    out, ck = scratch_path(spark, "w1-out"), scratch_path(spark, "w1-ck")
    q = W.start_score(_stream_src(spark, src, lg.schema), out, ck)
    q.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", "bmi", "index", "category")


def stream_percentile_q(spark, sf):
    src, lg = _log_source(spark, sf)
    out, ck = scratch_path(spark, "w2-out"), scratch_path(spark, "w2-ck")
    snapshot = W.percentile_snapshot(V.population(spark, sf), "BMI")
    scored = W.score_submissions(_stream_src(spark, src, lg.schema))
    q = W.start_percentile(scored, snapshot, out, ck)
    q.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", "bmi", "percentile", "below", "above")


def stream_latest_q(spark, sf):
    src, lg = _log_source(spark, sf)
    out, ck = scratch_path(spark, "w3-out"), scratch_path(spark, "w3-ck")
    sub = _stream_src(spark, src, lg.schema).withColumnRenamed("timestamp", "ts")
    q = W.start_latest(sub.select("user_id", "event_id", "ts", "height_cm", "weight_kg"), out, ck)
    q.awaitTermination()
    return W.read_latest(spark, out)


def stream_category_counts_q(spark, sf):
    src, lg = _log_source(spark, sf)
    out, ck = scratch_path(spark, "w4-out"), scratch_path(spark, "w4-ck")
    scored = W.score_submissions(_stream_src(spark, src, lg.schema, by_file=False))
    q = W.start_category_counts(scored, out, ck, ts="timestamp", window="1 day", delay="1 hour", open_windows=True)
    q.awaitTermination()
    return W.read_category_counts(spark, out)


# ------------------------------------------------- more sources and reshaping ---

def _as_text(df: DataFrame, tokens: dict[str, str] | None = None) -> DataFrame:
    """Every column as text; nulls rendered with the given per-column token."""
    tokens = tokens or {}
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(tokens.get(c, "NA"))).alias(c)
                       for c in df.columns])


def detect_dialect_q(spark, sf):
    """The people table written with tab, ``;`` and ``,`` into one folder; the delimiters
    found in one pass over the files' beginnings, and each group read with its own."""
    m = V.people(spark, sf)
    root = scratch_path(spark, "dialects")
    for label, sep in (("tab", "\t"), ("semicolon", ";"), ("comma", ",")):
        m.write.option("header", True).option("sep", sep).csv(os.path.join(root, label))
    rows = []
    for found, header, files in ingest.dialect_groups(spark, [root]):
        df = ingest.read_delimited(spark, files, found, header)
        label = files[0].rsplit("/", 2)[1]
        rows.append(df.agg(F.count(F.lit(1)).alias("rows"), F.count("weight").alias("weights"))
                      .select(F.lit(label).alias("file"), F.lit(found).alias("delimiter"),
                              "rows", "weights"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def collapse_delims_q(spark, sf):
    """Lines whose fields are separated by runs of commas, some fields quoted with commas
    inside, read with ``collapse_repeated=True``; nulls written as ``NA`` (D9)."""
    path = scratch_path(spark, "collapse")
    m = _as_text(V.people(spark, sf)).withColumn("note", F.concat(F.lit('"a,,b ""'), "person_id", F.lit('"", c"')))
    header = 'person_id,,gender,,age,,"Height, cm",,weight,,,note'
    # a file of lines as they come, under its header line: one column whose text is not quoted
    m.select(F.concat_ws(",,", *m.columns).alias(header)).write.option("header", True).option("sep", "\ufdd0").option(
        "quote", "").csv(path)
    ((sep, found, files),) = ingest.dialect_groups(spark, [path])
    out = ingest.read_delimited(spark, files, sep, found, collapse_repeated=True)
    out = ingest.null_tokens(out)
    return out.select(safe_int("person_id", "bigint").alias("person_id"), "gender",
                      safe_double("age").alias("age"), safe_double(F.col("`Height, cm`")).alias("height"),
                      safe_double("weight").alias("weight"), "note")


def null_tokens_q(spark, sf):
    """Nulls rendered as ``Nil`` / ``NaN`` / ``Missing`` text and read back as null."""
    m = _as_text(V.people(spark, sf), {"gender": "Nil", "age": "NaN", "height": "Missing"})
    out = ingest.null_tokens(m)
    return out.select(safe_int("person_id", "bigint").alias("person_id"), "gender",
                      safe_double("age").alias("age"), safe_double("height").alias("height"))


def harmonize_headers_q(spark, sf):
    """Messy headers (``Height CM``, ``Weight_kg``, ``BMI``, ``Index``,
    ``Column 7``) harmonised to the canonical names."""
    m = V.people(spark, sf)
    b = bmi("height", "weight")
    messy = m.select(F.col("person_id").alias("Person ID"), F.col("gender").alias("GENDER"),
                     F.col("age").alias("Age"), F.col("height").alias("Height CM"),
                     F.col("weight").alias("Weight_kg"), b.alias("BMI"),
                     bmi_index(b).alias("Index"), F.lit(0).alias("Column 7"))
    h = ingest.harmonize(messy)
    return h.select("person_id", "gender", "age", "height", "weight", "BMI", "BMI_index")


def sort_pivot_q(spark, sf):
    """Zero-filled age-interval x band count matrix, rows in interval order."""
    return A.crosstab_counts(V.population(spark, sf), "age_interval", "BMI_Index", [1, 2, 3, 4, 5])


# ------------------------------------------- generic operators, native columns ---

# Value bands of ``events.value`` and ``lineitem.l_quantity`` for the tests below,
# and verdict texts for tests outside the body-measurement domain.
EVENT_VALUE_CUTS = (10.0, 50.0, 100.0, 200.0)
QUANTITY_CUTS = (10.0, 25.0, 40.0)
GENERIC_VERDICT = ("The two variables are associated (p < 0.05).",
                   "No evidence of association (p >= 0.05).")


def box_events_value_q(spark, sf):
    e = table(spark, sf, "events")
    return Q.box_stats(e, "value", ["event_type"]).withColumn("mean", round_even("mean", 9))


def ecdf_lineitem_price_q(spark, sf):
    li = table(spark, sf, "lineitem")
    return Q.ecdf(li, "l_extendedprice", by=["l_returnflag"])


def quantiles_events_value_q(spark, sf):
    return Q.quantiles(table(spark, sf, "events"), "value", [0.1, 0.5, 0.9], by=["event_type"])


def percentile_orders_q(spark, sf):
    """Q5 on native columns: every order's total price ranked among all line prices."""
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Q.percentile_many(li, "l_extendedprice", orders, "o_totalprice")


def chisq_events_q(spark, sf):
    """Chi-square of event type x value band (even dof)."""
    e = table(spark, sf, "events").withColumn("value_band", band("value", EVENT_VALUE_CUTS).cast("int"))
    return T.report(T.verdict(T.chi_square(e, "event_type", "value_band"), GENERIC_VERDICT))


def chisq_lineitem_q(spark, sf):
    """Chi-square of line status x quantity band: 2 x 4 levels, dof 3 (odd, erfc path)."""
    li = table(spark, sf, "lineitem").withColumn("qty_band", band("l_quantity", QUANTITY_CUTS).cast("int"))
    return T.report(T.verdict(T.chi_square(li, "l_linestatus", "qty_band"), GENERIC_VERDICT))


def analysis_summary_q(spark, sf):
    """The analysis script end to end: population file (tab) and submission
    log (``;``) -> newest submission scored against the population."""
    from .analysis import analysis_summary

    pop_path, log_path = scratch_path(spark, "analysis-pop"), scratch_path(spark, "analysis-log")
    V.population(spark, sf).write.option("header", True).option("sep", "\t").csv(pop_path)
    (V.log(spark, sf)
       .select("event_id", F.date_format("timestamp", S.SUBMISSION_TS_FORMAT).alias("timestamp"),
               "age", "gender", "height_cm", "weight_kg")
       .write.option("header", True).option("sep", ";").csv(log_path))
    res = analysis_summary(spark, pop_path, log_path,
                           order=[F.col("timestamp"), safe_double("event_id")])
    return res.select("user_bmi", "user_index", "user_category", "N", "percentile",
                                    "overweight_share", "below", "above", "summary", "shares")


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_people": read_people_q,
    "read_mixed": read_mixed_q,
    "write_clean": write_clean_q,
    "write_enriched": write_enriched_q,
    "write_pivot": write_pivot_q,
    "append_submissions": append_submissions_q,
    # cleaning
    "safe_numeric": safe_numeric_q,
    "valid_rows": valid_rows_q,
    "invalid_rows": invalid_rows_q,
    "round_measure": round_measure_q,
    "round_int": round_int_q,
    "fill_derived": fill_derived_q,
    "finite_positive": finite_positive_q,
    "require_rows": require_rows_q,
    "valid_submission": valid_submission_q,
    "complete_cases": complete_cases_q,
    "gender_subset": gender_subset_q,
    "profile": profile_q,
    "preview": preview_q,
    # projections
    "bmi": bmi_q,
    "band_index": band_index_q,
    "band_label": band_label_q,
    "band_label_long": band_label_long_q,
    "age_interval": age_interval_q,
    "percentile_text": percentile_text_q,
    "default_level": default_level_q,
    "score_person": score_person_q,
    "format_report": format_report_q,
    # aggregations
    "distinct_levels": distinct_levels_q,
    "count_by_gender": count_by_gender_q,
    "count_band_age": count_band_age_q,
    "count_gender_band": count_gender_band_q,
    "count_category_gender": count_category_gender_q,
    "all_counts": all_counts_q,
    "cell_cube_counts": cell_cube_counts_q,
    "pct_within_band": pct_within_band_q,
    "pct_pivot": pct_pivot_q,
    "pct_of_total": pct_of_total_q,
    "gender_pivot": gender_pivot_q,
    "gender_proportions": gender_proportions_q,
    "contingency": contingency_q,
    "mean_by_age": mean_by_age_q,
    "share_at_least": share_at_least_q,
    "cohort_summary": cohort_summary_q,
    # distributions
    "quantiles": quantiles_q,
    "quantiles_approx": quantiles_approx_q,
    "quantiles_sketch": quantiles_sketch_q,
    "ecdf": ecdf_q,
    "percentile_of": percentile_of_q,
    "percentile_many": percentile_many_q,
    "below_above": below_above_q,
    "histogram": histogram_q,
    "box_by_gender": box_by_gender_q,
    "box_by_category": box_by_category_q,
    "box_outliers": box_outliers_q,
    "violin_by_gender": violin_by_gender_q,
    "scatter_gender": scatter_gender_q,
    "scatter_bmi": scatter_bmi_q,
    # hypothesis tests
    "chisq_age_band": chisq_age_band_q,
    "chisq_gender_band": chisq_gender_band_q,
    "verdict": verdict_q,
    # users, ranking, sorting
    "latest_row": latest_row_q,
    "user_vs_population": user_vs_population_q,
    "sort_values": sort_values_q,
    # more sources and reshaping
    "detect_dialect": detect_dialect_q,
    "collapse_delims": collapse_delims_q,
    "null_tokens": null_tokens_q,
    "harmonize_headers": harmonize_headers_q,
    "sort_pivot": sort_pivot_q,
    # generic operators on native columns
    "box_events_value": box_events_value_q,
    "ecdf_lineitem_price": ecdf_lineitem_price_q,
    "quantiles_events_value": quantiles_events_value_q,
    "percentile_orders": percentile_orders_q,
    "chisq_events": chisq_events_q,
    "chisq_lineitem": chisq_lineitem_q,
    # the analysis script end to end
    "analysis_summary": analysis_summary_q,
    # streaming
    "stream_score": stream_score_q,
    "stream_percentile": stream_percentile_q,
    "stream_latest": stream_latest_q,
    "stream_category_counts": stream_category_counts_q,
}
