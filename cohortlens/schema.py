"""Schemas, canonical names and the fixed values of the cohort analytics.

Everything in the block marked FIXED VALUES must equal the values the
original analysis uses, otherwise bands, labels and verdicts change.  The
operators take them as defaults only; every function accepts its own
thresholds, labels and ranges.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the original analysis)
# ---------------------------------------------------------------------------

# BMI band edges: band 1 is < 18.5, band 2 < 25, band 3 < 30, band 4 < 35, else 5.
BMI_CUTS = (18.5, 25.0, 30.0, 35.0)

# Short labels used by the charts and the analysis script.
BMI_LABELS_SHORT = ("Underweight", "Normal", "Overweight", "Obese I", "Obese II+")

# Long labels used by the submission form and its log.
BMI_LABELS_LONG = ("Underweight", "Normal", "Overweight", "Obese Class I", "Obese Class II+")

# Age interval edges and labels (en dash U+2013, open at both ends).
AGE_CUTS = (25, 35, 45, 55)
AGE_LABELS = ("18–24", "25–34", "35–44", "45–54", "55–69")

# Percentile interpretation: edges on a 0..100 scale and the six sentences.
PERCENTILE_CUTS = (10, 25, 50, 75, 90)
PERCENTILE_TEXTS = (
    "You are in the **lowest 10%** of BMI (much below most people).",
    "You are in the **bottom 25%** (below average BMI).",
    "You are **below average** BMI.",
    "You are **above average** BMI.",
    "You are in the **top 25%** of BMI (higher than most people).",
    "You are in the **highest 10%** of BMI (very high compared to others).",
)

# Closed validity ranges of the population table.
VALID_RANGES = {
    "age": (18.0, 60.0),
    "height": (144.0, 210.0),
    "weight": (34.0, 120.0),
}

# Cell texts that mean "missing" in the dirty CSV files.
NULL_TOKENS = ("", "NA", "NaN", "null", "Nil", "Missing")

# Header synonyms after lower-casing and replacing spaces by underscores.
HEADER_SYNONYMS = {
    "height_cm": "height",
    "weight_kg": "weight",
    "bmi": "BMI",
    "bmi_index": "BMI_index",
    "index": "BMI_index",
}

# Columns every harmonised table has (absent ones are added as null).
CANONICAL_COLUMNS = ("height", "weight", "BMI", "BMI_index", "gender", "age")

# Prefix of junk columns that harmonisation drops.
JUNK_PREFIX = "column"

# Gender levels of the population table, in pivot order.
GENDER_LEVELS = ("female", "male")

# Column names of the gender pivot.
GENDER_PIVOT_NAMES = {"female": "Female_Count", "male": "Male_Count"}

# Header of the submission log, in file order.
SUBMISSION_HEADER = (
    "timestamp", "age", "gender", "height_cm", "weight_kg", "bmi", "index", "category",
)

# Timestamp format of the submission log.
SUBMISSION_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Share of the population at or above this BMI is "overweight or more".
OVERWEIGHT_CUT = 25.0

# Significance level of the chi-square verdicts.
ALPHA = 0.05

# Verdict texts of the two chi-square tests.
VERDICT_AGE_BAND = (
    "BMI distribution differs significantly across age intervals.",
    "No strong evidence of association between BMI and age intervals.",
)
VERDICT_GENDER_BAND = (
    "BMI distribution differs significantly between genders.",
    "No strong evidence of association between gender and BMI.",
)

# Histogram bins of the BMI distribution chart.
HISTOGRAM_BINS = 40

# Box plot whisker factor (Tukey fences).
BOX_WHISKER = 1.5

# Quartile method of the box plots: the chart library's default "linear"
# method interpolates at position N*p - 0.5 (Hyndman-Fan type 5).
BOX_QUARTILE_METHOD = "type5"

# Violin density defaults of the common plotting library the charts are drawn
# with: rule-of-thumb bandwidth 1.059 * min(sd, IQR / 1.349) * n^(-1/5), and a
# "soft" span reaching two bandwidths beyond the smallest and largest value.
KDE_BW_FACTOR = 1.059
KDE_IQR_DIVISOR = 1.349
KDE_SPAN = 2.0

# Default label of a missing category and of a missing gender.
MISSING_CATEGORY = "Missing"
UNKNOWN_GENDER = "Unknown"
OTHER_CATEGORY = "Other"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

PEOPLE_SCHEMA = T.StructType([
    T.StructField("person_id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])

# The log's timestamps are local wall time without a zone: timestamp_ntz.
SUBMISSION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("height_cm", T.DoubleType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("bmi", T.DoubleType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("category", T.StringType()),
])


def all_string(names) -> T.StructType:
    """A schema of string columns: dirty files are read as text, then cast."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
