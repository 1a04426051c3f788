"""Cleaning: validity, quarantine, coercion, rounding, profiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import bmi, finite_positive, round_even, safe_double, safe_int
from .distribution import column_quantiles


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast the given columns with ``safe_double``; other columns pass."""
    wanted = set(cols)
    return df.select(*[safe_double(F.col(c)).alias(c) if c in wanted else F.col(c)
                       for c in df.columns])


def valid_condition(ranges: Mapping[str, tuple[float, float]] = S.VALID_RANGES) -> Column:
    """C2 predicate: every ranged column present and inside its closed range.

    ``between`` on a null is null, so the result is true, false or null;
    callers that need the complement use ``coalesce(cond, false)``.
    """
    cond = None
    for name, (lo, hi) in ranges.items():
        c = F.col(name).between(F.lit(lo), F.lit(hi))
        cond = c if cond is None else cond & c
    return cond


def valid(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = S.VALID_RANGES) -> DataFrame:
    """Rows whose ranged columns are all present and in range."""
    return df.filter(valid_condition(ranges))


def quarantine(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = S.VALID_RANGES) -> DataFrame:
    """The exact complement of ``valid`` with a ``reasons`` text.

    Nulls land here (a bare ``NOT valid`` would lose them).  ``reasons``
    lists ``<col>:missing`` or ``<col>:range`` per failing column, comma
    separated, in the order of ``ranges``.
    """
    parts = []
    for name, (lo, hi) in ranges.items():
        c = F.col(name)
        parts.append(F.when(c.isNull(), F.lit(f"{name}:missing"))
                      .when(~c.between(F.lit(lo), F.lit(hi)), F.lit(f"{name}:range")))
    return (df.filter(~F.coalesce(valid_condition(ranges), F.lit(False)))
              .withColumn("reasons", F.concat_ws(",", *parts)))


def round_measures(df: DataFrame, cols: Sequence[str] = ("height", "weight"),
                   digits: int = 1) -> DataFrame:
    """C4 (digits=1) and C5 (digits=0, as int): ties to even; a cell that is no int becomes null."""
    wanted = set(cols)

    def r(c: str) -> Column:
        out = round_even(F.col(c), digits)
        return (out.try_cast("int") if digits == 0 else out).alias(c)

    return df.select(*[r(c) if c in wanted else F.col(c) for c in df.columns])


def fill_bmi(df: DataFrame, bmi_col: str = "BMI", height: str = "height",
             weight: str = "weight") -> DataFrame:
    """Keep a given BMI, else compute it from height and weight."""
    computed = bmi(F.col(height).cast("double"), F.col(weight).cast("double"))
    if bmi_col in df.columns:
        return df.withColumn(bmi_col, F.coalesce(F.col(bmi_col).cast("double"), computed))
    return df.withColumn(bmi_col, computed)


def finite_positive_rows(df: DataFrame, col: str = "BMI") -> DataFrame:
    """Rows whose value is present, finite and positive."""
    return df.filter(finite_positive(F.col(col)))


def require_rows(df: DataFrame, message: str = "no rows") -> DataFrame:
    """Fail when ``df`` is empty, else return it unchanged.

    ``isEmpty`` stops at the first row found, so the check costs one small job.
    """
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_rows_lazy(df: DataFrame, message: str = "no rows") -> DataFrame:
    """C8 inside the plan: one row with ``n``; raises at run time when n = 0."""
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, n).otherwise(F.raise_error(F.lit(message)).cast("long")).alias("n"))


def valid_submission_condition(age: str = "age", height: str = "height_cm",
                               weight: str = "weight_kg") -> Column:
    """C9 predicate: age an integer, height and weight numbers, all > 0."""
    a = safe_int(F.col(age))
    h = safe_double(F.col(height))
    w = safe_double(F.col(weight))
    return F.coalesce((a > 0) & (h > 0) & (w > 0), F.lit(False))


def valid_submissions(df: DataFrame, age: str = "age", height: str = "height_cm",
                      weight: str = "weight_kg") -> DataFrame:
    """Parse and keep submissions that the form would save."""
    return (df.filter(valid_submission_condition(age, height, weight))
              .withColumn(age, safe_int(F.col(age)))
              .withColumn(height, safe_double(F.col(height)))
              .withColumn(weight, safe_double(F.col(weight))))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every listed column present."""
    return df.dropna(subset=list(cols))


def subset_equal(df: DataFrame, col: str, value) -> DataFrame:
    """C11: rows where ``col == value`` (null never matches, D4)."""
    return df.filter(F.col(col) == F.lit(value))


def profile(df: DataFrame, cols: Sequence[str] | None = None,
            approx_median: bool = False, accuracy: int = 10000, quartiles: bool = False) -> DataFrame:
    """One row per column: rows, missing, min, max, mean (and, on
    request, an approximate median with rank error at most N/accuracy).

    One aggregate pass computes every statistic of every column; the wide
    row is then unpivoted to one row per column with ``stack``.  With ``quartiles``
    the exact ``q1``, ``median`` and ``q3`` (type 7) of all numeric columns are added,
    from one order pass over the cells of all of them; other columns have nulls.
    """
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")}
    aggs = []
    for i, c in enumerate(cols):
        col = F.col(c)
        num = col.cast("double") if c in numeric else F.lit(None).cast("double")
        aggs += [
            F.count(F.lit(1)).alias(f"n{i}"),
            F.count_if(col.isNull()).alias(f"m{i}"),
            F.min(num).alias(f"lo{i}"),
            F.max(num).alias(f"hi{i}"),
            F.avg(num).alias(f"mu{i}"),
        ]
        if approx_median:
            aggs.append(F.percentile_approx(num, 0.5, accuracy).alias(f"md{i}"))
    wide = df.agg(*aggs)
    extra = ", md{i}" if approx_median else ""
    names = "column, position, n_rows, n_missing, min, max, mean" + (", median_approx" if approx_median else "")
    pieces = ", ".join(
        f"'{c}', {i}, n{i}, m{i}, lo{i}, hi{i}, mu{i}" + extra.format(i=i) for i, c in enumerate(cols))
    out = wide.selectExpr(f"stack({len(cols)}, {pieces}) as ({names})")
    if not quartiles:
        return out
    names3 = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    none = [F.lit(None).cast("double").alias(n) for n in names3]
    measured = [c for c in cols if c in numeric]
    if not measured:
        return out.select("*", *none)
    found = column_quantiles(df, measured, list(names3.values()))
    wide3 = found.groupBy(F.col("column").alias("__c")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in names3.items()])
    return out.join(wide3, F.col("column") == F.col("__c"), "left").drop("__c")


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ("person_id",)) -> DataFrame:
    """First ``n`` rows by a key (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)
