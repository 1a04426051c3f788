"""Counts, percentages, pivots and contingency tables.

Every aggregate groups with map-side partial aggregation, so a hot key (a
gender or band with a third of all rows) is combined inside each task before
the shuffle and only one row per key and task crosses the network.  Tables
that follow an aggregate (pivots, percentages) are sized by the number of
levels, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import keep
from ..functions import round_even, with_default


def levels(df: DataFrame, col: str) -> DataFrame:
    """A1: distinct values of ``col``, null included."""
    return df.select(col).distinct()


def _rows(weight: str | None) -> Column:
    """Number of rows: of the table itself, or of those that a cell table's ``weight`` stands for."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")


def _rows_if(cond: Column, weight: str | None) -> Column:
    """Rows that meet ``cond``; null if none does."""
    return F.sum(F.when(cond, F.lit(1) if weight is None else F.col(weight)))


def cell_cube(df: DataFrame, *dims: str, name: str = "n") -> DataFrame:
    """Rows per combination of all ``dims``, nulls included: the cells every count over them is a sum of.

    One scan with a partial aggregate; the result is as large as the present
    combinations.  Pass it with ``weight=name`` to the counts, pivots and tests below.
    """
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias(name))


def counts(df: DataFrame, *cols: str, name: str = "count", weight: str | None = None) -> DataFrame:
    """A2-A5: rows per combination of ``cols``, from rows or from a cell table (``weight``)."""
    return df.groupBy(*cols).agg(_rows(weight).alias(name))


def category_gender_counts(df: DataFrame, cat: str = "BMI_cat", gender: str = "gender",
                           unknown: str = S.UNKNOWN_GENDER,
                           missing: str = S.MISSING_CATEGORY) -> DataFrame:
    """A5: counts per (gender, category) with default levels for nulls."""
    return (df.select(with_default(F.col(gender), unknown).alias("gender"),
                      with_default(F.col(cat), missing).alias("cat"))
              .groupBy("gender", "cat").agg(F.count(F.lit(1)).alias("count")))


def multi_counts(df: DataFrame, sets: Sequence[Sequence[str]], name: str = "count",
                 weight: str | None = None) -> DataFrame:
    """Several group-by counts in one scan (GROUPING SETS).

    ``set_id`` is Spark's ``grouping_id`` over the union of the columns:
    bit i (from the left, most significant first) is 1 when column i is
    not part of the row's grouping set.
    """
    cols: list[str] = []
    for s in sets:
        for c in s:
            if c not in cols:
                cols.append(c)
    gsets = [[F.col(c) for c in s] for s in sets]
    return (df.groupingSets(gsets, *[F.col(c) for c in cols])
              .agg(F.grouping_id(*[F.col(c) for c in cols]).alias("set_id"),
                   _rows(weight).alias(name)))


def pct_within(cnt: DataFrame, by: Sequence[str], count_col: str = "count",
               out: str = "pct_within_bmi", digits: int = 1) -> DataFrame:
    """``round(100*n/sum(n), digits)`` within each ``by`` group, ties to even.

    Runs on an aggregated table (one row per cell), so the window's shuffle
    moves cells, not people.
    """
    total = F.sum(F.col(count_col)).over(Window.partitionBy(*by))
    pct = F.lit(100.0) * F.col(count_col) / total
    return cnt.withColumn(out, round_even(pct, digits))


def crosstab_pct(df: DataFrame, rows: str, cols: str, col_levels: Sequence[str],
                 digits: int = 1, weight: str | None = None) -> DataFrame:
    """Percentage of each column level within a row key, columns in a fixed order.

    Empty cells are null.  Rows whose column value is outside ``col_levels``
    still count in the row total, as in the original.
    """
    cnt = counts(df, rows, cols, weight=weight)
    pct = pct_within(cnt, [rows], out="pct", digits=digits)
    wide = pct.groupBy(rows).pivot(cols, list(col_levels)).agg(F.first("pct"))
    return wide.select(rows, *[F.col(f"`{lv}`") for lv in col_levels]).orderBy(rows)


def pct_of_total(df: DataFrame, col: str, digits: int = 2, name: str = "Count",
                 pct_name: str = "Percent") -> DataFrame:
    """Share of each category, ``round(n/total*100, digits)``; total at least 1.

    Nulls are dropped first.  The total is the sum of the counts, one row that
    is broadcast to the categories; no task holds them all.
    """
    cnt = keep(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name)))
    total = cnt.agg(F.sum(name).alias("__total"))
    share = F.col(name) / F.greatest(F.col("__total"), F.lit(1)) * F.lit(100.0)
    return cnt.join(F.broadcast(total)).withColumn(pct_name, round_even(share, digits)).drop("__total")


def crosstab(df: DataFrame, rows: str, cols: str,
             col_levels: Sequence[str] = S.GENDER_LEVELS,
             names: dict[str, str] | None = None, weight: str | None = None) -> DataFrame:
    """A10: counts of each column level per row key; an empty cell is null.

    One aggregate with conditional sums (no second pivot shuffle); rows with
    a column value outside ``col_levels`` (or null) are not counted (D4, D14),
    but a row key that has only such rows keeps its row.
    """
    names = names or {lv: str(lv) for lv in col_levels}
    c = F.col(cols)
    aggs = [_rows_if(c == F.lit(lv), weight).alias(names[lv]) for lv in col_levels]
    return df.groupBy(rows).agg(*aggs)


def crosstab_counts(df: DataFrame, rows: str, cols: str, col_levels: Sequence,
                    names: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """A12/R3 wide form: zero-filled counts of each column level per row key,
    rows sorted by key (the matrix a chi-square test reads)."""
    names = list(names) if names is not None else [str(lv) for lv in col_levels]
    c = F.col(cols)
    aggs = [F.coalesce(_rows_if(c == F.lit(lv), weight), F.lit(0)).cast("bigint").alias(n) for lv, n in zip(col_levels, names)]
    return df.filter(F.col(rows).isNotNull()).groupBy(rows).agg(*aggs).orderBy(rows)


def with_proportions(pivot: DataFrame, count_cols: Sequence[str] = ("Female_Count", "Male_Count"),
                     out_cols: Sequence[str] = ("Female_Proportion", "Male_Proportion")) -> DataFrame:
    """Each count over the row sum of the counts; null if any count is null."""
    total = None
    for c in count_cols:
        total = F.col(c) if total is None else total + F.col(c)
    for c, o in zip(count_cols, out_cols):
        pivot = pivot.withColumn(o, F.col(c) / total)
    return pivot


def gender_pivot(df: DataFrame, band_col: str = "BMI_Index", gender: str = "gender",
                 weight: str | None = None) -> DataFrame:
    """A10 + A11: the gender pivot with proportions, ordered by band."""
    piv = crosstab(df, band_col, gender, S.GENDER_LEVELS, S.GENDER_PIVOT_NAMES, weight)
    return with_proportions(piv).orderBy(band_col)


def cell_counts(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Present cells ``(a, b, n)`` of the contingency table (nulls left out)."""
    return (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(_rows(weight).alias("n")))


def contingency(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Dense long-form count table ``(a, b, n)``; absent cells have n = 0.

    Null keys are left out.  The grid pairs the two level tables, as its output
    demands, and is joined with the cell counts; nothing is gathered.
    """
    cells = keep(cell_counts(df, a, b, weight))
    grid = cells.select(a).distinct().crossJoin(cells.select(b).distinct())
    return (grid.join(cells, [a, b], "left")
                .select(a, b, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def mean_by(df: DataFrame, key: str = "age", value: str = "weight",
            name: str = "Mean_Weight") -> DataFrame:
    """Mean of ``value`` per ``key`` over complete rows, ordered by key."""
    return (df.dropna(subset=[key, value])
              .groupBy(key).agg(F.avg(F.col(value)).alias(name)).orderBy(key))


def share(df: DataFrame, cond: Column, name: str = "share") -> DataFrame:
    """``100 * mean(cond)`` as one row."""
    return df.agg((F.lit(100.0) * F.avg(cond.cast("int"))).alias(name))
