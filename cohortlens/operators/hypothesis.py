"""Pearson chi-square test of independence.

The statistic is summed over the present cells of the contingency table; the
absent ones, whose whole expected count counts, enter as what the present
cells' expected counts leave of the total.  Margins are aggregates of the
cells, and all products are taken in double precision, so neither the counts
nor the numbers of levels are limited.

p-value = Q(dof/2, stat/2), the regularised upper incomplete gamma:

* up to ``SERIES_DOF`` degrees of freedom by its power series (below a + 1) or
  continued fraction (above), with a number of steps that follows sqrt(a) and
  leaves a relative error below 1e-12;
* beyond, by the uniform asymptotic expansion in the normal tail, whose first
  two terms leave an error below 1e-12 there.

No Python runs in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import round_even
from ..session import keep
from .aggregate import cell_counts

# Beyond this the asymptotic expansion takes over.
SERIES_DOF = 1_000_000
_TINY = 1e-300
# Below this a the gamma function is a product, above it Stirling's series.
_STIRLING_FROM = 20
# FIXED VALUES: coefficients of the first two terms of the uniform expansion in
# powers of eta, valid around eta = 0.
_C0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515)
_C1 = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760)


def _ln_gamma_half(k: Column, half: Column) -> Column:
    """ln Gamma(half), half = k/2 for a positive integer k, as a sum of at most ``_STIRLING_FROM`` logs."""
    first = F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    start = F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi)))
    steps = F.sequence(F.lit(0), F.lit(_STIRLING_FROM))
    return start + F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.when(
        first + j < half, F.log(first + j)).otherwise(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _density(k: Column, a: Column, x: Column) -> Column:
    """``x^a exp(-x) / Gamma(a + 1)`` without cancellation for large ``a = k/2``."""
    stirling = 1 / (12 * a) - 1 / (360 * a * a * a) + 1 / (1260 * F.pow(a, F.lit(5.0))) - 1 / (1680 * F.pow(a, F.lit(7.0)))
    large = let((x - a) / a, lambda mu: F.exp(-a * (mu - F.log1p(mu)) - stirling) / F.sqrt(2 * math.pi * a))
    small = F.exp(-x + a * F.log(x) - _ln_gamma_half(k, a) - F.log(a))
    return F.when(a >= _STIRLING_FROM, large).otherwise(small)


def _nonzero(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)


def _gamma_q(k: Column, a: Column, x: Column) -> Column:
    """Q(a, x), a = k/2, by power series or continued fraction (modified Lentz)."""
    steps = F.sequence(F.lit(1), (200 + F.ceil(20 * F.sqrt(a))).cast("int"))

    def series_step(st, n):
        return let(st["t"] * x / (a + n.cast("double")),
                   lambda t: F.struct(t.alias("t"), (st["s"] + t).alias("s")))

    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                         series_step, lambda st: st["s"])

    def fraction_step(st, i):
        an = -i.cast("double") * (i.cast("double") - a)
        raw = F.struct((st["b"] + 2.0).alias("b"), (an * st["d"] + st["b"] + 2.0).alias("d"),
                       (st["b"] + 2.0 + an / st["c"]).alias("c"))

        def turned(r):
            return F.struct(_nonzero(r["c"]).alias("c"), (1.0 / _nonzero(r["d"])).alias("d"))

        return let(raw, lambda r: let(turned(r), lambda t: F.struct(
            r["b"].alias("b"), t["c"].alias("c"), t["d"].alias("d"), (st["h"] * t["d"] * t["c"]).alias("h"))))

    def fraction(b0: Column) -> Column:
        init = F.struct(b0.alias("b"), F.lit(1.0 / _TINY).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h"))
        return F.aggregate(steps, init, fraction_step, lambda st: st["h"])

    return let(_density(k, a, x), lambda d: F.when(x < a + 1.0, 1.0 - d * series).otherwise(
        d * a * let(x + 1.0 - a, fraction)))


def _gamma_q_large(a: Column, eta: Column, z2: Column, q: Column) -> Column:
    """Q(a, x) for large a: half the complementary error function and a correction.

    ``q`` is Q(1/2, z2), the complementary error function of sqrt(z2), for z2 > 0.
    """
    erfc = F.when(z2 <= 0, F.lit(1.0)).otherwise(q)
    tail = F.when(eta < 0, 1 - erfc / 2).otherwise(erfc / 2)

    def poly(coefficients):
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * eta + c
        return out

    rest = F.exp(-F.least(z2, F.lit(745.0))) / F.sqrt(2 * math.pi * a) * (poly(_C0) + poly(_C1) / a)
    return F.when(z2 > 700, F.when(eta < 0, F.lit(1.0)).otherwise(0.0)).otherwise(tail + rest)


def chi_square_pvalue(stat: Column, dof: Column) -> Column:
    """Upper-tail probability of the chi-square distribution (JVM-side only), any dof.

    1 for a statistic of 0 or less, and for dof 0, where there is nothing to test.
    Each quantity is bound once (``let``), and both ways to the tail share one
    incomplete gamma function, so the expression stays short.
    """
    k = dof.cast("bigint")
    given = F.struct(k.alias("k"), (k.cast("double") / 2).alias("a"), F.when(stat > 0, stat / 2).otherwise(F.lit(1.0)).alias("x"))

    def far(v: Column) -> Column:  # how far out x lies, for the expansion
        off = let((v["x"] - v["a"]) / v["a"], lambda mu: F.struct(
            mu.alias("mu"), F.greatest(2 * (mu - F.log1p(mu)), F.lit(0.0)).alias("eta2")))
        none = F.struct(F.lit(0.0).alias("mu"), F.lit(0.0).alias("eta2"))
        return F.struct(v.alias("g"), F.when(v["k"] > SERIES_DOF, off).otherwise(none).alias("off"))

    def tail(v: Column) -> Column:
        small = v["g"]["k"] <= SERIES_DOF
        z2 = v["g"]["a"] * v["off"]["eta2"] / 2
        near = F.least(F.greatest(z2, F.lit(_TINY)), F.lit(700.0))
        half = F.struct(F.lit(1).cast("bigint").alias("k"), F.lit(0.5).alias("a"), near.alias("x"))
        asked = F.struct(F.when(small, v["g"]).otherwise(half).alias("g"),
                         (F.signum(v["off"]["mu"]) * F.sqrt(v["off"]["eta2"])).alias("eta"), z2.alias("z2"))
        return let(asked, lambda w: let(let(w["g"], lambda g: _gamma_q(g["k"], g["a"], g["x"])), lambda q: F.when(small, q).otherwise(
            _gamma_q_large(v["g"]["a"], w["eta"], w["z2"], q))))

    q = let(let(given, far), tail)
    return F.when((stat <= 0) | (k <= 0), F.lit(1.0)).otherwise(
        F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def chi_square_from_cells(cells: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """Statistic, dof and p-value from ``(a, b, n)`` cells, dense or present ones only (one row).

    Margins are aggregates joined back to the cells, so no task holds a level's
    cells, and the total is the sum of a margin.  A row or column that is all
    zero does not count as a level.
    """
    cells = cells.filter(F.col(n) > 0).select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(n).cast("double").alias("o"))
    rows = keep(cells.groupBy("__a").agg(F.sum("o").alias("r")))
    columns = cells.groupBy("__b").agg(F.sum("o").alias("c"))
    width = columns.agg(F.count(F.lit(1)).alias("levels_b"))
    size = rows.agg(F.count(F.lit(1)).alias("levels_a"), F.sum("r").alias("total")).join(F.broadcast(width))
    e = F.col("r") * F.col("c") / F.col("total")
    present = (cells.join(rows, "__a").join(columns, "__b").join(F.broadcast(size)))  # one row
    agg = present.agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("__s"), F.sum(e).alias("__e"), F.sum("o").alias("__n"),
        F.count(F.lit(1)).alias("__cells"), F.max("levels_a").alias("__la"), F.max("levels_b").alias("__lb"))
    absent = F.when(F.col("__cells") < F.col("__la") * F.col("__lb"), F.col("__n") - F.col("__e")).otherwise(0.0)
    return agg.select((F.col("__s") + absent).alias("statistic"),
                      ((F.col("__la") - 1) * (F.col("__lb") - 1)).cast("bigint").alias("dof"),
                      F.coalesce("__n", F.lit(0.0)).cast("bigint").alias("n")).withColumn(
        "p_value", chi_square_pvalue(F.col("statistic"), F.col("dof")))


def chi_square(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Pearson test of independence of ``a`` and ``b`` (nulls left out), of rows or of a cell table."""
    return chi_square_from_cells(keep(cell_counts(df, a, b, weight)), a, b)


def verdict(result: DataFrame, texts=S.VERDICT_GENDER_BAND, alpha: float = S.ALPHA) -> DataFrame:
    """Significance flag and interpretation text at ``alpha``."""
    sig = F.col("p_value") < F.lit(alpha)
    return (result.withColumn("significant", sig)
                  .withColumn("interpretation",
                              F.when(sig, F.lit(texts[0])).otherwise(F.lit(texts[1]))))


def report(result: DataFrame, stat_digits: int = 6, p_digits: int = 9) -> DataFrame:
    """Round statistic and p-value for reporting (ties to even)."""
    return (result.withColumn("statistic", round_even(F.col("statistic"), stat_digits))
                  .withColumn("p_value", round_even(F.col("p_value"), p_digits)))
