"""Column -> Column functions.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation and are shared by batch and streaming jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text accepted as a number: optional sign, digits with an optional point,
# optional exponent, or inf / infinity / nan; surrounding blanks allowed.
# Spark's cast also accepts suffixes such as "1.0d" and "1f"; the guard
# rejects them so that only plain numbers parse.
_NUMBER_RE = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
)


def safe_double(c: ColumnOrName) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    col = _c(c)
    as_text = col.cast("string")
    return F.when(as_text.rlike(_NUMBER_RE), F.trim(as_text).try_cast("double"))


def safe_int(c: ColumnOrName, type_: str = "int") -> Column:
    """Integer parse: optional sign and digits only; out of range gives null.

    ``type_`` is ``"int"`` (submission ages) or ``"bigint"`` (ids): ids are
    parsed directly, never through a double, so no digit is lost.
    """
    as_text = _c(c).cast("string")
    return F.when(as_text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(as_text).try_cast(type_))


def round_even(c: ColumnOrName, digits: int = 0) -> Column:
    """Round half to even on the scaled value."""
    col = _c(c)
    if digits == 0:
        return F.rint(col)
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def bmi(height: ColumnOrName, weight: ColumnOrName) -> Column:
    """Weight / (height/100)^2; null in, null out; zero height gives null."""
    h = _c(height) / F.lit(100.0)
    den = h * h
    return F.when(den != 0, _c(weight) / den)


def band(c: ColumnOrName, cuts: Sequence[float] = S.BMI_CUTS,
         labels: Sequence | None = None) -> Column:
    """Half-open bands ``< cuts[0]``, ``< cuts[1]``, ..., else last.

    A null value stays null: the last arm tests ``isNotNull`` explicitly,
    otherwise a null would fall into the top band.  NaN fails every ``<``
    and so lands in the top band (D15).
    """
    col = _c(c)
    out = labels if labels is not None else list(range(1, len(cuts) + 2))
    if len(out) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    expr = None
    for cut, lab in zip(cuts, out[:-1]):
        cond = col < F.lit(cut)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    last = col.isNotNull()
    return expr.when(last, F.lit(out[-1])) if expr is not None else F.when(last, F.lit(out[-1]))


def bmi_index(c: ColumnOrName, cuts: Sequence[float] = S.BMI_CUTS) -> Column:
    """BMI band 1..5 as int."""
    return band(c, cuts).cast("int")


def band_label(idx: ColumnOrName, labels: Sequence[str] = S.BMI_LABELS_SHORT,
               missing: str | None = None) -> Column:
    """Label of a 1-based band index; null index gives ``missing``."""
    col = _c(idx)
    expr = None
    for i, lab in enumerate(labels, start=1):
        cond = col == F.lit(i)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    if missing is not None:
        expr = expr.when(col.isNull(), F.lit(missing))
    return expr


def age_interval(c: ColumnOrName, cuts: Sequence[float] = S.AGE_CUTS,
                 labels: Sequence[str] = S.AGE_LABELS) -> Column:
    """P5: age interval label, open at both ends; null stays null."""
    return band(c, cuts, labels)


def percentile_text(c: ColumnOrName, cuts: Sequence[float] = S.PERCENTILE_CUTS,
                    texts: Sequence[str] = S.PERCENTILE_TEXTS) -> Column:
    """Interpretation sentence of a 0..100 percentile."""
    return band(c, cuts, texts)


def with_default(c: ColumnOrName, value: str) -> Column:
    """Null -> value."""
    return F.coalesce(_c(c), F.lit(value))


def restrict(c: ColumnOrName, allowed: Sequence[str], other: str = S.OTHER_CATEGORY) -> Column:
    """Values outside ``allowed`` become ``other``; null stays null."""
    col = _c(c)
    return F.when(col.isin(list(allowed)), col).when(col.isNotNull(), F.lit(other))


def finite_positive(c: ColumnOrName) -> Column:
    """Non-null, not NaN, finite and > 0."""
    col = _c(c)
    return (col.isNotNull() & ~F.isnan(col)
            & (F.abs(col) < F.lit(float("inf"))) & (col > F.lit(0.0)))


def normalize_gender(c: ColumnOrName) -> Column:
    """``lower(trim(gender))`` so that ``Male`` and ``male`` meet."""
    return F.lower(F.trim(_c(c)))


def fmt2(c: ColumnOrName) -> Column:
    """``%.2f`` text; null stays null."""
    return F.when(_c(c).isNotNull(), F.format_string("%.2f", _c(c)))


def fmt_pct1(c: ColumnOrName) -> Column:
    """``%.1f%%`` text; null stays null."""
    return F.when(_c(c).isNotNull(), F.format_string("%.1f%%", _c(c)))
