"""Latest row per user and user-versus-population scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import band_label, bmi, bmi_index, percentile_text
from .distribution import attach, percentile_many


def latest(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The newest row per key; ``order`` breaks ties left to right.

    ``max_by`` is a partial aggregate: a user with a third of all rows is
    reduced inside each map task, so no task holds a whole group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def compare_users(submissions: DataFrame, population: DataFrame, key: str = "user_id",
                  order: Sequence[str] = ("ts", "event_id"), pop_col: str = "BMI",
                  height: str = "height", weight: str = "weight",
                  given_bmi: str | None = None,
                  labels: Sequence[str] = S.BMI_LABELS_SHORT) -> DataFrame:
    """R2: every user's latest submission scored against the population.

    BMI is the given one when present, else computed (C6); then band,
    label, percentile (share <= , D12), below (share <) and above.
    """
    last = latest(submissions, key, order)
    computed = bmi(F.col(height).cast("double"), F.col(weight).cast("double"))
    b = F.coalesce(F.col(given_bmi).cast("double"), computed) if given_bmi else computed
    scored = (last.withColumn("user_bmi", b)
                  .withColumn("user_index", bmi_index(F.col("user_bmi")))
                  .withColumn("user_category", band_label(F.col("user_index"), labels, S.MISSING_CATEGORY)))
    ranked = percentile_many(population, pop_col, scored, "user_bmi")
    return ranked.withColumn("interpretation", percentile_text(F.col("percentile")))


def cohort_summary(population: DataFrame, probes: DataFrame, probe_col: str,
                   pop_col: str = "BMI", cut: float = S.OVERWEIGHT_CUT) -> DataFrame:
    """Population size, share at or above ``cut`` and each probe's
    percentile, below and above, one row per probe."""
    c = F.col(pop_col)
    scal = (population.filter(c.isNotNull())
                      .agg(F.count(F.lit(1)).alias("N"),
                           (F.lit(100.0) * F.avg((c >= F.lit(cut)).cast("int"))).alias("overweight_share")))
    ranked = percentile_many(population, pop_col, probes, probe_col)
    return attach(ranked, scal, [])
