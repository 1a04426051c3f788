"""A stored population snapshot, and ranks of probes that read only what they hit.

The snapshot lies in folders, one per bucket of values, with the bucket edges, the
population's size and the time of the snapshot beside them.  A micro-batch deals
its probes into the same buckets first; the distinct buckets (at most ``MOST``
rows) prune the scan of the snapshot, so a batch reads the buckets it hits and no
others, and only these are shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.distribution import bucketize
from ..sources.storage import completed

#: Buckets of a snapshot at most, and distinct values that make another bucket worth its file.
MOST, ROWS = 4096, 10_000

STEPS = "value double, n bigint, cum bigint, bucket int"
EDGES = "__edges array<double>, total bigint, as_of timestamp"


def thinned(edges: Column, count: Column, bucket_rows: int, most: int) -> Column:
    """Every so-manieth of ``most`` even edges, so that a bucket gets about ``bucket_rows`` of ``count`` values."""
    wanted = F.least(F.greatest(F.ceil(count / bucket_rows), F.lit(1)), F.lit(most))
    step = F.ceil(F.lit(most) / wanted)
    return F.filter(edges, lambda _, i: (i + 1) % step == 0)


def write_snapshot(snapshot: DataFrame, path: str, bucket_rows: int = ROWS, most: int = MOST) -> None:
    """Store ``(value, n, cum, total, as_of)``, one row per distinct value, in bucket folders.

    The rows are written once as they come (``taken``) and everything else is made
    from that, so edges, sizes and steps agree whatever happens to the population
    meanwhile.  ``steps`` comes last: the snapshot is there once it is complete.
    """
    spark = snapshot.sparkSession
    taken, edges, steps = (os.path.join(path, p) for p in ("taken", "edges", "steps"))
    snapshot.select("value", "n", "cum", "total", "as_of").write.mode("overwrite").parquet(taken)
    rows = spark.read.parquet(taken)
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    even = F.percentile_approx(F.when(finite, F.col("value")), [i / most for i in range(1, most)], 4 * most)
    empty = F.array().cast("array<double>")
    (rows.agg(F.coalesce(F.array_sort(F.array_distinct(thinned(even, F.count(F.lit(1)), bucket_rows, most))), empty)
              .alias("__edges"), F.max("total").alias("total"), F.max("as_of").alias("as_of"))
         .write.mode("overwrite").parquet(edges))
    stored = spark.read.schema(EDGES).parquet(edges)
    dealt = bucketize(rows.select("value", "n", "cum"), "value", stored.select("__edges"), most)
    (dealt.repartition("bucket").sortWithinPartitions("bucket", "value")
          .write.mode("overwrite").partitionBy("bucket").parquet(steps))


def snapshot_complete(spark: SparkSession, path: str) -> bool:
    return completed(spark, os.path.join(path, "steps"))


def open_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Steps (value, n, cum, bucket) and the one row of edges of a stored snapshot."""
    return (spark.read.schema(STEPS).parquet(os.path.join(path, "steps")),
            spark.read.schema(EDGES).parquet(os.path.join(path, "edges")))


def last_steps(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """As-of merge: for each asked (value, bucket) the last step up to it: value, le, eq.

    Edges are step values, so the last step up to a value lies in its bucket, and a
    value below the first step has none (0 rows).  A window over a bucket carries
    the steps on; no arrays travel with the rows.
    """
    nothing = F.lit(None).cast("bigint")
    both = steps.select("bucket", "value", F.lit(0).alias("kind"), "cum", "n").unionByName(
        asked.select("bucket", "value", F.lit(1).alias("kind"), nothing.alias("cum"), nothing.alias("n")))
    upto = (Window.partitionBy("bucket").orderBy("value", "kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(F.col("kind") == 0, F.struct("value", "cum", "n")), ignorenulls=True).over(upto)
    return both.withColumn("last", last).filter("kind = 1").select(
        "value", F.coalesce("last.cum", F.lit(0)).alias("le"),
        F.when(F.col("last.value") == F.col("value"), F.col("last.n")).otherwise(0).alias("eq"))


def hit_steps(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps of the buckets that ``asked`` values lie in: other buckets' files stay closed.

    The buckets hit are at most ``MOST`` small rows, so they are broadcast; that only
    some are hit, which the comparison says, makes the optimiser prune partitions by them.
    """
    hit = asked.groupBy(F.col("bucket").alias("hit")).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 0)
    return steps.join(F.broadcast(hit), F.col("bucket") == F.col("hit"), "left_semi")


def joined_ranks(probes: DataFrame, probe_col: str, ranks: DataFrame, size: DataFrame,
                 drop: Sequence[str] = ()) -> DataFrame:
    """Probes with percentile (<=), below (<), above and ``as_of``; null probes get null ranks."""
    probe = F.col(probe_col).cast("double")
    steps = ranks.select(F.col("value").alias("__v"), F.col("le").alias("__le"), F.col("eq").alias("__eq"))
    size = size.select(F.col("total").alias("__N"), "as_of")
    le, lt = F.col("__le") / F.col("__N"), (F.col("__le") - F.col("__eq")) / F.col("__N")
    ranked = (probes.filter(probe.isNotNull()).join(steps, probe == F.col("__v")).join(F.broadcast(size))
              .withColumn("percentile", F.lit(100.0) * le).withColumn("below", F.lit(100.0) * lt)
              .withColumn("above", F.lit(100.0) - F.col("below")).drop("__v", "__le", "__eq", "__N"))
    none = F.lit(None).cast("double")
    unranked = probes.filter(probe.isNull()).join(F.broadcast(size.drop("__N"))).select(
        "*", none.alias("percentile"), none.alias("below"), none.alias("above"))
    return ranked.unionByName(unranked)


def rank_stored(probes: DataFrame, probe_col: str, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks of the rows of ``probes`` in a stored snapshot, reading only the buckets they hit."""
    values = probes.select(F.col(probe_col).cast("double").alias("value")).filter(F.col("value").isNotNull()).distinct()
    asked = bucketize(values, "value", edges.select("__edges"), MOST)
    return joined_ranks(probes, probe_col, last_steps(asked, hit_steps(asked, steps)), edges)
