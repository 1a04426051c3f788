"""Structured Streaming jobs over a directory of submissions.

The form of the original appends one scored row per submission to a log,
and a second program reads the newest row against the population.  Here a
directory of submission files is the stream source; every job keeps its
progress in a checkpoint folder under the shared checkpoint directory, so a
restarted query resumes where it stopped (exactly-once file sinks).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions import band_label, bmi, bmi_index
from ..operators.clean import valid_submission_condition
from ..operators.distribution import bucket_edges, bucketize, cumulative, default_buckets
from . import changelog
from .snapshot import ROWS, joined_ranks, last_steps, open_snapshot, rank_stored, snapshot_complete, write_snapshot


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A file-directory stream with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


def score_submissions(sub: DataFrame, labels: Sequence[str] = S.BMI_LABELS_LONG) -> DataFrame:
    """W1 body: validate (C9), compute BMI, index and label.

    Stateless Column expressions: the same function serves a batch frame
    and a stream.
    """
    ok = sub.filter(valid_submission_condition("age", "height_cm", "weight_kg"))
    b = bmi(F.col("height_cm"), F.col("weight_kg"))
    return (ok.withColumn("bmi", b)
              .withColumn("index", bmi_index(F.col("bmi")))
              .withColumn("category", band_label(F.col("index"), labels)))


def start_score(sub: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream scored submissions into a Parquet folder (append)."""
    w = (score_submissions(sub).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def percentile_snapshot(pop: DataFrame, col: str, n_buckets: int | None = None) -> DataFrame:
    """W2 static side: ``(value, n, cum, total, as_of)``, one row per distinct population value.

    ``as_of`` is the time the snapshot was taken: write the table once, then
    stream against it, and ranks are as of that time.
    """
    return cumulative(pop, col, n_buckets=n_buckets).withColumn("as_of", F.current_timestamp())


def rank_against(probes: DataFrame, probe_col: str, snapshot: DataFrame,
                 n_buckets: int | None = None) -> DataFrame:
    """W2 body: percentile (<=), below (<) and above of each probe row of a batch, with ``as_of``.

    Snapshot values and distinct probes are dealt into buckets whose edges are
    snapshot values, so the last value up to a probe lies in the probe's bucket;
    a window over each bucket carries it to the probe.  No arrays travel with the
    rows, and no task holds more than a bucket.  Null probes get null ranks.
    """
    nb = n_buckets or default_buckets(probes.sparkSession)
    values = probes.select(F.col(probe_col).cast("double").alias("value")).filter(F.col("value").isNotNull()).distinct()
    edges = bucket_edges(snapshot, nb)
    asked, steps = (bucketize(x, "value", edges, nb) for x in (values, snapshot.select("value", "cum", "n")))
    size = snapshot.agg(F.max("total").alias("total"), F.max("as_of").alias("as_of"))
    return joined_ranks(probes, probe_col, last_steps(asked, steps), size)


def start_percentile(sub: DataFrame, snapshot: DataFrame, out: str, checkpoint: str,
                     probe_col: str = "bmi", bucket_rows: int = ROWS) -> StreamingQuery:
    """Stream each scored submission's rank in the population.

    The snapshot is written once into the query's checkpoint folder, in bucket
    folders, and read back; each micro-batch reads only the buckets that its probes
    fall in.  A restarted query goes on with it, and needs nothing else of the first
    run; one whose write did not complete is written anew.  Each micro-batch goes to
    its own ``batch_id=<n>`` folder with overwrite, so a replayed batch replaces
    its first attempt.
    """
    spark = sub.sparkSession
    path = os.path.join(checkpoint, "population-snapshot")
    if not snapshot_complete(spark, path):
        write_snapshot(snapshot, path, bucket_rows)
    steps, edges = open_snapshot(spark, path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the buckets it hits, and again for its rows
        try:
            rank_stored(batch, probe_col, steps, edges).write.mode("overwrite").parquet(
                os.path.join(out, f"batch_id={batch_id}"))
        finally:
            batch.unpersist()

    return (sub.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_updates(sub: DataFrame, key: str = "user_id",
                   order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """W3 body: newest row per user as streaming state (update mode)."""
    rest = [c for c in sub.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return sub.groupBy(key).agg(best.alias("__row")).select(key, "__row.*")


def _start(writer, spark: SparkSession, state_partitions: int | None) -> StreamingQuery:
    """Start a stateful query; ``state_partitions`` fixes its state-store
    partition count on the first run (a new checkpoint), as the session's
    shuffle partitions are read when the query starts and then kept."""
    if state_partitions is None:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def start_latest(sub: DataFrame, out: str, checkpoint: str, key: str = "user_id",
                 order: Sequence[str] = ("ts", "event_id"),
                 state_partitions: int | None = None, compact_after: int = 32) -> StreamingQuery:
    """Changed users of each micro-batch written under their batch id.

    Each micro-batch goes to its own ``batch_id=<n>`` folder with overwrite,
    so a batch replayed after a failure replaces its first attempt
    (idempotent sink).  Past ``compact_after`` folders they are merged into a base
    (see ``changelog``), so ``read_latest`` reads a row per user and a bounded
    number of batches.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
        changelog.compact_if(sub.sparkSession, out, key, order, compact_after)

    writer = (latest_updates(sub, key, order).writeStream.outputMode("update")
              .foreachBatch(sink).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    return _start(writer, sub.sparkSession, state_partitions)


def read_latest(spark: SparkSession, out: str, key: str = "user_id",
                order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Current row per user from the W3 update log (last batch wins)."""
    return changelog.current(spark, out, key, order).drop("batch_id")


def category_counts(sub: DataFrame, ts: str = "ts", window: str = "1 day",
                    delay: str = "1 hour", category: str = "category") -> DataFrame:
    """W4 body: submissions per category per tumbling window, with watermark.

    Watermarks need a zoned ``timestamp``; a ``timestamp_ntz`` input is read
    as UTC wall time whatever the session time zone (``convert_timezone``),
    and window bounds are returned as UTC wall time again.  Rows later than
    the watermark are dropped by Spark, as watermark semantics define.
    """
    col = F.col(ts)
    if dict(sub.dtypes).get(ts) == "timestamp_ntz":
        col = F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp")

    def wall(c):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))

    return (sub.select(col.alias("__ts"), F.col(category))
               .withWatermark("__ts", delay)
               .groupBy(F.window("__ts", window), F.col(category))
               .agg(F.count(F.lit(1)).alias("n"))
               .select(wall(F.col("window.start")).alias("window_start"),
                       wall(F.col("window.end")).alias("window_end"),
                       category, "n"))


def start_category_counts(sub: DataFrame, out: str, checkpoint: str, state_partitions: int | None = None,
                          open_windows: bool = False, **kw) -> StreamingQuery:
    """Append closed windows to a Parquet folder.

    With ``open_windows`` the changed counts of every micro-batch, of windows
    still open too, go to its own ``batch_id=<n>`` folder; ``read_category_counts``
    folds them to the current counts.
    """
    if open_windows:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

        changed = (category_counts(sub, **kw).writeStream.outputMode("update").foreachBatch(sink)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True))
        return _start(changed, sub.sparkSession, state_partitions)
    writer = (category_counts(sub, **kw).writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append")
              .trigger(availableNow=True))
    return _start(writer, sub.sparkSession, state_partitions)


def read_category_counts(spark: SparkSession, out: str) -> DataFrame:
    """Current count per window and category from the log of changes (counts only grow)."""
    log = spark.read.parquet(out)
    return log.groupBy(*[c for c in log.columns if c not in ("n", "batch_id")]).agg(F.max("n").alias("n"))
