"""A log of changed rows per key, folded into a base from time to time.

A log folder holds ``batch_id=<n>`` folders, each with the changed rows of one
micro-batch, and under ``base`` (a published folder, see ``sources.storage``) one
row per key as of some batch.  The base of the highest committed batch counts;
batches up to it are folded in already, later ones are read beside it.

Compaction writes the new base aside and commits it last: killed before that, it
leaves the log as it was.  What a base replaces stays for one more generation, so
a reader that has opened the log goes on undisturbed; the next compaction takes
it away, with the remains of killed ones.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

_BATCH = "batch_id="


def _bases(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(last batch folded in, folder) of the committed bases, oldest first."""
    found = storage.committed(spark, os.path.join(out, "base"))
    return sorted((int(name.split("-", 1)[1]), folder) for name, folder in found.items())


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Ids of the batches whose write ran to its end."""
    ids = [int(n[len(_BATCH):]) for n in storage.names(spark, out) if n.startswith(_BATCH)]
    return sorted(i for i in ids if storage.completed(spark, os.path.join(out, f"{_BATCH}{i}")))


def _folded(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of the last batch per key (within a batch by ``order``): a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col("batch_id"), *[F.col(c) for c in order]))
    return rows.groupBy(key).agg(best.alias("__row")).select(key, "__row.*")


def _rows(spark: SparkSession, out: str) -> tuple[DataFrame, int, int]:
    """Base and later batches as one table with ``batch_id``; the last batch, and how many lie beside the base."""
    bases, batches = _bases(spark, out), _batches(spark, out)
    upto = bases[-1][0] if bases else -1
    later = [i for i in batches if i > upto]
    parts = []
    if bases:
        parts.append(spark.read.parquet(bases[-1][1]))
    if later:
        log = spark.read.option("basePath", out).parquet(*[os.path.join(out, f"{_BATCH}{i}") for i in later])
        parts.append(log.withColumn("batch_id", F.col("batch_id").cast("bigint")))
    if not parts:
        raise FileNotFoundError(f"no batch has been written to {out}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows, max([upto, *later]), len(later)


def current(spark: SparkSession, out: str, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, with the ``batch_id`` that it comes from."""
    return _folded(_rows(spark, out)[0], key, order)


def compact(spark: SparkSession, out: str, key: str, order: Sequence[str]) -> int:
    """Fold all batches into a new base; returns the last batch in it.

    Run by the log's one writer.  Removes what the base before the last replaced.
    """
    rows, last, later = _rows(spark, out)
    bases = _bases(spark, out)
    if not later:
        return last
    storage.publish(_folded(rows, key, order), os.path.join(out, "base"), f"upto-{last}",
                    lambda df, folder: df.write.parquet(folder))
    if bases:
        _sweep(spark, out, keep={folder for upto, folder in _bases(spark, out) if upto >= bases[-1][0]}, upto=bases[-1][0])
    return last


def _sweep(spark: SparkSession, out: str, keep: set[str], upto: int) -> None:
    """Remove batches up to ``upto`` and every base but those to keep, commits first."""
    base = os.path.join(out, "base")
    for name, folder in storage.committed(spark, base).items():
        if folder not in keep:
            storage.remove(spark, os.path.join(base, "commits", name))
    for part in storage.names(spark, os.path.join(base, "parts")):
        if os.path.join(base, "parts", part) not in keep:
            storage.remove(spark, os.path.join(base, "parts", part))
    for i in _batches(spark, out):
        if i <= upto:
            storage.remove(spark, os.path.join(out, f"{_BATCH}{i}"))


def compact_if(spark: SparkSession, out: str, key: str, order: Sequence[str], most: int) -> bool:
    """Compact once more than ``most`` batches lie beside the base."""
    upto = max([u for u, _ in _bases(spark, out)], default=-1)
    if sum(i > upto for i in _batches(spark, out)) <= most:
        return False
    compact(spark, out, key, order)
    return True
