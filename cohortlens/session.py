"""Session helper and the shared scratch folder.

On a cluster the session comes from the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Tests and local runs get a fresh
folder under the system temporary directory when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every run gets (unless the caller overrides them).
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for a single-machine run only: loopback networking, no web UI,
# shuffle partitions sized for a few cores.  Never applied on a cluster.
_LOCAL_ONLY = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.host": "127.0.0.1",
}


def get_session(master: str | None = None, app: str = "cohortlens",
                **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    ``master="local[...]"`` adds the single-machine settings.  The SQL
    defaults are applied only to keys the launch configuration does not set,
    so on a cluster (spark-submit, no master given) the platform's settings
    stay as they are; ``conf`` (``spark__sql__x="v"``) always applies.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            for k, v in _LOCAL_ONLY.items():
                builder = builder.config(k, v)
    explicit = {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in explicit.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    launched = spark.sparkContext.getConf()
    for k, v in _SQL_DEFAULTS.items():
        if k not in explicit and not launched.contains(k):
            spark.conf.set(k, v)
    if _single_machine(spark):
        spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _single_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir);
    when neither is set, a local folder is created on a single machine, as in
    tests; on a cluster that is an error, as executors would not share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _single_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


# Intermediates the operators cache (distinct-value tables, per-group
# statistics).  They stay cached until ``release`` so that a returned, still
# lazy result can read them; a long-running session calls ``release`` after
# consuming its results.  On a lost executor Spark recomputes a cached block
# from its lineage, which is deterministic here.
_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache ``df`` (deserialized, spilling to disk) and remember it."""
    if not df.is_cached:
        df = df.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    _KEPT.append(df)
    return df


def release() -> int:
    """Unpersist every intermediate cached by the operators; returns how many."""
    n = len(_KEPT)
    for df in _KEPT:
        df.unpersist()
    _KEPT.clear()
    return n
