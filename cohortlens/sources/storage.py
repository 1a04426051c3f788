"""Published folders: parts written aside, then made visible by a small commit.

A *published* folder holds ``parts/<name>`` (written by any number of tasks, in
any number of attempts) and ``commits/<name>``, one row that says which part
counts for that name.  A part without its commit is invisible, so a write that
is killed changes nothing; a name is committed once, so a write that is repeated
changes nothing either.  Paths go through Hadoop's file system, so any store
that Spark writes to will do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's mark of a completed write.
DONE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it is absent."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def completed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` ran to its end."""
    return exists(spark, os.path.join(path, DONE))


def publish(df: DataFrame, root: str, name: str, write: Callable[[DataFrame, str], None]) -> bool:
    """Write ``df`` by ``write(df, folder)`` and commit it as ``name``; False if that name is committed already.

    Two attempts at the same name may both write a part; the commit folder is
    created once, and the attempt that comes second leaves its part unread.
    """
    spark = df.sparkSession
    commit = os.path.join(root, "commits", name)
    if completed(spark, commit):
        return False
    part = f"{name}-{uuid.uuid4().hex[:12]}"
    write(df, os.path.join(root, "parts", part))
    line = spark.createDataFrame([(name, part)], "name string, part string").coalesce(1)
    line.write.mode("overwrite").parquet(commit)
    return True


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """Name -> folder of every committed part (one small row a name)."""
    commits = os.path.join(root, "commits")
    done = [n for n in names(spark, commits) if completed(spark, os.path.join(commits, n))]
    if not done:
        return {}
    rows = spark.read.schema("name string, part string").parquet(*[os.path.join(commits, n) for n in done]).collect()
    return {r["name"]: os.path.join(root, "parts", r["part"]) for r in rows}
