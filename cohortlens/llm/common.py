"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import scratch_path

#: The folder that holds the library.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here.

    The rows survive lost executors, and every later use reads them instead of
    computing them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Python workers give freed memory back to the system: between tasks they keep little of what large batches took.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2",
        "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


#: Bytes of an Arrow batch, beside its rows: else 10,000 long texts lie in the JVM, on the way and in Python at once.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def on_path(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, with the memory settings ``LEAN``
    and ``BATCH_BYTES`` where the session has none of its own."""
    env = spark.sparkContext.environment
    for name, value in LEAN.items():
        env.setdefault(name, value)
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver found it, for any column names."""
    on_path(df.sparkSession)
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(fn, schema)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` does not have (any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text: maximal runs without space and U+0009 to U+000D; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_GAP, -1))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_bytes`` of text.

    Bounds the memory of a task whatever the batch size; a longer text forms a
    slice of its own and stays whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cum = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < len(size):
            base = cum[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cum, base + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def give_back() -> None:
    """Give the memory that Arrow and the C library keep for reuse back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None

_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task: at most one thing.

    Asked by another key, it lets go of the old one, with its arrays and its words, before it makes
    the new, and gives the memory back to the system.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            if WordMemory.in_use is not None:
                WordMemory.in_use.reset()
                WordMemory.in_use = None
            gc.collect()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


class WordMemory:
    """What has been computed of words, so that a repeated word costs one lookup.

    ``learn(words, first)`` stores the values of new words under the numbers from
    ``first`` on; number 0 is the empty word.  Beyond ``room`` words or
    characters in them the memory starts anew, so it is bounded; and a Python
    worker that goes over to another operator forgets the words of the one before.
    """

    in_use: WordMemory | None = None

    def __init__(self, learn: Callable[[list[str], int], None], room: int = 400_000, chars: int = 20_000_000):
        self.learn, self.room, self.chars = learn, room, chars
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.held = 0

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words (cut at spaces and line feeds) and each text's bounds."""
        if WordMemory.in_use is not self:
            if WordMemory.in_use is not None:
                WordMemory.in_use.reset()
            WordMemory.in_use = self
        if len(self.known) > self.room or self.held > self.chars:
            self.reset()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.known
        number = np.fromiter(map(known.get, vocabulary.tolist(), repeat(-1)), np.int64, len(vocabulary))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new = vocabulary[unknown].tolist()
            first = len(known)
            self.learn(new, first)
            number[unknown] = np.arange(first, first + len(new))
            known.update(zip(new, range(first, first + len(new))))
            self.held += sum(map(len, new))
            if len(new) > 1000:  # learning them took far more memory than they keep
                give_back()
        offsets = split.offsets.to_numpy().astype(np.int64)
        return (number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)), offsets - offsets[0]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` rows."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros((max(size - len(array), len(array)), *array.shape[1:]), array.dtype)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) between successive bounds."""
    cum = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return cum[bounds[1:]] - cum[bounds[:-1]]
