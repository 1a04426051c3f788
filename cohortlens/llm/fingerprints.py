"""Document fingerprints by locally consistent parsing.

A text is cut into phrases where deterministic coin tossing says so: symbols are
reduced to labels below six that differ from their neighbours', and phrases
begin at local maxima.  Where a cut falls depends on a few symbols around it, so
equal substrings are cut alike inside, wherever they stand.  Phrases get names
(hashes of their symbols), the names are parsed again, and so on.  The
fingerprint is the sketch of a document's phrase names: the ``SKETCH`` smallest
of them, whose overlap estimates the likeness of two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, slices

SKETCH = 64
LEVELS, FIRST_NAMED = 4, 2  # phrases of about 3, 10, 30 and 90 characters; names from the second on
ROUNDS = 3  # coin tosses after the first: labels below 128, 14, 8, 6

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(1 << 12, _A, np.uint64))
_LOW = np.array([0, *((i & -i).bit_length() - 1 for i in range(1, 256))], np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def _tossed(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels 0..5 of symbols of which no two neighbours within a text are equal."""
    differ = np.empty_like(symbols)
    differ[1:] = symbols[1:] ^ symbols[:-1]
    differ[starts] = 1
    low = ((differ & (~differ + np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023
    labels = (2 * low + ((symbols >> low.astype(np.uint64)) & np.uint64(1)).view(np.int64)).astype(np.uint8)
    for _ in range(ROUNDS):
        differ = np.empty_like(labels)
        differ[1:] = labels[1:] ^ labels[:-1]
        differ[starts] = 1
        low = _LOW[differ]
        labels = 2 * low + ((labels >> low) & np.uint8(1))
    return labels


def parsed(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases of all texts, and where each text's begin.

    Runs of one symbol count as a symbol of their own before the coin is tossed.
    """
    begins = np.ones(len(symbols), bool)
    begins[1:] = symbols[1:] != symbols[:-1]
    begins[starts] = True
    if begins.all():
        text_at = starts
    else:
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols = symbols[at]
        symbols = np.where(length > 1, _mixed(symbols ^ (length * _B)), symbols)
        text_at = np.searchsorted(at, starts)
    labels = _tossed(symbols, text_at)
    cut = np.zeros(len(symbols), bool)
    cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    cut[np.append(text_at[1:], len(symbols)) - 1] = False  # a text's last symbol has no neighbour
    cut[text_at] = True
    phrase = np.flatnonzero(cut)
    size = np.diff(np.append(phrase, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(phrase, size)
    names = np.add.reduceat(_mixed(symbols) * _POWERS[np.minimum(place, len(_POWERS) - 1)], phrase)
    return _mixed(names + size.astype(np.uint64)), np.searchsorted(phrase, text_at)


def sketches(texts: list[str], block: int = 1 << 18) -> list[np.ndarray]:
    """The smallest distinct 32-bit phrase names of each text, ascending; empty for an empty text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    todo: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if text:
            todo.append(i)
            held += len(text)
        if todo and (held >= block or i == len(texts) - 1):
            for j, sketch in zip(todo, _sketched([texts[k] for k in todo])):
                out[j] = sketch
            todo, held = [], 0
    return out


def _sketched(texts: list[str]) -> list[np.ndarray]:
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum([0, *map(len, texts[:-1])])
    keys = []
    for level in range(1, LEVELS + 1):
        symbols, starts = parsed(symbols, starts)
        if level >= FIRST_NAMED:
            owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.append(starts, len(symbols))))
            keys.append(owner << np.uint64(32) | symbols >> np.uint64(32))
    keys = np.unique(np.concatenate(keys))
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    names = keys.astype(np.uint32)
    return [names[a:min(b, a + SKETCH)] for a, b in pairwise(bounds.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrase names, from 0 to 1; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    if len(a) < SKETCH and len(b) < SKETCH:
        return len(twice) / (len(both) - len(twice))
    union = np.unique(both)[:SKETCH]
    return float((twice <= union[-1]).sum() / len(union))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, range, tail: rows dealt out by ranges of doc_id and sorted, descending.

    Each text crosses the network once.  The first row of a range also goes to
    the end of the range before it (that of the first range to the last), marked
    ``tail``, so that every row's successor follows it in the same partition.
    One id per range is broadcast.  Equal ids follow each other by text; a null
    id comes last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), key.cast("double").alias("place"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    edges = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol="place", outputCol="b").transform(rows).withColumn(
        "range", -F.col("b").cast("int"))
    firsts = dealt.groupBy("range").agg(F.max("key").alias("head")).orderBy("range").collect()  # a row per range
    heads = spark.createDataFrame([(r["head"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)],
                                  "head bigint, before int")
    both = dealt.join(F.broadcast(heads), F.col("key") == F.col("head"), "left")
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")),
                     F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))
    both = both.select("key", "doc_id", "text", F.explode(F.when(F.col("head").isNull(), F.slice(places, 1, 1)).otherwise(
        places)).alias("p")).select("key", "doc_id", "text", "p.range", "p.tail")
    return both.repartition(parts, "range").sortWithinPartitions("range", "tail", F.col("key").desc(), "text").drop("key")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint, of its edited text too, and likenesses.

    The edited text has the last third of the code points (rounded down)
    replaced by the first as many, or all, of the next document by descending
    doc_id; after the last comes the first, and a lone document follows itself.
    A null or empty text has an empty fingerprint.  Equal rows have equal
    fingerprints, and other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in slices(batches, max_bytes=1 << 20):
            texts = part.column("text").to_pylist()
            rows = [*held, *zip(part.column("tail").to_pylist(), part.column("doc_id").to_pylist(), texts, sketches(texts))]
            held = rows[-1:]
            pairs = [(a, b) for a, b in pairwise(rows) if not a[0]]
            if not pairs:
                continue
            edited = [a[2][:len(a[2]) - len(a[2]) // 3] + b[2][:len(a[2]) // 3] for a, b in pairs]
            changed = sketches(edited)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([a[1] for a, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [text_of(a[3]) for a, _ in pairs], "edited_fingerprint": [text_of(s) for s in changed],
                "near_edited": [likeness(a[3], s) for (a, _), s in zip(pairs, changed)],
                "near_next": [likeness(a[3], b[3]) for a, b in pairs]})

    return map_batches(in_order(docs), run, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))
