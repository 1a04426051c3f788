"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its words and their beginnings, hashed; the value is
ln(1 + count).  One weight vector serves all grades: P(grade <= k) is the
logistic function of threshold k minus the score, and the thresholds are kept in
order.  The result is the expected grade.  Weights have an L1 penalty, so that
only marker features stay and a long clean text gathers no score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordMemory, grown, map_batches, slices

DIMENSIONS = 1 << 20
PREFIXES = (4, 5, 6)
#: Labelled documents that the model learns from, of grade 0 and of higher grades each.
SAMPLE = 4000
GRADES = 4
STEPS, RATE, PENALTY = 200, 0.5, 1e-3
#: A feature must occur in so many documents of the sample to get a weight.
SUPPORT = 4
FLAGGED = 0.5


class Model(NamedTuple):
    features: np.ndarray  # sorted ids of features with a weight
    weights: np.ndarray
    thresholds: np.ndarray


def features(word: str) -> list[int]:
    """Feature ids of a word: its letter runs and their beginnings, in lower case."""
    runs = [word.lower()] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).lower().split()
    names = [x for r in runs for x in (r, *(f"{r[:n]}*" for n in PREFIXES if len(r) >= n))]
    return [xxhash.xxh32_intdigest(x.encode()) % DIMENSIONS for x in names]


class Counter:
    """Counts of the features of texts; those of a word are looked up once and remembered."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = None if wanted is None else set(wanted.tolist())
        self.memory = WordMemory(self._learn)
        self.ids = np.zeros(1 << 16, np.int64)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str], first: int) -> None:
        found = [features(w) for w in new]
        if self.wanted is not None:
            found = [[i for i in f if i in self.wanted] for f in found]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        used, last = int(self.start[first - 1] + self.length[first - 1]), first + len(new)
        total = int(lengths.sum())
        self.ids, self.start, self.length = grown(self.ids, used + total), grown(self.start, last), grown(self.length, last)
        self.ids[used:used + total] = np.fromiter((i for f in found for i in f), np.int64, total)
        self.start[first:last], self.length[first:last] = used + np.cumsum(lengths) - lengths, lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) of all features that occur, by text and feature."""
        numbers, bounds = self.memory.numbers(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        some = self.length[numbers] > 0
        numbers, text = numbers[some], text[some]
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]
        keys, counts = np.unique(np.repeat(text, lengths) * DIMENSIONS + ids, return_counts=True)
        return keys // DIMENSIONS, keys % DIMENSIONS, counts


def sample(docs: DataFrame, grades: DataFrame, size: int = SAMPLE) -> DataFrame:
    """grade, weight and text of about ``size`` labelled documents each of grade 0 and above.

    ``grades`` has doc_id and grade.  Documents are chosen by a hash of the id;
    ``weight`` restores the shares of the two classes.
    """
    above = F.col("grade") > 0
    n = grades.agg(F.count(F.when(above, 1)).alias("toxic"), F.count(F.when(~above, 1)).alias("clean")).first()
    share = {k: min(1.0, size / max(n[k], 1)) for k in ("toxic", "clean")}
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = grades.withColumn("share", F.when(above, share["toxic"]).otherwise(share["clean"])).filter(place < F.col("share"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "grade", (1 / F.col("share")).alias("weight"), F.coalesce("text", F.lit("")).alias("text"))


def counted(rows: DataFrame, wanted: np.ndarray | None = None) -> pa.Table:
    """grade, weight, features and counts of a bounded sample, on the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(wanted)
        for part in slices(batches):
            text, feature, count = counter(part.column("text"))
            bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("grade"), part.column("weight"),
                 pa.ListArray.from_arrays(bounds, pa.array(feature, pa.int32())),
                 pa.ListArray.from_arrays(bounds, pa.array(count, pa.int32()))], ["grade", "weight", "features", "counts"])

    return map_batches(rows, run, "grade int, weight double, features array<int>, counts array<int>").toArrow()


def _chances(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for every k, with a column of 0 before and of 1 behind."""
    inner = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -40, 40)))
    return np.hstack([np.zeros((len(score), 1)), inner, np.ones((len(score), 1))])


def fit(rows: pa.Table, grades: int = GRADES) -> Model | None:
    """Maximum likelihood with an L1 penalty, by proximal gradient steps scaled per feature.

    None if the rows have no grade above 0 or none at 0.
    """
    grade = rows["grade"].to_numpy().astype(np.int64)
    if not len(grade) or grade.max() == 0 or grade.min() > 0:
        return None
    weight = rows["weight"].to_numpy()
    weight = weight / weight.sum()
    lists = rows["features"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(lists.offsets.to_numpy()))
    feature = lists.flatten().to_numpy()
    frequent = np.bincount(feature, minlength=DIMENSIONS)[feature] >= SUPPORT
    row, feature = row[frequent], feature[frequent]
    known, column = np.unique(feature, return_inverse=True)
    value = np.log1p(rows["counts"].combine_chunks().flatten().to_numpy()[frequent].astype(float))
    w, scale = np.zeros(len(known)), np.full(len(known), 1e-8)
    theta, theta_scale = np.linspace(2.0, 2.0 + grades - 2, grades - 1), np.full(grades - 1, 1e-8)
    for _ in range(STEPS):
        score = np.bincount(row, w[column] * value, len(grade))
        below = _chances(score, theta)
        at = np.arange(len(grade))
        hi, lo = below[at, grade + 1], below[at, grade]
        own = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / own * weight, lo * (1 - lo) / own * weight
        g = np.bincount(column, (slope_hi - slope_lo)[row] * value, len(known))
        g_theta = -np.bincount(grade, slope_hi, grades)[:grades - 1] + np.bincount(grade, slope_lo, grades)[1:]
        scale += g * g
        theta_scale += g_theta * g_theta
        rate = RATE / np.sqrt(scale)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        theta = np.maximum.accumulate(theta - RATE / np.sqrt(theta_scale) * g_theta + 1e-3 * np.arange(grades - 1))
    used = w != 0
    return Model(known[used].astype(np.int64), w[used], theta)


_COUNTERS: list[tuple[Model, Counter]] = []  # of the model in use, in each Python worker


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, expected_severity, grade, toxicity, toxic.

    ``toxicity`` is the probability of a grade above 0, and ``toxic`` says whether
    it reaches 0.5; ``grade`` is the most likely grade (the lower of equal ones).
    A null or empty text has no features and the score 0; without a model
    everything is 0.  Equal texts are graded alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None and (not _COUNTERS or _COUNTERS[0][0] is not m):
            _COUNTERS[:] = [(m, Counter(m.features))]
        for part in slices(batches):
            n = part.num_rows
            if m is None:
                chance = np.hstack([np.ones((n, 1)), np.zeros((n, GRADES - 1))])
            else:
                text, feature, count = _COUNTERS[0][1](pc.fill_null(part.column("text"), ""))
                weight = m.weights[np.searchsorted(m.features, feature)] if len(feature) else np.zeros(0)
                chance = np.diff(_chances(np.bincount(text, weight * np.log1p(count), n), m.thresholds), axis=1)
            toxic = 1 - chance[:, 0]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(chance @ np.arange(chance.shape[1])),
                 pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= FLAGGED)],
                ["doc_id", "expected_severity", "grade", "toxicity", "toxic"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       run, "doc_id bigint, expected_severity double, grade int, toxicity double, toxic boolean")


def graded(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, grades: int = GRADES) -> pa.Table:
    """A labelled sample with severity grades, from labels that only say toxic or not.

    A first model tells toxic from clean; toxic documents are graded 1 and up by
    its score, in classes of equal size.  Labels with a ``grade`` need no such step.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("grade"))
    rows = counted(sample(docs, marks, size))
    first = fit(rows, 2)
    if first is None:
        return rows
    lists = rows["features"].combine_chunks()
    ids, count = lists.flatten().to_numpy(), rows["counts"].combine_chunks().flatten().to_numpy()
    at = np.minimum(np.searchsorted(first.features, ids), max(len(first.features) - 1, 0))
    weight = np.where(first.features[at] == ids, first.weights[at], 0.0) if len(first.features) else np.zeros(len(ids))
    score = np.bincount(np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())), weight * np.log1p(count), len(rows))
    grade = rows["grade"].to_numpy().astype(np.int32)
    toxic = grade > 0
    limits = np.quantile(score[toxic], np.linspace(0, 1, grades)[1:-1])
    grade = np.where(toxic, 1 + np.searchsorted(limits, score, side="left"), 0).astype(np.int32)
    return rows.set_column(rows.schema.get_field_index("grade"), "grade", pa.array(grade, pa.int32()))


def grade(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Learn from a bounded sample of labelled documents, and grade all documents."""
    return predict(docs, fit(graded(docs, labels, size)))
