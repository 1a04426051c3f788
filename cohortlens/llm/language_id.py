"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letter runs of its words (lower case, with marks
for begin and end).  N-grams are 64-bit hashes in sorted arrays shared by all
languages; a row holds the interpolated probability in each language.  A text
gets the language with the lowest cross-entropy per symbol, and is rejected if
that is higher than texts of the language, of such a length, have it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordMemory, fresh, give_back, grown, held, map_batches, slices, stage, sums

ORDER = 5
SAMPLE = 1500  # documents a language that models learn from
FOLDS = 5
#: Standard deviations above a language's median cross-entropy; by Chebyshev's
#: inequality at most 1 text in 144 of the language itself lies beyond.
STRICTNESS = 12.0
UNKNOWN = "und"
BEGIN, END = 2, 3
PIECE = 1 << 16  # entries of a model's table that come to the driver as one row

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Model(NamedTuple):
    """Per order: sorted hashes of n-grams and of contexts, a column per language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # hashes, probabilities (0: not seen)
    contexts: list[tuple[np.ndarray, np.ndarray]]  # hashes, weights of the lower order (1: not seen)
    floor: np.ndarray  # probability of a symbol before any n-gram
    mean: np.ndarray  # cross-entropy per symbol of the language's own texts
    spread: np.ndarray  # its variance is spread[0] + spread[1] / symbols


def held_out(doc_id: Column) -> Column:
    """Documents that nothing may be learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def runs(word: str) -> list[str]:
    """The runs of letters in a word, in lower case."""
    if word.isalpha():
        return [word.lower()]
    return "".join(c if c.isalpha() else " " for c in word).lower().split()


def symbols(units: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each symbol's place in its unit, the unit's number, and n-gram hashes by order."""
    text = chr(BEGIN) + f"{chr(END)}{chr(BEGIN)}".join(units) + chr(END)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.flatnonzero(code == BEGIN)
    unit = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
    place = np.arange(len(code)) - first[unit]
    hashes = [(code + np.uint64(1)) * _MIX]
    for _ in range(ORDER - 1):
        longer = np.empty_like(code)
        longer[0] = 0
        longer[1:] = (hashes[-1][:-1] ^ (hashes[-1][:-1] >> np.uint64(29))) * _STEP + hashes[0][1:]
        hashes.append(longer)
    return place, unit, hashes


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))


def estimate(units: list[str], counts: np.ndarray) -> tuple[list, list, float]:
    """Interpolated Kneser-Ney estimates of one language from its letter runs.

    The highest order counts occurrences, lower orders count distinct symbols to
    the left; n-grams at the begin have none and keep their occurrences.
    """
    place, unit, hashes = symbols(units)
    weight = counts[unit].astype(np.float64)
    levels = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero((place >= k - 1) & (place >= 1))
        grams, first, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
        levels.append((grams, at[first], np.bincount(inverse, weight[at], len(grams))))
    grams_by_order, contexts_by_order = [], []
    below, base = None, 1.0 / (len(levels[0][0]) + 1)
    for k in range(1, ORDER + 1):
        grams, at, count = levels[k - 1]
        if k < ORDER:
            left = levels[k][1]  # a place of each longer n-gram; its suffix is ours
            extended, n = np.unique(hashes[k - 1][left], return_counts=True)
            spot, hit = _find(extended, grams)
            count = np.where(hit, n[spot], count)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(grams), np.uint64)
        known, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, count, len(known))
        back = discount * kinds / total
        lower = base if below is None else below[1][_find(below[0], hashes[k - 2][at])[0]]
        chance = (count - discount) / total[inverse] + back[inverse] * lower
        grams_by_order.append((grams, chance))
        contexts_by_order.append((known, back))
        below = (grams, chance)
    return grams_by_order, contexts_by_order, base


def _joined(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([t[0] for t in tables]))
    values = np.full((len(keys), len(tables)), missing, np.float32)
    for i, (key, value) in enumerate(tables):
        values[np.searchsorted(keys, key), i] = value
    return keys, values


class Scorer:
    """Cross-entropy of words in every language; each word is scored once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.memory = WordMemory(self._learn, min(400_000, (1 << 25) // (8 * max(len(model.languages), 1))))
        self.bits = np.zeros((1 << 16, len(model.languages)))
        self.count = np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str], first: int) -> None:
        last = first + len(new)
        self.bits, self.count = grown(self.bits, last), grown(self.count, last)
        units, owner = [], []
        for i, word in enumerate(new):
            for run in runs(word):
                units.append(run)
                owner.append(i)
        bits, count = np.zeros((len(new), self.bits.shape[1])), np.zeros(len(new), np.int64)
        for i in range(0, len(units), 20_000):
            whose, found = self._score(units[i:i + 20_000], np.array(owner[i:i + 20_000], np.int64))
            count += np.bincount(whose, minlength=len(new))
            for k in range(bits.shape[1]):
                bits[:, k] += np.bincount(whose, found[:, k], len(new))
        self.bits[first:last], self.count[first:last] = bits, count

    def _score(self, units: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word of each symbol, and its bits in every language."""
        place, unit, hashes = symbols(units)
        target = np.flatnonzero(place >= 1)
        chance = np.tile(self.model.floor.astype(np.float32), (len(target), 1))
        for k in range(1, ORDER + 1):
            fits = np.flatnonzero(place[target] >= k - 1)
            at = target[fits]
            keys, values = self.model.contexts[k - 1]
            spot, hit = _find(keys, hashes[k - 2][at - 1] if k > 1 else np.zeros(len(at), np.uint64))
            lower = chance[fits] * np.where(hit[:, None], values[spot], 1)
            keys, values = self.model.grams[k - 1]
            spot, hit = _find(keys, hashes[k - 1][at])
            seen = np.where(hit[:, None], values[spot], 0)
            chance[fits] = np.where(seen > 0, seen, lower)
        return owner[unit[target]], -np.log2(np.maximum(chance, 1e-30))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages) and number of symbols."""
        numbers, bounds = self.memory.numbers(texts)
        count = sums(self.count[numbers], bounds)
        return sums(self.bits[numbers], bounds) / np.maximum(count, 1)[:, None], count


def _place() -> Column:
    """Where a document lies from 0 to 1, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)


def _sampled(docs: DataFrame, sample: int) -> tuple[DataFrame, Column, list[str]]:
    """About ``sample`` documents a language to learn from, those whose place lies below the share
    of their language; that share, null for unlabelled ones; and the languages that have fewer
    than ``sample`` others."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    shares = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"]))))) \
        if sizes else F.create_map().cast("map<string,double>")
    share = F.element_at(shares, F.col("lang").cast("string"))
    few = [r["lang"] for r in sizes if r["n"] < 2 * sample]
    return known.filter(_place() < share), share, few


def _with_folds(scored: DataFrame, learned: DataFrame, few: list[str]) -> DataFrame:
    """Scores of texts not learned from, and for the languages ``few`` those of the learned ones,
    each by a model that has not seen its fold (equal texts are in one)."""
    mine = learned.filter(F.col("lang").isin(few)).withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)))
    for fold in range(FOLDS if few else 0):
        part = learn(mine.filter(F.col("fold") != fold).select("lang", "text"))
        if part is not None:
            scored = scored.union(own_scores(mine.filter(F.col("fold") == fold).select("lang", "text"), part))
    return scored


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the text and lang of ``docs`` (with doc_id).

    The models learn from about ``sample`` whole documents a language, chosen by
    a hash of the id; with fewer documents all are learned from.  That bounds the
    models, which every task gets.  Each language is calibrated on all its other
    documents.  Where these are fewer than ``sample``, the learned ones count too,
    each scored by a model that has not seen its fold.  Null texts and languages
    are left out; None if nothing is left.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    learned, share, few = _sampled(docs, sample)
    learned = stage(learned.select("lang", "text"), "language-learned")
    model = learn(learned)
    if model is None:
        return None
    others = docs.filter(F.col("text").isNotNull() & (_place() >= share)).select("lang", "text")
    return calibrate(model, _with_folds(own_scores(others, model), learned, few), learned)


def learn(docs: DataFrame) -> Model | None:
    """Models of the languages in ``docs`` (lang, text), not calibrated; None without letters."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            split = pc.split_pattern(pc.replace_substring(part.column("text"), "\n", " "), " ")
            frame = pd.DataFrame({"lang": np.repeat(part.column("lang").to_pylist(), np.diff(split.offsets.to_numpy())),
                                  "word": split.flatten().to_pylist()})
            seen = frame.groupby(["lang", "word"], sort=False).size()
            yield pa.RecordBatch.from_pydict({
                "lang": seen.index.get_level_values(0).tolist(), "word": seen.index.get_level_values(1).tolist(),
                "n": seen.to_numpy()})

    counted = (map_batches(docs, count, "lang string, word string, n bigint")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    names = ["lang", "kind", "level", "first", "hashes", "chances"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def fit(seen: pa.Table) -> pa.Table:
        units: dict[str, int] = {}
        for word, n in zip(seen.column("word").to_pylist(), seen.column("n").to_pylist()):
            for run in runs(word):
                units[run] = units.get(run, 0) + n
        out = []
        if units:
            grams, contexts, floor = estimate(list(units), np.fromiter(units.values(), np.float64, len(units)))
            lang = seen.column("lang")[0].as_py()
            tables = [(kind, k, key, value.astype("<f4"))  # a model keeps 32 bits of them
                      for kind, levels in ((0, grams), (1, contexts)) for k, (key, value) in enumerate(levels)]
            tables.append((2, 0, np.zeros(1, np.uint64), np.array([floor], "<f8")))
            out = [(lang, kind, k, i, key[i:i + PIECE].astype("<u8").tobytes(), value[i:i + PIECE].tobytes())
                   for kind, k, key, value in tables for i in range(0, len(key), PIECE)]
        return pa.table([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names=names)

    fitted = counted.groupBy("lang").applyInArrow(
        fit, "lang string, kind int, level int, first bigint, hashes binary, chances binary")
    model = _assembled(fitted.toArrow())
    give_back()  # the driver too: arrays of the size of the model came and went
    return model


def _assembled(rows: pa.Table) -> Model | None:
    """The model of the tables' pieces, in any order; None without rows."""
    pieces: dict[tuple, list] = {}
    for lang, kind, level, first, *data in zip(*(rows.column(c) for c in (
            "lang", "kind", "level", "first", "hashes", "chances"))):
        pieces.setdefault((lang.as_py(), kind.as_py(), level.as_py()), []).append((first.as_py(), *(x.as_buffer() for x in data)))
    if not pieces:
        return None

    def table(lang: str, kind: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        found = sorted(pieces[lang, kind, level], key=lambda x: x[0])
        return (np.concatenate([np.frombuffer(x[1], "<u8") for x in found]),
                np.concatenate([np.frombuffer(x[2], "<f8" if kind == 2 else "<f4") for x in found]))

    languages = sorted({key[0] for key in pieces})
    grams, contexts = ([_joined([table(x, kind, k) for x in languages], missing) for k in range(ORDER)]
                       for kind, missing in ((0, 0.0), (1, 1.0)))
    floor = np.array([table(x, 2, 0)[1][0] for x in languages])
    n = len(languages)
    return Model(languages, grams, contexts, floor, np.zeros(n), np.zeros((2, n)))


def calibrate(model: Model, scored: DataFrame, learned: DataFrame) -> Model:
    """Median, and variance about it by length, of the cross-entropy of texts in their own language.

    ``scored`` has lang, bits, n of texts that were not learned from; a row a
    language comes to the driver.  A language none of whose texts is there, as one
    with a single document, gets the widest values of the others; if there are no
    others, all are calibrated on the ``learned`` texts.
    """
    scored = stage(scored, "language-scored")
    # rounded, so that the number of distinct values is bounded
    middle = (lambda rows: {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.percentile(F.round("bits", 4), 0.5).alias("bits"), F.percentile("n", 0.5).alias("n")).collect()})
    mid = middle(scored)
    if not mid:
        scored = stage(own_scores(learned, model), "language-scored")
        mid = middle(scored)

    def of(values: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang"))

    square = F.pow(F.col("bits") - of({x: float(r["bits"]) for x, r in mid.items()}), F.lit(2.0))
    long = F.col("n") >= of({x: float(r["n"]) for x, r in mid.items()})
    fixed = {r["lang"]: max(r["v"], 1e-4) for r in scored.groupBy("lang").agg(F.avg(F.when(long, square)).alias("v")).collect()}
    excess = F.greatest(square - of(fixed), F.lit(0.0)) * F.col("n")
    short = {r["lang"]: max(r["v"], 1.0) for r in scored.groupBy("lang").agg(F.avg(excess).alias("v")).collect()}
    columns = [{x: float(r["bits"]) for x, r in mid.items()}, fixed, short]
    mean, *spread = (np.array([c.get(x, max(c.values())) for x in model.languages]) for c in columns)
    return model._replace(mean=mean, spread=np.array(spread))


def own_scores(docs: DataFrame, model: Model) -> DataFrame:
    """lang, bits (cross-entropy in that language) and n (symbols) of texts with letters in learned languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs, _calibration(shared), "lang string, bits double, n bigint")


def _calibration(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        number = {x: i for i, x in enumerate(shared.value.languages)}
        for part in slices(batches):
            bits, n = scorer(part.column("text"))
            column = np.array([number.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
            there = np.flatnonzero((column >= 0) & (n > 0))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(there)), pa.array(bits[there, column[there]]), pa.array(n[there])],
                ["lang", "bits", "n"])
    return run


def _scored(docs: DataFrame, model: Model | None, keep: list[str], own: Column | None = None
            ) -> tuple[DataFrame, list[str]]:
    """The columns ``keep`` with prediction, score and cross-entropy, and inner columns: letters' number of
    symbols, and cross-entropy in the language ``own`` (null if that has no model).  Also the new names."""
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])))
    names = fresh(rows, "lang_pred", "score", "cross_entropy", "n_symbols", "own_bits", "own_lang")
    mine = names[-1]
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])),
                       (F.lit(None) if own is None else own).cast("string").alias(mine))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            scorer = held(("language", id(m)), lambda: Scorer(m))
            languages = np.array(m.languages, dtype=object)
            number = {x: i for i, x in enumerate(m.languages)}
        for part in slices(batches):
            kept = [part.column(c) for c in keep]
            if m is None:
                n = part.num_rows
                out = [[UNKNOWN] * n, [0.0] * n, [None] * n, [0] * n, [None] * n]
            else:
                bits, n = scorer(pc.fill_null(part.column("text").cast(pa.string()), ""))
                best = bits.argmin(axis=1)
                low = bits.min(axis=1)
                gap = (bits - low[:, None]) * np.minimum(n, 50)[:, None]
                score = np.where(n > 0, 1 / np.exp2(-gap).sum(axis=1), 0.0)
                column = np.array([number.get(x, -1) for x in part.column(mine).to_pylist()], np.int64)
                in_own = np.where((column >= 0) & (n > 0), bits[np.arange(len(n)), column], np.nan)
                out = [np.where(n > 0, languages[best], UNKNOWN).tolist(), score, np.where(n > 0, low, np.nan), n, in_own]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(x, k, from_pandas=True) for x, k in zip(out, kinds))], [*keep, *names[:-1]])

    a, b, c, d, e, _ = names
    schema = f"{fields}, `{a}` string, `{b}` double, `{c}` double, `{d}` bigint, `{e}` double"
    return map_batches(rows, run, schema), names[:-1]


def _decided(scored: DataFrame, keep: list[str], names: list[str], model: Model | None, strictness: float) -> DataFrame:
    """Scored rows with ``rejected``: no letter, or a cross-entropy above the language's limit at this length."""
    predicted, _, bits, n, own = names
    limits = [(x, m, a, b) for x, m, a, b in zip(model.languages, model.mean, *model.spread)] if model else []

    def of(i: int) -> Column:  # a number per learned language
        pairs = [F.lit(v) for row in limits for v in (row[0], float(row[i]))]
        return F.element_at(F.create_map(*pairs), F.col(predicted)) if pairs else F.lit(0.0)

    limit = of(1) + strictness * F.sqrt(of(2) + of(3) / F.greatest(F.col(n), F.lit(1)))
    (rejected,) = fresh(scored.select(*(F.col(f"`{c}`") for c in [*keep, predicted, bits])), "rejected")
    return scored.withColumn(rejected, (F.col(n) == 0) | (F.col(bits) > limit)).select(
        *(F.col(f"`{c}`") for c in [*keep, *names[:3], rejected]))


def label(docs: DataFrame, model: Model | None, keep: list[str] | None = None,
          strictness: float = STRICTNESS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with lang_pred, score, cross_entropy, rejected.

    ``lang_pred`` is a learned language, or ``und`` (score 0, rejected) for a null
    text or one without a letter; all are ``und`` if no model was learned.
    ``score`` is the posterior of the language at equal priors, with the evidence
    of at most 50 symbols.  Ties go to the first language by code point.  Result
    columns whose name ``docs`` has get underscores in front.
    """
    keep = docs.columns if keep is None else keep
    scored, names = _scored(docs, model, keep)
    return _decided(scored, keep, names, model, strictness)


def identify(docs: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents that are not held out, and label all.

    Every document is scored once: the written scores calibrate the languages (those
    of labelled documents neither held out nor learned from, as in ``train``), and
    the limits found are then held against the same scores.
    """
    keep = docs.columns if keep is None else keep
    known = docs.filter(~held_out(F.col("doc_id")))
    learned, share, few = _sampled(known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), sample)
    learned = stage(learned.select("lang", "text"), "language-learned")
    model = learn(learned)
    place, source = fresh(docs, "held_back", "own")
    back = docs.withColumn(place, ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & (_place() >= share)).withColumn(
        source, F.col("lang").cast("string"))
    inner = [*keep, place, source]
    scored, names = _scored(back, model, inner, F.col(source))
    scored = stage(scored, "language-scored")
    if model is not None:
        own = names[4]
        mine = scored.filter(F.col(place) & F.col(own).isNotNull()).select(
            F.col(source).alias("lang"), F.col(own).alias("bits"), F.col(names[3]).alias("n"))
        model = calibrate(model, _with_folds(mine, learned, few), learned)
    return _decided(scored, keep, names, model, STRICTNESS)
