"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose measure exceeds a cutoff.  Cutoffs are chosen
per stratum on labelled documents that no rule was fitted to: a cutoff is
accepted if, by the exact binomial (Clopper-Pearson) bound, the rule rejects at
most a share ``alpha`` of good documents.  Cutoffs of one rule are tested from
the loosest on until one fails, which needs no correction; the confidence is
divided by the number of rules and strata (Bonferroni).  So with probability
``1 - delta`` every rule keeps its limit in every stratum.  Where the labelled
documents are too few to show that, the rule stays off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACES, stage, words

ALPHA, DELTA = 0.02, 0.05
GRID = 200
MIN_WORDS = 50
WINDOW = 3
RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals")


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    and ``grid``: each rule's measure as a whole number from 0 to ``GRID``.

    A null text has no words.  Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    hashes = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))))
    df = df.select(
        "doc_id", "stratum", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).alias("n_capitals"),
        lines.alias("lines"), hashes.alias("h"))
    df = df.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                   F.size("lines").alias("n_lines"), (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    df = df.drop("lines").withColumn("s", F.when(F.col("again"), F.array_sort(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = (lambda x, j, k: F.coalesce(F.get("s", j + k)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))).drop("h", "s")
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    share = (lambda a, b: F.when(b > 0, F.least(F.lit(GRID), F.ceil(a * GRID / b))).otherwise(0).cast("int"))
    n, chars = F.col("n_words"), F.col("word_chars")
    grid = F.array(share(F.col("n_symbols"), chars), share(F.col("n_dup_lines"), F.col("n_lines")),
                   share(F.col("n_repeat_words"), n), share(chars, n * 40), share(F.col("n_capitals"), chars))
    counts = [F.col(c).cast("bigint").alias(c) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select("doc_id", "stratum", *counts,
                     ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"), grid.alias("grid"))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 8, shifted back."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.log(x) + F.log(x + 1)
    for i in range(2, 8):
        shift = shift + F.log(x + i)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k successes in n trials of chance p), for k < n * p; 1 for greater k.

    The sum runs downwards from k in units of its first term.  Its terms fall off
    as fast as a normal density, so 12 * sqrt(n) + 100 of them are enough.
    """
    k, n = k.cast("double"), n.cast("double")
    first = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
             + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 100).cast("int")
    odds = (1 - p) / p
    terms = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"),
                              (a["term"] * (k - j) / (n - k + j + 1) * odds).alias("term")))["sum"]
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(first) * terms)).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labelled good documents: ``cut_stratum`` and ``cuts``, a
    cutoff per rule (null: the rule is off).

    All labelled documents count: rows of ``labels`` (doc_id, quality) with
    quality 1; a document labelled twice counts twice.
    """
    good = measured.join(labels.filter("quality = 1").select(F.col("doc_id").alias("labelled")),
                         F.col("doc_id") == F.col("labelled")).filter(~F.col("base_failed"))
    counts = stage(good.select("stratum", F.posexplode("grid").alias("rule", "value"))
                   .groupBy("stratum", "rule", "value").agg(F.count("*").alias("n")), "quality-counts")
    group = Window.partitionBy("stratum", "rule")  # at most GRID + 1 rows each
    above = group.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tests = counts.select("stratum", "rule").distinct().count()
    tail = binomial_tail(F.col("rejected"), F.col("total"), alpha)
    passed = (counts.withColumn("rejected", F.coalesce(F.sum("n").over(above), F.lit(0)))
              .withColumn("total", F.sum("n").over(group))
              .filter(tail <= delta / max(tests, 1)))
    best = passed.groupBy("stratum", "rule").agg(F.min("value").alias("cut"))
    return best.groupBy(F.col("stratum").alias("cut_stratum")).agg(F.map_from_entries(F.collect_list(
        F.struct("rule", "cut"))).alias("m")).select("cut_stratum", F.array(*(
            F.try_element_at("m", F.lit(i)) for i in range(len(RULES)))).alias("cuts"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
          delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts of ``measures``, base_failed, kept, and failed_rules.

    ``kept`` is false if base_failed, else whether no rule's measure exceeds its
    cutoff.  A document in a stratum without cutoffs (a null stratum is one of
    its own) is judged by base_failed alone.  Repeated rows are judged alike, and
    an empty table gives no rows.
    """
    measured = stage(measures(docs, stratum), "quality-measures")
    cuts = stage(cutoffs(measured, labels, alpha, delta), "quality-cutoffs")
    both = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    failed = F.filter(F.array(*(F.when(F.get("grid", F.lit(i)) > F.get("cuts", F.lit(i)), F.lit(r))
                                for i, r in enumerate(RULES))), lambda x: x.isNotNull())
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
