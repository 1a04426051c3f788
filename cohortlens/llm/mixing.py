"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget in proportion to its weight, but at
most ``max_epochs`` times its own words; what a clamped source cannot take is
shared out again among the others by weight, until no target is above its cap.
A source's target is then met by whole repetitions of all its documents plus a
fractional repetition: its documents in a seeded order until the rest is used
up, the last one in part.

No task ever holds a source: the seeded order is the order of a hash, cut into
4,096 buckets; bucket totals tell in which bucket a source's rest ends, and only
that bucket is ordered document by document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACES, WORD_GAP, stage, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20


class Mix(NamedTuple):
    """What a mix takes: per source, and per document of the sources' last buckets."""

    sources: DataFrame  # mix_source, mix_size, mix_target, mix_whole, mix_edge
    edges: DataFrame  # edge_order, edge_size, edge_source, edge_words


def word_count(text: Column) -> Column:
    """Number of words (runs without space and U+0009 to U+000D); null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAP, -1))).cast("bigint")


def seeded(doc_id: Column, seed: int = SEED) -> Column:
    """The place of a document in the seeded order, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _bucket(order: Column) -> Column:
    return F.substring(order, 1, 3)


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and place of every document; other columns are left out."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"),
                       seeded(F.col("doc_id"), seed).alias("order"))


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Repeat ``weights`` over the sources by code point, null last.

    The rank is the rank within a range of sources plus the sizes of the ranges
    before it, so any number of sources can be ranked.
    """
    ranged = stage(sources.repartitionByRange(F.col("source").asc_nulls_last())
                   .withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(inside) - 1
    choice = F.array(*map(F.lit, weights))
    return (ranged.withColumn("rank", rank).join(F.broadcast(parts), "part")
            .withColumn("weight", F.element_at(
                choice, ((F.col("rank") + F.col("before")) % len(weights) + 1).cast("int")))
            .drop("part", "rank", "before"))


def water_level(sources: DataFrame, budget: float, max_epochs: int = MAX_EPOCHS) -> float:
    """Words per unit of weight at which targets, clamped at their caps, add up to the budget.

    Each pass clamps the sources above their cap and shares the rest among the
    others; only two sums come to the driver.  If even all caps fall short of the
    budget, the level is infinite and every source stops at its cap.
    """
    cap, level, clamped = F.col("source_size") * max_epochs, 0.0, 0
    while True:
        full = F.lit(level) * F.col("weight") > cap
        row = sources.agg(F.sum(F.when(full, cap)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("w"),
                          F.count(F.when(full, 1)).alias("n")).first()
        if row["w"] is None:
            return float("inf") if row["n"] else 0.0
        if level and row["n"] == clamped:
            return level
        level, clamped = (budget - (row["fixed"] or 0)) / row["w"], row["n"]
        if not level:
            return 0.0


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
         max_epochs: int = MAX_EPOCHS) -> Mix:
    """Targets, repetitions and the documents where each fractional repetition ends.

    ``sized`` is a written table of ``sizes``.  Documents of equal id and size
    have equal places; at the end of the fraction they share it evenly.
    """
    by_bucket = stage(sized.groupBy("source", _bucket(F.col("order")).alias("bucket"))
                      .agg(F.sum("size").alias("words")), "mix-buckets")
    sources = weigh(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    total = by_bucket.agg(F.sum("words")).first()[0] or 0
    level = water_level(sources, share * total, max_epochs)
    size = F.col("source_size")
    target = F.least((size * max_epochs).cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(size == 0, 0).otherwise(F.floor(target / size))
    sources = sources.withColumn("target", target).withColumn("whole", whole).withColumn(
        "rest", F.round("target").cast("bigint") - F.col("whole") * size)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = sources.withColumnRenamed("source", "s")
    edge = (by_bucket.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
            .join(named, F.col("source").eqNullSafe(F.col("s")))
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))))
    found = edge.select(F.col("s").alias("e"), F.col("bucket").alias("edge"), "before")
    sources = stage(named.join(found, F.col("s").eqNullSafe(F.col("e")), "left").select(
        F.col("s").alias("mix_source"), F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"),
        F.col("whole").alias("mix_whole"), F.col("edge").alias("mix_edge"),
        (F.col("rest") - F.col("before")).alias("mix_rest")), "mix-plan")
    running = Window.partitionBy("source").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (sized.join(sources, F.col("source").eqNullSafe(F.col("mix_source"))
                       & (_bucket(F.col("order")) == F.col("mix_edge")))
            .groupBy("source", "order", "size", "mix_rest").agg(F.count("*").alias("copies"))
            .withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(running), F.lit(0)))
            .withColumn("left", F.greatest(F.lit(0), F.col("mix_rest") - F.col("before")))
            .select(F.col("source").alias("edge_source"), F.col("order").alias("edge_order"),
                    F.col("size").alias("edge_size"),
                    F.least(F.col("size"), F.floor(F.col("left") / F.col("copies"))).alias("edge_words")))
    return Mix(sources.drop("mix_rest"), stage(last, "mix-edges"))


def decide(rows: DataFrame, mix: Mix, source: Column, order: Column, size: Column) -> DataFrame:
    """Add mix_size, mix_target, mix_whole (repetitions) and mix_part (words of a further one).

    ``size`` is looked at only for documents in a source's last bucket.
    """
    bucket = _bucket(order)
    rows = rows.join(mix.sources, source.eqNullSafe(F.col("mix_source")), "left").join(
        mix.edges, source.eqNullSafe(F.col("edge_source")) & (order == F.col("edge_order")) & (
            F.when(bucket == F.col("mix_edge"), size) == F.col("edge_size")), "left")
    part = F.when(F.col("mix_edge").isNull() | (bucket > F.col("mix_edge")), F.lit(0)).when(
        bucket < F.col("mix_edge"), size).otherwise(F.coalesce("edge_words", F.lit(0)))
    return rows.withColumn("mix_part", part.cast("bigint")).drop(
        "mix_source", "mix_edge", "edge_source", "edge_order", "edge_size", "edge_words")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
              max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken words.

    A null text has size 0, null sources form one source that sorts last, an
    empty table gives no rows, and extra columns are ignored.  A source's taken
    words add up to its rounded target, but for fewer words than there are equal
    rows at the end of its fraction.
    """
    sized = stage(sizes(docs, seed), "mix-sizes")
    done = decide(sized, plan(sized, weights, share, max_epochs),
                  F.col("source"), F.col("order"), F.col("size"))
    return done.select("doc_id", "size", F.col("mix_size").alias("source_size"),
                       F.col("mix_target").alias("target"),
                       (F.col("mix_whole") * F.col("size") + F.col("mix_part")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
          max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``: repeated rows for
    repetitions, and the first words (joined by spaces) of the one document per
    source that is taken in part.  Texts are not shuffled.
    """
    names = docs.columns
    sized = stage(sizes(docs, seed), "mix-sizes")
    mix = plan(sized, weights, share, max_epochs)
    row = docs.select(F.struct(*names).alias("row"))
    order = seeded(F.col("row.doc_id"), seed)
    size = word_count(F.col("row.text"))
    done = decide(row, mix, F.col("row.source").cast("string"), order, size).withColumn("full", size)
    copies = F.when(F.col("mix_part") >= F.col("full"), F.col("mix_whole") + 1).otherwise(F.col("mix_whole"))
    parts = F.concat(
        F.when(F.col("full") > 0, F.array_repeat(F.lit(None).cast("bigint"), copies.cast("int"))).otherwise(
            F.array().cast("array<bigint>")),
        F.when((F.col("mix_part") > 0) & (F.col("mix_part") < F.col("full")), F.array("mix_part")).otherwise(
            F.array().cast("array<bigint>")))
    done = done.withColumn("part", F.explode(parts))
    text = F.when(F.col("part").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.slice(words(F.col("row.text")), 1, F.col("part").cast("int")), " "))
    out = []
    for f in docs.schema.fields:
        value = F.col(f"row.`{f.name}`")
        if f.name == "text":
            value = text
        elif f.name == "n_chars":
            value = F.when(F.col("part").isNull(), value).otherwise(F.length(text)).cast(f.dataType)
        out.append(value.alias(f.name))
    return done.select(*out)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+'))::BIGINT AS size,
         md5('20:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS fixed,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((1.5::DOUBLE * total - fixed) / free) AS level FROM c),
t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, level * w) AS target FROM s, v),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
q AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, round(r.target)::BIGINT - r.whole * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, rest - before)))::BIGINT AS taken
FROM q
"""
