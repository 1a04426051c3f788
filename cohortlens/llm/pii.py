"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Addresses, numbers and the like are found by patterns; they are the protected
entities.  A term in a document that holds an entity discloses it if, over the
corpus, seeing the term leaves little doubt about the entity: the point-wise
mutual information PMI(e; t) is positive and comes within ``gap`` bits of the
entity's information content IC(e), which is to say that P(e | t) >= 2 ** -gap.
Such terms are generalised to their first letters where that is shown to disclose
less than the threshold, and removed otherwise, wherever they stand in the
document.  Probabilities are shares of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The contract's patterns, written so that a text is read in linear time: runs are
#: taken whole (possessively), and a match begins at the begin of a run or where
#: the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which the kind cannot occur.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
#: Words of three or more letters or digits that begin with a letter and are no part of an address.
WORD = r"(?<![\p{L}\p{N}@._%+-])\p{L}[\p{L}\p{N}]{2,}+(?![@_%+-]|\.[\p{L}\p{N}])"
ANY_WORD = r"\p{L}[\p{L}\p{N}]{2,}+"
GAP, SUPPORT, PREFIX = 1.0, 2, 3
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}

_BLOCK = 256


def _running(steps: Column, start: Column) -> Column:
    return F.slice(F.aggregate(steps, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))),
                   F.lit(2), F.size(steps))


def with_places(df: DataFrame, matches: str, parts: str, places: str) -> DataFrame:
    """Add where each match starts, given the matches of a pattern and the parts between them.

    Running sums are built block by block, so that a text with very many matches
    stays affordable.  Each step is a column of its own: an expression used within
    a lambda would be computed again for every element.
    """
    steps, blocks = f"{places}_steps", f"{places}_blocks"
    zero = F.lit(0).cast("bigint")
    df = df.withColumn(steps, _steps(F.col(matches), F.col(parts)))
    df = df.withColumn(blocks, F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(F.col(steps), b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array().cast("array<array<bigint>>")))
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    before = F.slice(F.concat(F.array(zero), _running(sums, zero)), F.lit(1), F.size(blocks))
    df = df.withColumn(places, F.when(F.size(blocks) > 0, F.flatten(F.zip_with(blocks, before, _running))).otherwise(
        F.array().cast("array<bigint>")))
    return df.drop(steps, blocks)


def _steps(matches: Column, parts: Column) -> Column:
    """From each match's start to the next one's; the first from the begin of the text."""
    return F.transform(matches, lambda _, i: (
        F.length(F.get(parts, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))).cast("bigint"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    one = (lambda i: F.substring(back, i, F.lit(1)).cast("int"))
    double = (lambda i: one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                       lambda a, i: a + F.when(i % 2 == 0, double(i)).otherwise(one(i))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _matches(kind: str) -> Column:
    """The matches of a kind with their places."""
    start = (lambda i: F.get(f"s_{kind}", i))
    return F.transform(f"m_{kind}", lambda m, i: F.struct(
        F.lit(kind).alias("kind"), start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("value")))


def entities(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """uid, doc_id, ``found``: kind, start, end, value of every valid match, and the text of
    rows that have any (of all with ``keep_text``).

    ``uid`` numbers the rows; write the result before using it twice.  Matches of
    a kind are leftmost and do not overlap; invalid ones are dropped without
    another try.  A null text has none.
    """
    df = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        every = F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))
        df = df.withColumn(f"m_{k}", F.when(F.contains("text", F.lit(NEEDS[k])), every).otherwise(none) if k in NEEDS else every)
    for k in KINDS:
        df = df.withColumn(f"p_{k}", F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none))
    for k in KINDS:
        df = with_places(df, f"m_{k}", f"p_{k}", f"s_{k}")
    spans = [F.filter(_matches(k), _check(k)) for k in KINDS]
    df = df.select("uid", "doc_id", F.concat(*spans).alias("found"), "text")
    return df if keep_text else df.withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def mentions(found: DataFrame) -> DataFrame:
    """uid, entity: the different entities of each row."""
    names = F.transform("found", lambda e: F.concat_ws(":", e["kind"], F.lower(e["value"])))
    return found.select("uid", F.explode(F.array_distinct(names)).alias("entity"))


def term_places(found: DataFrame) -> DataFrame:
    """uid, term, start, end of every whole word in the texts."""
    rows = found.select("uid", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("m"))
    rows = with_places(rows.withColumn("p", F.split("text", WORD, -1)), "m", "p", "s")
    return rows.select("uid", F.explode(F.arrays_zip("m", "s")).alias("w")).select(
        "uid", F.lower("w.m").alias("term"), F.col("w.s").alias("start"), (F.col("w.s") + F.length("w.m")).alias("end"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(ANY_WORD), F.lit(0)))


def term_documents(docs: DataFrame) -> DataFrame:
    """Number of documents each term occurs in (term, df), over all texts."""
    return docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, found: DataFrame, held: DataFrame, gap: float = GAP, support: int = SUPPORT) -> DataFrame:
    """entity, term, bits (PMI), information (IC) and generalised (null: remove) of disclosing pairs.

    ``held`` has the entities of each row.  ``support`` is the least number of
    documents a probability is estimated from, so entities of fewer documents form
    no pairs.
    """
    total = found.count()
    of_entity = stage(held.groupBy("entity").agg(F.count("*").alias("entity_df")).filter(F.col("entity_df") >= support),
                      "pii-of-entity")
    protected = held.join(of_entity.select("entity"), "entity").groupBy("uid").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    pairs = found.join(protected, "uid").select("entities", F.explode(_terms(F.col("text"))).alias("term"))
    joint = (pairs.groupBy("entities", "term").agg(F.count("*").alias("n"))
             .select(F.explode("entities").alias("entity"), "term", "n").groupBy("entity", "term")
             .agg(F.sum("n").alias("both")).filter(F.col("both") >= support))
    terms = stage(term_documents(docs), "pii-terms")
    prefix = (lambda t: F.left(t, F.lit(PREFIX)))
    widest = terms.groupBy(prefix(F.col("term")).alias("prefix")).agg(F.max("df").alias("prefix_df"))
    scored = (joint.join(terms, "term").join(of_entity, "entity")
              .withColumn("information", F.log2(F.lit(float(max(total, 1))) / F.col("entity_df")))
              .withColumn("bits", F.log2(F.col("both") * float(max(total, 1)) / (F.col("df") * F.col("entity_df"))))
              .filter((F.col("bits") >= F.col("information") - gap) & (F.col("bits") > 0)))
    # at most entity_df documents hold both entity and prefix, at least prefix_df hold the prefix
    safe = F.col("entity_df") < F.col("prefix_df") * 2.0 ** -gap
    return (scored.withColumn("prefix", prefix(F.col("term"))).join(widest, "prefix").select(
        "entity", "term", "bits", "information", F.when(safe, F.concat("prefix", F.lit("*"))).alias("generalised")))


def own_hits(found: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """uid, term, replacement: the terms of each row that disclose an entity of the same row.

    A row's own terms meet the entities that they disclose, then the row's entities.  An
    entity is in at least 2^-gap of the documents of a term that discloses it, so few rows
    are formed that do not stay.
    """
    near = held.join(pairs.select("entity").distinct(), "entity", "left_semi").select("uid").distinct()
    own = found.join(near, "uid", "left_semi").select("uid", F.explode(_terms(F.col("text"))).alias("term"))
    return own.join(pairs, "term").join(held, ["uid", "entity"], "left_semi").groupBy("uid", "term").agg(
        F.min(F.coalesce("generalised", F.lit(MARKS[TERM]))).alias("replacement"))


def protect(docs: DataFrame, gap: float = GAP, support: int = SUPPORT, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id and ``spans`` (kind, start, end, replacement) by kind, then start.

    Base kinds come first, then the kind ``term``: terms that disclose an entity,
    wherever they stand in a document that holds it.  Positions are code
    points, ends exclusive.  A null or empty text has no spans; repeated rows get
    the same spans each, and count as documents of their own; other columns are
    ignored.
    """
    found = stage(entities(docs, keep_text), "pii-entities")
    held = stage(mentions(found), "pii-held")
    pairs = disclosing(docs, found, held, gap, support)
    hits = stage(own_hits(found, held, stage(pairs, "pii-pairs")), "pii-hits")
    places = term_places(found.join(hits.select("uid").distinct(), "uid", "left_semi"))
    added = places.join(hits, ["uid", "term"]).groupBy(F.col("uid").alias("of")).agg(F.sort_array(F.collect_list(F.struct(
        F.lit(TERM).alias("kind"), "start", "end", "replacement"))).alias("added"))
    marks = F.create_map(*(F.lit(x) for k in KINDS for x in (k, MARKS[k])))
    base = F.transform("found", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), marks[s["kind"]].alias("replacement")))
    spans = F.when(F.col("added").isNull(), base).otherwise(F.concat(base, F.col("added")))
    return found.join(added, F.col("uid") == F.col("of"), "left").select(
        "doc_id", spans.alias("spans"), *(["text"] if keep_text else []))


def sanitise(docs: DataFrame, gap: float = GAP, support: int = SUPPORT) -> DataFrame:
    """doc_id and the text with every span replaced: entities by their kind's mark, terms by
    their generalisation or mark.  Of overlapping spans the first one's replacement stands.
    """
    rows = protect(docs, gap, support, keep_text=True)
    rows = rows.withColumn("sorted", F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))))
    done = F.aggregate(
        F.col("sorted"), F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                                     s["replacement"]).alias("out"), s["end"].alias("at"))))
    return rows.withColumn("done", done).select("doc_id", F.concat(
        "done.out", F.substring("text", (F.col("done.at") + 1).cast("int"), F.length("text"))).alias("text"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def digest(spans: DataFrame) -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as text."""
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
