"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Documents with equal sets of five-word shingles form one node.  Nodes that share
a band of their MinHash signature are candidates.  Candidates are compared in
batches of signature places: a pair goes as soon as the posterior probability
that its similarity reaches the threshold, given the matches so far, falls below
``miss``; survivors are verified on their full shingle sets.

A bucket is never expanded into all pairs.  In each round every member of a
bucket is compared with a few hubs of it, links merge components, and buckets
whose members are in one component are done.  What is left after the rounds is
compared across components, but for pairs that exact bounds rule out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordMemory, fresh, grown, held, map_batches, slices, stage

SHINGLE = 5
THRESHOLD = (75, 100)
ROWS, BANDS, BATCH = 4, 32, 32
MISS = 1e-6
MAP_BITS = 1024
HUBS, ROUNDS = 2, 3

_PLACES = ROWS * BANDS
_FACTORS = np.random.default_rng(4).integers(1, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, letters A-Z in lower case; each word is hashed once."""

    def __init__(self):
        self.memory = WordMemory(self._learn, 150_000)  # a hash is cheap to make again
        self.hashes = np.zeros(1 << 16, np.uint64)

    def _learn(self, new: list[str], first: int) -> None:
        self.hashes = grown(self.hashes, first + len(new))
        self.hashes[first:first + len(new)] = np.fromiter(
            (xxhash.xxh64_intdigest(w.encode().lower()) for w in new), np.uint64, len(new))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words on end, and the bounds of each text."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, "[\\t\\x0b\\x0c\\r]")).as_py():
            texts = pc.replace_substring_regex(texts, "[\\t\\x0b\\x0c\\r]", " ")
        numbers, bounds = self.memory.numbers(texts)
        real = numbers > 0
        return self.hashes[numbers[real]], np.concatenate([[0], np.cumsum(real)])[bounds]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles.

    A text of fewer words has its whole sequence as its one shingle, a text
    without words the empty set.
    """
    words, bounds = held("word hashes", WordHashes)(texts)
    rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        rolled = rolled * _BASE + words[j:j + len(rolled)]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= SHINGLE:
            sets.append(np.unique(rolled[start:end - SHINGLE + 1]))
        elif end > start:
            sets.append(np.array([xxhash.xxh64_intdigest(words[start:end].tobytes(), seed=int(end - start))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _bit_map(shingles: np.ndarray) -> np.ndarray:
    there = np.zeros(MAP_BITS, bool)
    there[(shingles >> np.uint64(20)) % np.uint64(MAP_BITS)] = True
    return np.packbits(there).view(np.int64)


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (sets x places) of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), _PLACES), np.uint32)
    mixed = np.empty_like(flat)
    for i, factor in enumerate(_FACTORS):
        np.multiply(flat, factor, out=mixed)
        out[:, i] = np.minimum.reduceat(mixed, starts) >> np.uint64(32)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (key of the shingle set; null if empty), signature, bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            signature: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                found = _signatures([sets[i] for i in full])
                keys = np.zeros((len(full), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = (keys ^ found[:, j::ROWS]) * _BASE
                    keys ^= keys >> np.uint64(29)
                keys = (keys + np.arange(BANDS, dtype=np.uint64)) * _BASE
                for i, places, band in zip(full, found.astype("<u2"), keys.view(np.int64)):
                    signature[i], bands[i] = places.tobytes(), band
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(_key, sets), pa.binary()),
                 pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "signature", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       run, "doc_id bigint, n_shingles bigint, node binary, signature binary, bands array<bigint>")


def least_matches(miss: float = MISS) -> list[tuple[int, int]]:
    """(places compared, matches needed): fewer matches mean a posterior below ``miss``.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1); its tail above t is the probability of at most m
    successes in n + 1 trials of chance t.
    """
    num, den = THRESHOLD
    t, out = num / den, []
    for n in range(BATCH, _PLACES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(pairs: DataFrame, nodes: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) that survive the comparison of signatures batch by batch."""
    steps = least_matches(miss)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, _PLACES)
                           for c in ("sa", "sb"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in steps:
                matches[alive] += (left[alive, n - BATCH:n] == right[alive, n - BATCH:n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    signature = nodes.select("node", "signature")
    both = (pairs.join(signature.toDF("b", "sb"), "b").join(signature.toDF("a", "sa"), "a"))
    return map_batches(both.select("a", "b", "sa", "sb"), run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    num, den = THRESHOLD
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"),
                          (F.size("x") + F.size("y")).alias("total"))
    return counted.filter(den * F.col("common") >= num * (F.col("total") - F.col("common"))).select("a", "b")


def _room(x: Column, y: Column) -> Column:
    """Sizes that allow the threshold."""
    num, den = THRESHOLD
    return den * F.least(x, y) >= num * F.greatest(x, y)


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components in ``labels`` (node, label) that ``links`` (a, b) join.

    Every label hooks to its smallest neighbour and the graph is contracted, until
    no edge is left.  Labels are hashes, so their order is random and the number
    of passes grows with the logarithm of the longest chain.
    """
    ends = labels.select(F.col("node"), F.col("label"))
    edges = (links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b")
             .filter("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    edges = stage(edges, "near-edges")
    while not edges.isEmpty():
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = stage(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "near-hooks")
        edges = stage(edges.join(hook.toDF("x", "mx"), "x").join(hook.toDF("y", "my"), "y").filter("mx != my")
                      .select(F.least("mx", "my").alias("x"), F.greatest("mx", "my").alias("y")).distinct(), "near-edges")
        labels = stage(labels.join(hook.toDF("label", "m"), "label", "left")
                       .select("node", F.coalesce("m", "label").alias("label")), "near-labels")
    return labels


def _stars(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs of bucket members with a few hubs of the bucket, across components."""
    open_ = _open(members, labels)
    hubs = F.array_distinct(F.array(*(
        F.min_by(F.struct("node", "label", "n"), F.xxhash64("node", F.lit(turn * HUBS + i))) for i in range(HUBS))))
    stars = open_.groupBy("band").agg(hubs.alias("hubs"))
    pairs = (open_.join(stars, "band").select("node", "label", "n", F.explode("hubs").alias("hub"))
             .filter((F.col("label") != F.col("hub.label")) & _room(F.col("n"), F.col("hub.n"))))
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of buckets that hold more than one component."""
    labelled = members.join(labels, "node")
    mixed = (labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo != hi").select("band"))
    return labelled.join(mixed, "band")


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs across components of the open buckets that could still be links.

    Two exact bounds rule out pairs before they are formed.  A shingle that occurs,
    among all open members, in one component only cannot be shared across
    components.  And a bit that only one of two members' maps of shingles has
    stands for at least one shingle that the other lacks.
    """
    num, den = THRESHOLD
    open_ = stage(_open(members, labels), "near-open")
    nodes = open_.select("node", "label", "n").distinct()
    tokens = sets.join(nodes, "node").select("node", "label", F.explode("shingles").alias("token"))
    single = (tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
              .filter("lo = hi").select("token"))
    own = tokens.join(single, "token").groupBy("node").agg(F.count("*").alias("own"))
    can = (nodes.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
           .filter(den * F.col("common") >= num * F.col("n")).select("node", "common"))
    can = stage(can.join(sets.select("node", "bits"), "node"), "near-can")
    left = stage(_open(members.join(can, "node"), labels), "near-left")
    other = left.toDF("band", *(f"{c}_2" for c in left.columns[1:]))
    enough = (lambda common: (den + num) * common >= num * (F.col("n") + F.col("n_2")))
    pairs = left.join(other, (left["band"] == other["band"]) & (F.col("node") < F.col("node_2"))
                      & (F.col("label") != F.col("label_2")) & enough(F.least("n", "n_2", "common", "common_2"))
                      & enough(F.col("n") - _only("bits", "bits_2")) & enough(F.col("n_2") - _only("bits_2", "bits")))
    return pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def _only(mine: str, other: str) -> Column:
    """Number of bits in the one map that the other lacks."""
    words = (F.bit_count(F.get(mine, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i))))) for i in range(MAP_BITS // 64))
    return reduce(lambda x, y: x + y, words)


def components(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and node, the key of its
    shingle set (null if that is empty).

    ``component_id`` is the smallest doc_id reachable over links of similarity
    0.75 or more, and ``kept`` marks the documents that carry it.  A text without
    words has n_shingles 0, its own component, and is kept; so is a null text.
    Repeated rows and equal texts are in one component; rows that repeat a doc_id
    with its component are all marked kept.  Other columns are ignored.
    """
    rows = stage(signed(docs), "near-signed")
    nodes = stage(rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first(F.struct("n_shingles", "signature", "bands")).alias("s"))
        .select("node", "first_id", F.col("s.n_shingles").alias("n"), "s.signature", "s.bands"), "near-nodes")
    spread = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = (spread.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .filter("lo != hi").select("band"))
    members = stage(spread.join(shared, "band"), "near-members")
    labels = stage(members.select("node", F.col("node").alias("label")).distinct(), "near-labels")
    sets = stage(_sets(docs, labels.join(nodes.select("node", "first_id"), "node").select("node", "first_id")), "near-sets")
    seen = None
    for turn in range(ROUNDS + 1):
        pairs = _stars(members, labels, turn) if turn < ROUNDS else _rest(members, labels, sets)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        if turn < ROUNDS and pairs.isEmpty():
            continue
        seen = pairs if seen is None else seen.union(pairs)
        links = stage(confirmed(stage(likely(pairs, nodes, miss), "near-likely"), sets), "near-links")
        labels = merge(labels, links)
    named = nodes.select("node", "first_id").join(labels, "node")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "label").select("node", F.col("component_id").alias("c"))
    by_node = stage(nodes.select("node", "first_id").join(found, "node", "left").select(
        "node", F.coalesce("c", "first_id").alias("component_id")), "near-components")
    with_words = rows.filter("node is not null").select("doc_id", "n_shingles", "node").join(by_node, "node")
    without = rows.filter("node is null").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "n_shingles", "component_id", "node"]
    return with_words.select(*out).union(without.select(*out)).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component.

    Rows that repeat a doc_id are told apart by their shingle sets; of rows equal
    in both the first by text stays.  Texts without words all stay.  Only the ids
    of dropped and repeated documents are joined with the texts.
    """
    found = stage(components(docs, miss), "near-found")
    special = stage(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("stays"))
                    .filter("rows > 1 or not stays").withColumnRenamed("doc_id", "special"), "near-special")
    same = F.col("doc_id").eqNullSafe(F.col("special"))
    plain = docs.join(special.select("special"), same, "left_anti")
    again = docs.join(special.filter("stays").select("special"), same, "left_semi")
    node, place, mine, key = fresh(docs, "node", "place", "mine", "key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.append_column(node, pa.array(map(_key, shingle_sets(part.column("text"))), pa.binary()))

    keyed = map_batches(again, run, f"{fields}, `{node}` binary")
    verdict = found.filter("kept").select(F.col("doc_id").alias(mine), F.col("node").alias(key)).distinct()
    keyed = keyed.join(verdict, F.col("doc_id").eqNullSafe(F.col(mine)) & F.col(node).eqNullSafe(F.col(key)), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # partial aggregates: a row that repeats often spreads over all tasks
    one = keyed.filter(F.col(node).isNotNull()).groupBy("doc_id", node).agg(F.min_by(row, F.col("text")).alias(place))
    bare = keyed.filter(F.col(node).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    return plain.unionByName(bare).unionByName(one.select(*(F.col(place)[c].alias(c) for c in docs.columns)))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full shingle sets (node, shingles) of the wanted nodes, from their first documents, and
    a map of ``MAP_BITS`` bits that says which remainders they have; one row a node.

    Documents without id meet the nodes that have no other ones by the node key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"))
            keys = [_key(s) for s in sets]
            wants = part.column("node").to_pylist()  # null: whatever node the text has
            mine = [i for i, (key, node) in enumerate(zip(keys, wants)) if key is not None and node in (None, key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in mine], pa.binary()),
                 *(pa.array([f(sets[i]) for i in mine], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), _bit_map))],
                ["node", "shingles", "bits"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("first_id"), F.col("text").cast("string").alias("text"))
    named = texts.join(wanted, "first_id").select("node", "text")
    bare = texts.filter("first_id is null").select(F.lit(None).cast("binary").alias("node"), "text")
    schema = "node binary, shingles array<bigint>, bits array<bigint>"
    sets = map_batches(named, run, schema).union(
        map_batches(bare, run, schema).join(wanted.filter("first_id is null").select("node"), "node", "left_semi"))
    # a row may occur several times, with the same id and text
    return sets.dropDuplicates(["node"])
