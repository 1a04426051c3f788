"""Exact top-k search by inner product: ball trees, branch and bound, one per shard.

Rows are dealt to clusters around a few pivots, and clusters to shards of bounded
size.  A shard's ball tree is searched from the node of the highest bound down,
<q, centre> + |q| * radius, until no open node can reach the current k-th score.
Queries go through their own cluster first; the k-th score found there goes with
them to all other shards, and keeps them from clusters whose bound lies below it.

A task holds the tree of one shard at a time; queries stream past it, so neither
their number nor that of the shards is bounded by memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, stage

K, EVERY, SCALE = 10, 100, 1024
#: Clusters (rows of the sample that all tasks know), rows of a shard at least and at most, of a leaf.
PIVOTS, SMALLEST, LARGEST, LEAF = 64, 1024, 65_536, 48
#: Stands for a null id, which comes behind all others.
NO_ID = np.iinfo(np.int64).max
#: Bounds are floats: this share of their size is added, far above rounding errors.
SLACK = 1e-9


def inner(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer query."""
    if not points.size:
        return np.zeros(len(points), np.int64)
    most = float(np.abs(points).max()) * float(np.abs(query).max()) * len(query)
    if most < 2.0**53:
        return (points.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return points @ query
    return points.astype(object) @ query.astype(object)


class BallTree:
    """Nodes over integer rows: centre, radius, and two children or a range of rows.

    A node of equal rows is a leaf, and keeps the ``k + 1`` smallest ids of them:
    the others cannot be among the best k, even if one row is the query's own.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, leaf: int = LEAF):
        centers, radii, spans, children = [], [], [], []
        kept: list[np.ndarray] = []
        size = 0
        floats = points.astype(np.float64)
        todo = [(np.arange(len(points)), -1)]
        while todo:
            members, parent = todo.pop()
            own = floats[members]
            center = own.mean(axis=0)
            radius = float(np.sqrt(((own - center) ** 2).sum(axis=1).max()))
            node = len(centers)
            if parent >= 0:
                children[parent].append(node)
            same = bool((points[members] == points[members[0]]).all())
            centers.append(own[0] if same else center)
            radii.append(0.0 if same else radius)
            children.append([])
            if same or len(members) <= leaf:
                if same:
                    members = members[np.lexsort((rows[members], ids[members]))[:k + 1]]
                kept.append(members)
                spans.append((size, size + len(members)))
                size += len(members)
                continue
            spans.append((0, 0))
            widest = int(np.argmax(own.var(axis=0)))
            order = np.argsort(own[:, widest], kind="stable")
            half = len(order) // 2
            todo += [(members[order[:half]], node), (members[order[half:]], node)]
        order = np.concatenate(kept)
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.norms = np.sqrt((self.centers ** 2).sum(axis=1))
        self.spans, self.children = spans, children
        small = float(np.abs(points).max()) if points.size else 0.0
        self.floats = self.points.astype(np.float64)
        self.exact = 2.0**53 / max(1.0, small * max(1, points.shape[1]))  # queries below this are exact in floats

    def bounds(self, nodes: list[int], query: np.ndarray, norm: float) -> np.ndarray:
        """No row below a node has a higher inner product."""
        reach = norm * self.radii[nodes]
        return self.centers[nodes] @ query + reach + SLACK * (norm * self.norms[nodes] + reach) + SLACK

    def search(self, query: np.ndarray, own: int, k: int, at_least: float) -> list[tuple[int, int, int]]:
        """(score, id, row) of the best k rows but ``own``, best first; none below ``at_least``."""
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row), the worst first
        floats = query.astype(np.float64)
        norm = float(np.sqrt(floats @ floats))
        plain = bool((np.abs(floats) < self.exact).all())
        limit = at_least
        root = float(self.bounds([0], floats, norm)[0])
        open_nodes = [(-root, 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < limit:
                break
            if self.children[node]:
                for child, b in zip(self.children[node], self.bounds(self.children[node], floats, norm).tolist()):
                    if b >= limit:
                        heapq.heappush(open_nodes, (-b, child))
                continue
            a, b = self.spans[node]
            scores = (self.floats[a:b] @ floats).astype(np.int64) if plain else inner(self.points[a:b], query)
            for i in np.flatnonzero(scores >= limit).tolist():
                if self.rows[a + i] == own:
                    continue
                entry = (int(scores[i]), -int(self.ids[a + i]), -int(self.rows[a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = max(limit, best[0][0])
        return [(s, -i, -r) for s, i, r in sorted(best, reverse=True)]


def vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """row (a stored number), vec_id, v: components as floor(scale * x).  Vectors with a hole stay out."""
    x, vec = F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return stage(table.filter(vec.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), x.cast("bigint").alias("vec_id"),
        F.transform(vec, lambda c: F.floor(c.cast("double") * scale)).alias("v")), "vectors")


def _matrices(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, values[offsets[at][:, None] + np.arange(size)]


def _nearest(pivots: list[list[int]], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of the rows' length, and how far it is; -1 if no pivot has that length."""
    fitting = [i for i, p in enumerate(pivots) if len(p) == matrix.shape[1]]
    cluster, distance = np.full(len(matrix), -1), np.zeros(len(matrix))
    if fitting:
        floats = matrix.astype(np.float64)
        apart = np.stack([np.sqrt(((floats - np.array(pivots[i], np.float64)) ** 2).sum(axis=1)) for i in fitting])
        cluster, distance = np.array(fitting)[apart.argmin(axis=0)], apart.min(axis=0)
    return cluster, distance


def _dealt(rows: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """Rows with their cluster and their distance from its pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, matrix in _matrices(batch):
                cluster[at], distance[at] = _nearest(pivots, matrix)
            yield batch.append_column("cluster", pa.array(cluster)).append_column("distance", pa.array(distance))

    return map_batches(rows, run, "row bigint, vec_id bigint, v array<bigint>, cluster int, distance double")


def _reachable(queries: DataFrame, pivots: list[list[int]], radii: dict[int, float]) -> DataFrame:
    """Queries with the other clusters that may hold a score of at least their ``floor``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
            home = batch.column("cluster").to_numpy()
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for at, matrix in _matrices(batch):
                floats = matrix.astype(np.float64)
                norm = np.sqrt((floats ** 2).sum(axis=1))
                for i, p in enumerate(pivots):
                    if len(p) != matrix.shape[1] or i not in radii:
                        continue
                    center = np.array(p, np.float64)
                    reach = norm * radii[i]
                    bound = floats @ center + reach + SLACK * (norm * np.sqrt(center @ center) + reach) + SLACK
                    for row in at[~(bound < floor[at]) & (home[at] != i)].tolist():
                        found[row].append(i)
            yield batch.select(["row", "vec_id", "v", "floor"]).append_column("clusters", pa.array(found, pa.list_(pa.int32())))

    return map_batches(queries.select("row", "vec_id", "v", "floor", "cluster"), run,
                       "row bigint, vec_id bigint, v array<bigint>, floor bigint, clusters array<int>")


def _searched(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """Best k of each query in each shard it was sent to: query, query_id, row, vec_id, score.

    Rows of a shard come first and become its tree; its queries follow, batch by batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = -1
        held: list[pa.RecordBatch] = []
        trees: dict[int, BallTree] | None = None
        for batch in batches:
            number, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if number[a] != shard:
                    shard, held, trees = number[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = _trees(held, k), []
                yield from _answers(trees, part, k)

    none = F.lit(None).cast("bigint")
    both = rows.select("shard", F.lit(False).alias("asks"), "row", "vec_id", "v", none.alias("floor")).unionByName(
        queries.select("shard", F.lit(True).alias("asks"), "row", "vec_id", "v", "floor"))
    return map_batches(both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "asks", "row"), run,
                       "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint")


def _trees(parts: list[pa.RecordBatch], k: int) -> dict[int, BallTree]:
    """A tree for each length of the vectors of a shard."""
    out: dict[int, BallTree] = {}
    if parts:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
        rows = batch.column("row").to_numpy()
        for at, matrix in _matrices(batch):
            out[matrix.shape[1]] = BallTree(matrix, ids[at], rows[at], k)
    return out


def _answers(trees: dict[int, BallTree], queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    asked, names = queries.column("row").to_pylist(), queries.column("vec_id").to_pylist()
    floors = queries.column("floor").to_pylist()
    out: list[tuple] = []
    for at, matrix in _matrices(queries):
        tree = trees.get(matrix.shape[1])
        for i, query in zip(at.tolist(), matrix if tree else ()):
            floor = float("-inf") if floors[i] is None else floors[i]
            out += [(asked[i], names[i], row, None if name == NO_ID else name, max(-1 << 63, min(score, (1 << 63) - 1)))
                    for score, name, row in tree.search(query, asked[i], k, floor)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                         ["query", "query_id", "row", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, with their rank."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, pivots: int = PIVOTS, shard_rows: int | None = None) -> DataFrame:
    """The ``k`` rows of highest inner product for each row whose id is divisible by ``every``.

    query_id, rank (from 1), vec_id, score.  Components count as floor(scale * x).
    Candidates are all rows but the query's own; equal scores go by id, a null id
    last, then by stored row.  A row that occurs twice is two rows: both ask, and
    each finds the other.  Null vectors, and those with a null or non-finite
    component, take no part; neither do vectors of another length than the
    query's.  Other columns are ignored; an empty table gives no rows.  A score
    beyond a 64-bit integer is returned as the nearest one.
    """
    spark = table.sparkSession
    rows = vectors(table, id_col, vec_col, scale)
    sample = rows.orderBy(F.xxhash64("row")).limit(pivots).select("v").collect()  # at most ``pivots`` vectors
    centers = [list(v) for v in dict.fromkeys(tuple(r["v"]) for r in sample)]
    placed = stage(_dealt(rows, centers), "clusters")
    sizes = {r["cluster"]: r for r in placed.groupBy("cluster").agg(
        F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row per pivot
    total = sum(r["n"] for r in sizes.values())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = shard_rows or min(LARGEST, max(SMALLEST, -(-total // parts)))
    first, shards = [], 0
    for c in sorted(sizes):
        number = -(-sizes[c]["n"] // limit)
        first.append((c, shards, number))
        shards += number
    layout = spark.createDataFrame(first, "cluster int, first long, number long")  # a row per pivot
    homed = placed.join(F.broadcast(layout), "cluster")
    sharded = homed.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("number")))
    tasks = max(1, min(shards, 8 * parts))
    asking = homed.filter(F.pmod("vec_id", F.lit(every)) == 0)
    every_part = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("number") - 1))
    home = asking.select("row", "vec_id", "v", F.lit(None).cast("bigint").alias("floor"), every_part.alias("shard"))
    near = stage(_ranked(_searched(sharded, home, tasks, k), k), "near")
    floors = near.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
    radii = {c: r["radius"] for c, r in sizes.items()}
    others = _reachable(asking.join(floors, "row", "left"), centers, radii)
    sent = others.select("row", "vec_id", "v", "floor", F.explode("clusters").alias("cluster")).join(
        F.broadcast(layout), "cluster").select("row", "vec_id", "v", "floor", every_part.alias("shard"))
    far = _searched(sharded, sent, tasks, k)
    return _ranked(near.drop("rank").unionByName(far), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: DuckDB twin of ``search(embeddings)``.
ORACLE = """
with e as (
  select row_number() over () as r, vec_id,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, q.r as qr, c.vec_id, c.r,
    cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from e q join e c on q.r <> c.r and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0),
k as (
  select *, row_number() over (partition by qr order by score desc, vec_id asc nulls last, r) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from k where rank <= 10
"""
