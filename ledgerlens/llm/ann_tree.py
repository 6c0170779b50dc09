"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted to at most `SAMPLE` vectors (those with the smallest hash), a bounded
sample; every vector is then dealt to a leaf. A query walks the tree with a priority queue of
nodes by the distance to their centres and so meets leaves in the order of promise. It visits
as many as calibration asks for, and more as long as they hold too few vectors for an answer.
Calibration compares the walk with the exact neighbours of a bounded sample of queries and
widens the number of leaves until `RECALL` of those neighbours lie in them.

Equal vectors are indexed once, with their smallest identifiers, and equal queries are searched
once, so a vector that a third of all rows repeat costs one point. Leaves with many points or
many queries are cut into blocks by salts, and each block of queries meets each block of
points. Distances are computed in double precision from the original components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows
with a null identifier, and vectors of another length than the commonest (the shorter of
equally common ones) take no part; rows that repeat an identifier and vector count once; rows
with the query's identifier are its own; ties go to the smaller identifier; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.topk import group_top_k

from .tables import written

SAMPLE = 20_000
BRANCHES = 8
#: Sample vectors of a leaf, and iterations of each k-means.
LEAF_SAMPLE = 80
ITERATIONS = 12
#: Sampled queries that calibrate, and the share of their neighbours that must be found.
CALIBRATION = 256
RECALL = 0.97
#: Points and queries of one block of a leaf.
BLOCK = 8_192


class Tree:
    """Nodes of a k-means tree: centres, children of inner nodes, leaf numbers of the others."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        self.centers, self.children, self.leaf_of = [sample.mean(axis=0)], [[]], [-1]
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, points = todo.pop()
            groups = split(points, rng) if len(points) > LEAF_SAMPLE else []
            if len(groups) < 2:
                self.leaf_of[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for group in groups:
                self.children[node].append(len(self.centers))
                todo.append((len(self.centers), group))
                self.centers.append(group.mean(axis=0))
                self.children.append([])
                self.leaf_of.append(-1)
        self.centers = np.asarray(self.centers)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: always down to the nearest child."""
        leaf = np.empty(len(points), dtype=np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, mine = todo.pop()
            if not len(mine):
                continue
            if self.leaf_of[node] >= 0:
                leaf[mine] = self.leaf_of[node]
                continue
            child = nearest(points[mine], self.centers[self.children[node]])
            todo += [(c, mine[child == i]) for i, c in enumerate(self.children[node])]
        return leaf

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                yield self.leaf_of[node]
                continue
            children = self.children[node]
            gaps = ((self.centers[children] - query) ** 2).sum(axis=1)
            for gap, child in zip(gaps.tolist(), children, strict=True):
                heapq.heappush(queue, (gap, child))


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers ** 2).sum(axis=1) - 2 * points @ centers.T, axis=1)


def split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The non-empty groups of one k-means."""
    centers = points[rng.choice(len(points), min(BRANCHES, len(points)), replace=False)]
    for _ in range(ITERATIONS):
        group = nearest(points, centers)
        centers = np.asarray([points[group == i].mean(axis=0) if (group == i).any() else centers[i]
                              for i in range(len(centers))])
    group = nearest(points, centers)
    return [points[group == i] for i in range(len(centers)) if (group == i).any()]


def usable(vector: Column) -> Column:
    return (vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray,
                  least_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of each query's k nearest points of a block, ties to the smaller
    identifier; `least_ids` are the points' smallest identifiers."""
    out = []
    rank = np.argsort(least_ids, kind="stable")  # in this order, a stable sort keeps ties right
    points, point_ids = points[rank], point_ids[rank]
    rows = max(1, (1 << 22) // max(1, points.size))
    for a in range(0, len(queries), rows):
        gap = distances(queries[a:a + rows], points)
        best = np.argsort(gap, axis=1, kind="stable")[:, :k]
        out.append((np.repeat(query_ids[a:a + rows], best.shape[1]), point_ids[best.ravel()],
                    np.take_along_axis(gap, best, axis=1).ravel()))
    return out


def _points(table: DataFrame, id_col: str, vector_col: str, is_query: str, k: int) -> DataFrame | None:
    """One row a distinct vector: pid, vector, ids (its k + 1 smallest identifiers), is_query;
    None if no vector is usable."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.where(F.col("id").isNotNull()).where(usable(F.col("vector")))
    common = (rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
              .orderBy(F.desc("rows"), "n").first())
    if common is None:
        return None
    rows = rows.where(F.size("vector") == common.n).groupBy("vector", "id").agg(F.expr(is_query).alias("is_query"))
    queries = rows.groupBy("vector").agg(F.max("is_query").alias("is_query"))
    first = group_top_k(rows.select("vector", "id"), ["vector"], [F.col("id")], k + 1)
    ids = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = ids.join(queries, "vector").select("vector", "ids", "is_query")
    return written(points.withColumn("pid", F.monotonically_increasing_id()), "points")  # so pid stays


def _exact(points: DataFrame, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact k nearest points of a bounded number of queries: (query, point) pairs."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = matrix(batch.column("vector")), batch.column("pid").to_numpy()
            for a in range(0, batch.num_rows, 1024):
                for q, p, d in best_of_block(queries, np.arange(len(queries)), vectors[a:a + 1024],
                                             ids[a:a + 1024], ids[a:a + 1024], k):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(p), pa.array(d)], names=["q", "p", "d"])

    found = points.select("pid", "vector").mapInArrow(block, "q long, p long, d double")
    best = group_top_k(found, ["q"], [F.col("d"), F.col("p")], k).toArrow()  # CALIBRATION * k rows
    return best.column("q").to_numpy(), best.column("p").to_numpy()


def _calibrated_visits(tree: Tree, indexed: DataFrame, k: int, recall: float) -> int:
    """The least number of leaves that hold `recall` of the sampled queries' true neighbours."""
    sample = (indexed.where("is_query").orderBy(F.xxhash64("pid", F.lit(7)), "pid").limit(CALIBRATION)
              .select("vector").toArrow())
    if not len(sample):
        return 1
    queries = matrix(sample.column("vector").combine_chunks())
    q, p = _exact(indexed, queries, k)
    wanted = indexed.sparkSession.createDataFrame(pa.table({"pid": np.unique(p)}))  # CALIBRATION * k rows
    leaf_of = {r.pid: r.leaf for r in indexed.select("pid", "leaf").join(F.broadcast(wanted), "pid").collect()}
    place = [{leaf: i for i, leaf in enumerate(tree.walk(x))} for x in queries]
    depth = np.asarray([place[a][leaf_of[b]] for a, b in zip(q.tolist(), p.tolist(), strict=True)])
    visits = 1
    while (depth < visits).mean() < recall:
        visits += 1
    return visits


def nearest_neighbours(table: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """Each query's k nearest other rows: query_id, rank (from 1), <id_col>, score (Euclidean
    distance). `is_query` is a SQL condition on `id`, true for the rows that are queries."""
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    points = _points(table, id_col, vector_col, is_query, k)
    if points is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    sample = points.orderBy(F.xxhash64("pid", F.lit(5)), "pid").limit(SAMPLE).select("vector").toArrow()
    tree = Tree(matrix(sample.column("vector").combine_chunks()))
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE / LEAF_SAMPLE nodes or so

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    schema = T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())])
    indexed = written(points.mapInArrow(deal, schema), "index")
    visits = _calibrated_visits(tree, indexed, k + 1, recall)
    sizes = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, counts = [], []
            for query in matrix(batch.column("vector")):
                found = before = 0
                for n, leaf in enumerate(shared.value.walk(query)):
                    if n >= visits and found > k:
                        break
                    if leaf in sizes:
                        leaves.append(leaf)
                        found += sizes[leaf]
                        before += 1
                counts.append(before)
            at = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid").take(pa.array(at)), pa.array(leaves, pa.int32())], names=["qid", "leaf"])

    walked = written(indexed.where("is_query").select("pid", "vector").mapInArrow(walks, "qid long, leaf int"), "walks")
    # blocks of a leaf: one row a leaf, so it may be broadcast
    blocks = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("p_blocks")).join(
        walked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks")), "leaf")

    def salt(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (walked.join(indexed.select(F.col("pid").alias("qid"), F.col("vector").alias("query")), "qid").join(F.broadcast(blocks), "leaf")
            .withColumn("qb", salt("qid", "q_blocks")).withColumn("pb", every("p_blocks"))
            .select("leaf", "qb", "pb", "qid", "query"))
    right = (indexed.join(F.broadcast(blocks), "leaf").withColumn("pb", salt("pid", "p_blocks"))
             .withColumn("qb", every("q_blocks"))
             .select("leaf", "qb", "pb", "pid", "vector", F.element_at("ids", 1).alias("least")))

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not len(queries) or not len(found):
            return pa.table({"qid": pa.array([], pa.int64()), "pid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        parts = best_of_block(matrix(queries.column("query").combine_chunks()), queries.column("qid").to_numpy(),
                              matrix(found.column("vector").combine_chunks()), found.column("pid").to_numpy(),
                              found.column("least").to_numpy(), k + 1)
        return pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("qid", "pid", "score"))})

    by = ["leaf", "qb", "pb"]
    left = left.withColumnsRenamed({c: f"q_{c}" for c in by})
    hits = left.groupBy(*[f"q_{c}" for c in by]).cogroup(right.groupBy(*by)).applyInArrow(search, "qid long, pid long, score double")
    best = (hits.join(indexed.select("pid", "ids"), "pid").select("qid", "score", F.explode("ids").alias("id")))
    order = Window.partitionBy("qid").orderBy("score", "id")  # some k * visits rows a query
    best = (best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("qid")
            .agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("best")))
    # every query row takes its vector's answer, but for itself
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where(is_query)
    rows = rows.where(usable(F.col("vector"))).distinct()
    answers = indexed.where("is_query").select("pid", "vector").join(best, F.col("pid") == F.col("qid")).select("vector", "best")
    mine = rows.join(answers, "vector").select(F.col("id").alias("query_id"), F.posexplode(
        F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)).alias("place", "near"))
    return mine.select("query_id", (F.col("place") + 1).alias("rank"), F.col("near.id").alias(id_col), F.col("near.score").alias("score"))
