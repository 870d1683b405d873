"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and broadcast; every vector is then assigned to a leaf.
A query walks the tree through a priority queue of branches, nearest centre first, and visits
leaves until it has as many as calibration on the sample asked for, and at least as many
vectors as it must return. Leaves are dealt out in chunks of bounded size on both sides, so
that a leaf with a large share of all vectors (one vector many times) is many tasks' work.
Distances are computed on the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that the tree is fitted on; children of a node; sample vectors of a leaf; vectors and queries of a chunk.
SAMPLE, BRANCHES, LEAF, CHUNK = 20_000, 8, 64, 4096
#: Share of the true neighbours that calibration has to find, on how many sample queries.
RECALL, PROBES = 0.97, 200


def usable(vectors: DataFrame, ids: str, column: str) -> DataFrame:
    """id, v: rows whose vector can take part. Those of another size than the most frequent one can't either."""
    rows = vectors.select(F.col(ids).cast("long").alias("id"), F.col(column).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0][0] if sizes else 0))


class Tree:
    """centres[i]: a node's centre; children[i]: its children, none for a leaf, which has leaf number leaf[i]."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [sample.mean(axis=0) if len(sample) else np.zeros(0)], [[]], [-1], 0
        stack = [(0, np.arange(len(sample)))]
        while stack:
            node, rows = stack.pop()
            parts = self.split(sample[rows], branches, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, mine in parts:
                self.children[node].append(len(self.centres))
                stack.append((len(self.centres), rows[mine]))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.inner = {i: np.array([self.centres[c] for c in kids]) for i, kids in enumerate(self.children) if kids}

    @staticmethod
    def split(x: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
        centres = centres[rng.permutation(len(centres))[:k]]
        for _ in range(12):
            near = squared(x, centres).argmin(axis=1)
            moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
            if np.allclose(moved, centres):
                break
            centres = moved
        near = squared(x, centres).argmin(axis=1)
        return [(centres[j], np.flatnonzero(near == j)) for j in range(len(centres)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, the nearest centre at every level."""
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node not in self.inner:
                out[rows] = self.leaf[node]
                continue
            near = squared(x[rows], self.inner[node]).argmin(axis=1)
            stack += [(c, rows[near == j]) for j, c in enumerate(self.children[node])]
        return out

    def search(self, q: np.ndarray, visits: int, sizes: dict[int, int], least: int) -> list[int]:
        """Leaves in the order of their visit."""
        heap, found, held = [(0.0, 0)], [], 0
        while heap and (len(found) < visits or held < least):
            _, node = heapq.heappop(heap)
            if node in self.inner:
                for d, c in zip(squared(q[None], self.inner[node])[0].tolist(), self.children[node]):
                    heapq.heappush(heap, (d, c))
            elif sizes.get(self.leaf[node], 0):
                found.append(self.leaf[node])
                held += sizes[self.leaf[node]]
        return found

    def calibrate(self, sample: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
        """The least number of leaf visits, doubled or raised by half at a time, that finds this share of the sample's own k nearest."""
        leaf = self.assign(sample)
        sizes = dict(zip(*(a.tolist() for a in np.unique(leaf, return_counts=True))))
        rng = np.random.default_rng(11)
        asked = rng.choice(len(sample), min(probes, len(sample)), replace=False)
        order, near = [], []
        for i in asked:
            d = squared(sample[i][None], sample)[0]
            d[i] = np.inf
            near.append(np.argsort(d, kind="stable")[: min(k, len(sample) - 1)])
            order.append({leaf_no: at for at, leaf_no in enumerate(self.search(sample[i], self.leaves, sizes, 0))})
        if not sum(map(len, near)):
            return self.leaves
        at = np.concatenate([[o[int(leaf[j])] for j in n] for o, n in zip(order, near)])
        visits = 1
        while visits < self.leaves and (at < visits).mean() < recall:
            visits += max(1, visits // 2)
        return min(visits, self.leaves)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None], 0)


def stacked(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def assigned(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.record_batch([b.column(0), pa.array(tree.value.assign(stacked(b.column(1)))), b.column(1)], names=["id", "leaf", "v"])

    return run


def visited(tree, visits: int, sizes, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = stacked(b.column(1))
            leaves = [tree.value.search(x, visits, sizes.value, least) for x in q]
            take = np.repeat(np.arange(len(b)), [len(x) for x in leaves])
            if len(take):
                yield pa.record_batch([b.column(0).take(pa.array(take)), pa.array(np.concatenate(leaves), pa.int64()), b.column(1).take(pa.array(take))], names=["query_id", "leaf", "q"])

    return run


def nearest(k: int):
    """Of one chunk of a leaf: each query's k nearest, by distance, then id."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asked, ids, out = queries["query_id"].to_numpy(), rows["id"].to_numpy(), []
        if len(asked) and len(ids):
            x = stacked(rows["v"])
            for query_id, q in zip(asked.tolist(), stacked(queries["q"])):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))  # beyond the range of doubles it is infinite, and comes last
                at = np.flatnonzero(ids != query_id)
                if len(at) > 4 * k:
                    at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
                at = at[np.lexsort((ids[at], d[at]))[:k]]
                out.append((np.full(len(at), query_id), ids[at], d[at]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, ids: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Every row but the query's own is a candidate; all of them come if there are fewer than k.
    Ties go to the smaller id. Rows whose id or vector is null, whose vector is zero, holds a
    null or a non-finite component or has another size than most take no part. Rows that
    repeat an id are a candidate each; a repeated query asks once, with the least of its
    vectors. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, ids, column)
    # the sample is at most `sample` rows, whatever the table's size; every row is indexed below
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow()
    points = stacked(drawn["v"])
    fitted = Tree(points)
    visits = fitted.calibrate(points, k, recall)
    tree = spark.sparkContext.broadcast(fitted)
    kind = rows.schema["v"].dataType.simpleString()
    index = rows.mapInArrow(assigned(tree), f"id long, leaf long, v {kind}")
    counts = {r[0]: r[1] for r in index.groupBy("leaf").count().collect()}  # a row for each leaf: at most the sample's size
    sizes = spark.sparkContext.broadcast(counts)
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = cut(asked.mapInArrow(visited(tree, visits, sizes, k + 1), f"query_id long, leaf long, q {kind}"))
    asking = {r[0]: r[1] for r in queries.groupBy("leaf").count().collect()}
    chunks = spark.createDataFrame([(n, -(-c // chunk), -(-asking.get(n, 0) // chunk)) for n, c in counts.items() if n in asking] or [(-1, 0, 0)], "leaf long, n int, m int")
    index = index.join(F.broadcast(chunks), "leaf").withColumn("c", F.pmod(F.xxhash64("id", "v"), F.col("n"))).withColumn("d", F.explode(F.expr("sequence(0L, m - 1L)")))
    queries = queries.join(F.broadcast(chunks), "leaf").withColumn("d", F.pmod(F.xxhash64("query_id"), F.col("m"))).withColumn("c", F.explode(F.expr("sequence(0L, n - 1L)")))
    key = ["leaf", "c", "d"]
    found = queries.select(*key, "query_id", "q").groupBy(*key).cogroup(index.select(*key, "id", "v").groupBy(*key)).applyInArrow(nearest(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
