"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, lean


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            self.up.setdefault(x, x)
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's edges by stars around the least node that they connect."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(x, y)
    pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
    if pairs:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Gives node, component (the least node reachable) for each node that has an edge to another one. Edges with null ends and loops are left out."""
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(lean(local_stars), "u long, v long").distinct()
    e, seen = cut(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        old, e = e, cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        forget(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        seen = now
