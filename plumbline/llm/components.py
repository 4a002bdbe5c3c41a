"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected components in
MapReduce and beyond", 2014), after each task has contracted the edges that it holds by union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

EDGES = "u long, v long"


class Forest:
    """Union-find over the ids met so far; the root of a set is its smallest id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))


#: Ids a task may hold while it contracts; beyond that it sends on what it has and starts anew.
HELD = 1_000_000


def _contract(batches):
    forest = Forest()

    def stars():
        pairs = [(r, x) for x in forest.parent if (r := forest.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(u, v)
        if len(forest.parent) > HELD:
            yield stars()
            forest = Forest()
    yield stars()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node moves to the node's least neighbour; small: the lesser ones and the node do."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")
    else:
        near = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("m").alias("u"), "v").unionAll(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return moved.filter("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that an edge (u, v) names; root is the smallest id of its component, itself included.

    Rows with a null end and loops count as no edge; repeated edges count once; no edges give no rows. Each round writes
    its stars to the shared folder, so a lost executor costs one round at most; rounds grow with the logarithm of the
    longest chain."""
    clean = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v")
    now, was = stored(clean.mapInArrow(_contract, EDGES)), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"), F.sum(F.col("u").cast("decimal(20,0)"))).first()
        if seen == was or seen[0] == 0:
            break
        was = seen
        after = stored(_stars(_stars(now, True), False))
        forget(now)
        now = after
    return now.select(F.col("v").alias("id"), F.col("u").alias("root")).unionAll(now.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
