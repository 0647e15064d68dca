"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle

#: Nodes of the trees a task holds at a time.
MOST_NODES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an edge (a, b): label is the smallest node of its component.

    Loops, repeated and reversed edges change nothing; nodes whose edges are all
    loops do not appear. Each step shrinks to one edge a node, kept in the shared folder.
    """
    stars = settle(_forest(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "edges")
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = settle(_forest(small), "stars")
        sign = tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if sign == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = sign


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, with the same components: each task joins its own edges into trees first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= MOST_NODES:
                yield _trees(parent, root)
                parent.clear()
        if parent:
            yield _trees(parent, root)

    return edges.mapInArrow(run, "u bigint, v bigint")


def _trees(parent: dict[int, int], root: Callable[[int], int]) -> pa.RecordBatch:
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])
