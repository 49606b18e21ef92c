"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum by node (combined before the shuffle) joined back to the edges; minima of nodes
with very many neighbours are broadcast, so their edges stay where they are.  Partitions first
contract their own edges to stars, so few rounds remain.  Each round's edges are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, trimmed

MAX_ROUNDS = 100


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around the smallest node of each of its components."""
    for b in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        stars = [(find(x), x) for x in list(root)]
        stars = [(r, x) for r, x in stars if r != x]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in stars], pa.int64()), pa.array([x for _, x in stars], pa.int64())], names=["u", "v"])


def _step(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u < v), total of them → edges: neighbours on one side of a node are tied to its smallest neighbour."""
    if large:  # neighbours above the node, tied to the least of all neighbours and itself
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
        out = join_counted(edges.select(F.col("u").alias("x"), F.col("v").alias("y")), least, "x", "n", total).select(F.col("m").alias("u"), F.col("y").alias("v"))
    else:  # neighbours below the node and itself, tied to the least of them
        least = edges.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"), F.count("*").alias("n"))
        below = join_counted(edges.select(F.col("v").alias("x"), F.col("u").alias("y")), least, "x", "n", total).select(F.col("m").alias("u"), F.col("y").alias("v"))
        out = below.unionByName(least.select(F.col("m").alias("u"), F.col("x").alias("v")))
    return out.where("u < v").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long).  (node, root) of every node that has an edge to another; root is its component's smallest."""
    ordered = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    now = durable(ordered.mapInArrow(trimmed(_contract), "u long, v long").distinct())
    sign = _sign(now)
    for _ in range(MAX_ROUNDS):
        if not sign[0]:
            break
        now = durable(_step(durable(_step(now, True, sign[0])), False, sign[0]))
        before, sign = sign, _sign(now)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
