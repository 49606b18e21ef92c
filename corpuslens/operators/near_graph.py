"""Near neighbours of points by random-projection trees: the sparse graph on which large tables are clustered."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable

TABLES = 8
LEAF = 1024  # points of a leaf, and most points that meet at once
SAMPLE = 32  # rows for each leaf by which trees are cut, 2^16 rows at most
MAX_DEPTH = 11


class _Forest:
    """Trees of random directions, cut at a sample's medians."""

    def __init__(self, sample: np.ndarray, depth: int, tables: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, []
        for _ in range(tables):
            turns, at = rng.standard_normal((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
            held = {0: sample}
            for node in range(2**depth - 1):
                s = held.pop(node)
                x = s @ turns[node]
                at[node] = np.median(x) if len(x) else 0.0
                held[2 * node + 1], held[2 * node + 2] = s[x < at[node]], s[x >= at[node]]
            self.trees.append((turns, at))

    def leaves(self, x: np.ndarray, table: int) -> np.ndarray:
        turns, at = self.trees[table]
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, turns[node]) >= at[node])
        return node - len(at)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def near_points(points: DataFrame, k: int, *, by: str = "distance", tables: int = TABLES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """points: g, item, vector (array<double>, all of one length; no item twice in a g).  (g, item, near, score): the k nearest points of the
    same g found for each item: of least Euclidean distance, or by "product" of largest inner product (score its negative).

    Points meet in the leaves of several trees, which hold about leaf points each; a leaf that holds more (trees are built from a
    sample and at most MAX_DEPTH deep) is cut along one more direction into parts of leaf points in a row.  Groups and tables of up
    to leaf points meet whole, so there the graph is exact."""
    n = points.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    tables = tables if depth else 1
    unit = by == "product"
    if depth:
        drawn = points.sample(min(1.0, (SAMPLE << depth) / n), seed)
        sample = _matrix(drawn.select(F.col("vector").cast("array<float>").alias("vector")).toArrow().column("vector")).astype(float)
        directions = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if unit else x
        forest = _Forest(directions(sample), depth, tables, seed)
        extra = np.random.default_rng(seed + 1).standard_normal((tables, sample.shape[1]))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = directions(_matrix(b.column("vector")))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(forest.leaves(x, t)), pa.array(x @ extra[t])], names=["g", "item", "vector", "t", "leaf", "along"])

        g, item = (points.schema[c].dataType.simpleString() for c in ("g", "item"))
        dealt = points.select("g", "item", "vector").mapInArrow(deal, f"g {g}, item {item}, vector array<double>, t int, leaf long, along double")
    else:
        dealt = points.select("g", "item", "vector", F.lit(0).alias("t"), F.lit(0).cast("long").alias("leaf"), F.lit(0.0).alias("along"))
    place = F.expr("row_number() over (partition by t, g, leaf order by along, item)") - 1
    dealt = dealt.withColumn("part", F.floor(place / leaf).cast("long"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = _matrix(t.column("vector"))
        m = len(x)
        order = np.argsort(np.asarray(t.column("item").to_pylist(), object), kind="stable")  # ties go to the smaller item
        x, t = x[order], t.take(pa.array(order))
        score = -(x @ x.T) if unit else np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
        np.fill_diagonal(score, np.inf)
        few = min(k, m - 1)
        at = np.argmin(score, axis=1)[:, None] if few == 1 else np.argsort(score, axis=1, kind="stable")[:, :few]
        i = np.repeat(np.arange(m), few)
        best = score[i, at.ravel()]
        best = best if unit else np.sqrt(((x[i] - x[at.ravel()]) ** 2).sum(1))
        return pa.table([t.column("g").take(pa.array(i)), t.column("item").take(pa.array(i)), t.column("item").take(pa.array(at.ravel())), pa.array(best)], names=["g", "item", "near", "score"])

    g, item = (points.schema[c].dataType.simpleString() for c in ("g", "item"))
    met = dealt.groupBy("t", "g", "leaf", "part").applyInArrow(meet, f"g {g}, item {item}, near {item}, score double")
    met = met.groupBy("g", "item", "near").agg(F.min("score").alias("score"))
    ranked = met.withColumn("_r", F.expr("row_number() over (partition by g, item order by score, near)"))
    return durable(ranked.where(F.col("_r") <= k).drop("_r"))
