"""Clusters by density, of unequal density, at any number of points.

Core distances and mutual reachability follow hierarchical density clustering: an edge of the near graph weighs as much as the larger of
its length and its ends' core distances.  The hierarchy is read off at LEVELS weights in geometric steps: at each the components
of the edges up to it; components under min_cluster points are noise there.  A cluster lives from the level at which it parts from
another down to those at which it parts itself or ends, its stability is the points times the change of 1 / weight over its levels,
and of a cluster and those inside it the more stable are taken (the excess of mass).  The root, which holds all, is no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, durable, written
from .near_graph import LEAF, TABLES, near_points

LEVELS = 16
NEAR = 12


def principal_axes(df: DataFrame, item: str, vector: str, axes: int) -> DataFrame:
    """item, vector: unit vectors on their first principal axes."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = df.select(F.col(item).alias("item"), array_to_vector(F.transform(vector, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))).alias("v"))
    return PCA(k=axes, inputCol="v", outputCol="p").fit(unit).transform(unit).select("item", vector_to_array("p").alias("vector"))


def _spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Edges of a forest of least weight over n nodes: every part takes its lightest edge out until none is left."""
    part, kept, open_ = np.arange(n), [], np.arange(len(i))
    rank = np.empty(len(i), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(i))
    while True:
        a, b = part[i[open_]], part[j[open_]]
        apart = a != b
        open_, a, b = open_[apart], a[apart], b[apart]
        if not len(open_):
            return np.unique(np.concatenate(kept)) if kept else open_
        least = np.full(n, len(i), np.int64)
        np.minimum.at(least, a, rank[open_])
        np.minimum.at(least, b, rank[open_])
        chosen = np.isin(rank[open_], least[least < len(i)])
        kept.append(open_[chosen])
        up = np.arange(n)
        for x, y in zip(a[chosen].tolist(), b[chosen].tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up != up[up]).any():
            up = up[up]
        part = up[part]


def sparser(edges: DataFrame) -> DataFrame:
    """edges: u, v, w.  Fewer edges that connect the same at every weight: of each partition a forest of least weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64())], names=["u", "v", "w"])])
        nodes, at = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
        kept = _spanning(at[: len(t)], at[len(t) :], t.column("w").to_numpy(), len(nodes))
        yield from t.take(pa.array(kept)).combine_chunks().to_batches()

    return edges.mapInArrow(run, "u long, v long, w double")


def nested_components(edges: DataFrame, weights: list[float]) -> DataFrame:
    """edges: u, v, w.  (level, node, root) of the components of the edges up to each of the rising weights.  A level adds its own edges to
    the components of the level before, so an edge is used once."""
    now, out = None, None
    for level, most in enumerate(weights):
        own = edges.where(F.col("w") <= most)
        if level:
            own = own.where(F.col("w") > weights[level - 1])
            for end in ("u", "v"):
                own = own.join(now.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        tops = components(own.select("u", "v"))
        if level:
            raised = now.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            now = written(raised.unionByName(tops.join(now.select("node"), "node", "left_anti")))
        else:
            now = tops
        here = now.select(F.lit(level).alias("level"), "node", "root")
        out = here if out is None else out.unionByName(here)
    return out


def density_clusters(df: DataFrame, item: str, vector: str, *, axes: int = 15, min_samples: int = 3, min_cluster: int = 5, near: int = NEAR, levels: int = LEVELS, tables: int = TABLES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """item (a long), cluster: the smallest item of the cluster, or -1 for noise.  Vectors (of one length) are brought to their first
    axes principal axes; with axes 0 they are taken as they are.  Equal vectors are one point with their number.  Items with a null
    vector are noise."""
    known = df.where(F.col(vector).isNotNull())
    placed = principal_axes(known, item, vector, axes) if axes else known.select(F.col(item).alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    placed = durable(placed.withColumn("p", F.xxhash64("vector")))
    points = durable(placed.groupBy("p").agg(F.min("item").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    graph = near_points(points.select(F.lit(0).alias("g"), F.col("p").alias("item"), "vector"), max(near, min_samples), tables=tables, leaf=leaf, seed=seed)
    n = points.select("p", "n")
    seen = graph.join(n.withColumnRenamed("p", "near"), "near").withColumn("upto", F.expr("sum(n) over (partition by item order by score, near)"))
    own = seen.join(n.select(F.col("p").alias("item"), F.col("n").alias("mine")), "item").groupBy("item").agg(F.min(F.when(F.col("upto") + F.col("mine") - 1 >= min_samples, F.col("score"))).alias("at"), F.max("score").alias("far"), F.first("mine").alias("mine"))
    core = durable(own.select("item", F.when(F.col("mine") > min_samples, 0.0).otherwise(F.coalesce("at", "far")).alias("core")))
    edges = graph.select(F.least("item", "near").alias("u"), F.greatest("item", "near").alias("v"), "score").distinct()
    edges = edges.join(core.toDF("u", "cu"), "u").join(core.toDF("v", "cv"), "v").select("u", "v", F.greatest("score", "cu", "cv").alias("w"))
    edges = durable(sparser(edges.repartition(F.pmod(F.least("u", "v"), F.lit(1 << 20)))))
    low, high = edges.agg(F.percentile_approx("w", 0.02, 1000), F.max("w")).first()
    none = df.select(item, F.lit(-1).cast("long").alias("cluster"))
    if not high:
        return none
    low = max(low, high * 1e-6)
    weights = [float(low * (high / low) ** (k / (levels - 1))) for k in range(levels)] if high > low else [float(high)]
    weights[-1] = float(high)
    labels = nested_components(edges, weights)
    alone = n.where(F.col("n") >= min_cluster).select(F.explode(F.lit(list(range(levels))).cast("array<int>")).alias("level"), F.col("p").alias("node"))
    alone = alone.join(labels, ["level", "node"], "left_anti").withColumn("root", F.col("node"))  # copies that no edge reaches yet
    labels = durable(labels.unionByName(alone).join(n.withColumnRenamed("p", "node"), "node"))
    sizes = labels.groupBy("level", "root").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster)
    parent = labels.select((F.col("level") - 1).alias("level"), F.col("node").alias("root"), F.col("root").alias("parent"))
    tree = durable(sizes.join(parent, ["level", "root"], "left"))
    chosen = _most_stable(tree, weights)
    member = labels.join(chosen, ["level", "root"]).select(F.col("node").alias("p"), "level", "root")
    named = durable(placed.select("item", "p").join(member, "p", "left"))
    name = named.where("root is not null").groupBy("level", "root").agg(F.min("item").alias("cluster"))
    out = named.join(name, ["level", "root"], "left").select("item", "cluster")
    return none.select(item).join(out.withColumnRenamed("item", item), item, "left").select(item, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _most_stable(tree: DataFrame, weights: list[float]) -> DataFrame:
    """(level, root) of the clusters taken.  tree: level, root, size, parent (root of the component of the next level that holds it)."""
    spark, levels = tree.sparkSession, len(weights)
    spread = [1 / w - (1 / weights[k + 1] if k + 1 < levels else 0.0) for k, w in enumerate(weights)]
    kept, below = [], None
    for level in range(levels):
        here = tree.where(F.col("level") == level).withColumn("mass", F.col("size") * F.lit(float(spread[level])))
        if below is None:
            here = here.select("root", "parent", F.lit(0).cast("long").alias("parts"), F.col("mass").alias("own"), F.lit(0.0).alias("inner"))
        else:
            best = below.where("parent is not null").groupBy(F.col("parent").alias("root")).agg(F.count("*").alias("parts"), F.max("own").alias("one"), F.max("inner").alias("in_one"), F.sum(F.greatest("own", "inner")).alias("taken"))
            joined = here.join(best, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
            own = F.col("mass") + F.when(F.col("parts") == 1, F.col("one")).otherwise(0.0)
            inner = F.when(F.col("parts") == 1, F.col("in_one")).when(F.col("parts") > 1, F.col("taken")).otherwise(0.0)
            here = joined.select("root", "parent", "parts", own.alias("own"), inner.alias("inner"))
        below = durable(here)
        kept.append(below)
    chosen = spark.createDataFrame([], "level int, root long")
    only = kept[-1].limit(2).count() == 1
    # open: not inside a cluster that is taken; top: parted from others at the level above
    now = kept[-1].select("root", "parts", "own", "inner", F.lit(not only).alias("top"))
    for level in reversed(range(levels)):
        take = F.col("top") & (F.col("own") >= F.col("inner"))
        chosen = chosen.unionByName(now.where(take).select(F.lit(level).alias("level"), "root"))
        if level:
            above = now.where(~take).select(F.col("root").alias("parent"), (F.col("parts") > 1).alias("top"))
            now = written(kept[level - 1].join(above, "parent").select("root", "parts", "own", "inner", "top"))
    return durable(chosen)
