"""Average linkage under cosine distance of any number of rows, in rounds of reciprocal nearest neighbours.

The mean cosine distance between the members of two clusters is one less the inner product of the means of their unit vectors, so a
cluster is its mean and its size, and a merge is a weighted mean.  Two clusters that are each other's nearest merge in the greedy
order too, whenever it is their turn (average linkage never brings clusters closer by merging), so a round merges all such pairs at
once.  Nearest neighbours come from the near graph, which is exact for groups of up to a leaf of points and found in random trees
above.  A group that is down to a bounded number of clusters is finished in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, durable, written
from .near_graph import LEAF, TABLES, near_points
from .ordinals import with_ordinal

FINISH = 4000  # clusters of a group that one task finishes


def chain(means: np.ndarray, sizes: np.ndarray, floor: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height), i < j, of clusters with these means, sizes and heights, by chains of nearest neighbours; every merge comes after
    those of its parts, and i names what is merged."""
    means, sizes, floor = means.copy(), sizes.astype(float), floor.copy()
    alive, out, way = np.ones(len(means), bool), [], []
    for _ in range(len(means) - 1):
        if not way:
            way.append(int(np.argmax(alive)))
        while True:
            top = way[-1]
            near = np.where(alive, means @ means[top], -np.inf)
            near[top] = -np.inf
            to = int(np.argmax(near))
            if len(way) > 1 and near[way[-2]] >= near[to]:
                to = way[-2]
                break
            way.append(to)
        del way[-2:]
        i, j = min(top, to), max(top, to)
        floor[i] = max(1 - near[to], floor[i], floor[j])
        means[i] = (sizes[i] * means[i] + sizes[j] * means[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        alive[j] = False
        out.append((i, j, float(floor[i])))
    return out


def linkage(df: DataFrame, group: str, item: str, vector: str, *, finish: int = FINISH, leaf: int = LEAF, tables: int = TABLES, seed: int = 42) -> DataFrame:
    """group, a, b, height, step: the merges of every group.  The cluster whose smallest item is b joins the one whose smallest item is a
    (a < b) at a mean distance of height, which never lessens towards the root; step orders a merge after those of its parts.  A group
    of n vectors has n - 1 merges.  Items are unique in their group; groups and items are not null; rows with a null vector take no
    part; equal vectors merge first, at 0; a zero vector is at 1 from all others.

    A round costs a pass of near_points over the clusters left in groups of more than finish; how many rounds depends on how many
    clusters are each other's nearest, commonly a third."""
    g, name = (df.schema[c].dataType.simpleString() for c in (group, item))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    unit = durable(rows.select("g", "item", F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("vector")))
    first = unit.groupBy("g", "vector").agg(F.min("item").alias("item"), F.count("*").alias("size"))
    now = written(first.select("g", "item", "vector", "size", F.lit(0.0).alias("height")))
    copies = unit.join(now.select("g", "vector", F.col("item").alias("a")), ["g", "vector"])
    merges = copies.where("item <> a").select("g", "a", F.col("item").alias("b"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("step"))
    step = 0
    while True:
        # at most one group in finish clusters: a group and a number each
        large = durable(now.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > max(finish, 1)).select("g"))
        if large.isEmpty():
            break
        step += 1
        open_ = now.join(F.broadcast(large), "g", "left_semi")
        best = near_points(open_.select("g", "item", "vector"), 1, by="product", tables=tables, leaf=leaf, seed=seed + step)
        back = best.select("g", F.col("item").alias("near"), F.col("near").alias("item"))
        pairs = best.where("item < near").join(back, ["g", "item", "near"])
        one, two = (now.select("g", F.col("item").alias(key), F.struct("vector", "size", "height").alias(side)) for key, side in (("item", "x"), ("near", "y")))
        met = written(pairs.join(one, ["g", "item"]).join(two, ["g", "near"]).withColumn("at", F.greatest(1 + F.col("score"), "x.height", "y.height")))
        size = F.col("x.size") + F.col("y.size")
        mean = F.zip_with("x.vector", "y.vector", lambda p, q: (p * F.col("x.size") + q * F.col("y.size")) / size)
        merged = met.select("g", "item", mean.alias("vector"), size.alias("size"), F.col("at").alias("height"))
        gone = met.select("g", F.explode(F.array("item", "near")).alias("item"))
        now = written(now.join(gone, ["g", "item"], "left_anti").unionByName(merged))
        merges = merges.unionByName(met.select("g", F.col("item").alias("a"), F.col("near").alias("b"), F.col("at").alias("height"), F.lit(step).cast("long").alias("step")))

    def last(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("item").reset_index(drop=True)
        found = chain(np.stack(p["vector"].to_numpy()), p["size"].to_numpy(), p["height"].to_numpy())
        i, j, at = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        names = p["item"]
        return pd.DataFrame({"g": p["g"].take(i).array, "a": names.take(i).array, "b": names.take(j).array, "height": np.array(at, float), "step": step + 1 + np.arange(len(i), dtype=np.int64)})

    rest = now.groupBy("g").applyInPandas(last, f"g {g}, a {name}, b {name}, height double, step long")
    return durable(merges.unionByName(rest)).withColumnRenamed("g", group)


def cut(df: DataFrame, merges: DataFrame, group: str, item: str, *, k: int | None = None, height: float | None = None, finish: int = FINISH) -> DataFrame:
    """group, item, cluster (its smallest item): every row of df under merges of up to height, or under all but the last k - 1 merges of its
    group.  Rows that no merge names stand alone and count towards no k."""
    m = merges.withColumnRenamed(group, "g")
    if (k is None) == (height is None):
        raise ValueError("give k or height")
    if k is None:
        taken = m.where(F.col("height") <= height)
    else:
        m = with_ordinal(m, ["g", "height", "step", "a"], "place")
        ends = durable(m.groupBy("g").agg(F.max("place").alias("end"), F.count("*").alias("n")))
        # the groups that may be hot, of which there is at most one in finish merges, need no shuffle
        held = m.join(F.broadcast(ends.where(F.col("n") > finish)), "g").unionByName(m.join(ends.where(F.col("n") <= finish), "g"))
        taken = held.where(F.col("end") - F.col("place") >= k - 1)
    roots = components(taken.select("g", F.col("a").alias("u"), F.col("b").alias("v")), by=["g"])
    out = df.select(F.col(group).alias("g"), F.col(item).alias("node")).join(roots, ["g", "node"], "left")
    return out.select(F.col("g").alias(group), F.col("node").alias(item), F.coalesce("root", "node").alias("cluster"))
