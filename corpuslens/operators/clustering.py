"""Small combinatorial solvers behind a group seam, and distributed stand-ins for corpus-level clustering."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import cosine
from corpuslens.operators.agreement import cluster_jaccard, perturbation_stability
from corpuslens.operators.graph import durable
from corpuslens.operators.linkage import cut, linkage

MAX_AGGLOMERATIVE = 4000
MAX_LEVELS = 4


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost of rows to columns, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    price, pull = np.zeros(m), np.zeros(n)
    owner = np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, base, rows, order = start, -1, 0.0, [start], []
        while True:
            reach = base + cost[row] - pull[row] - price
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], column
            open_ = np.where(done, np.inf, dist)
            column = int(np.argmin(open_))
            base, done[column] = dist[column], True
            order.append(column)
            if owner[column] < 0:
                break
            row = int(owner[column])
            rows.append(row)
        pull[start] += base
        for c in order[:-1]:
            price[c] -= base - dist[c]
            pull[owner[c]] += base - dist[c]
        while column >= 0:
            back = via[column]
            owner[column] = owner[back] if back >= 0 else start
            column = back
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def match_clusters(runs: DataFrame) -> DataFrame:
    """For every two runs the best one-to-one matching of clusters by Jaccard; one group is a table of a few hundred labels."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(p.label_a.unique()), sorted(p.label_b.unique())
        table = np.zeros((len(a), len(b)))
        table[[a.index(x) for x in p.label_a], [b.index(x) for x in p.label_b]] = p.jaccard
        rows = [(p.run_a.iloc[0], p.run_b.iloc[0], a[i], b[j], table[i, j]) for i, j in hungarian(-table)]
        return pd.DataFrame(rows, columns=["run_a", "run_b", "label_a", "label_b", "jaccard"])

    j = cluster_jaccard(runs)
    return j.groupBy("run_a", "run_b").applyInPandas(solve, j.select("run_a", "run_b", "label_a", "label_b", "jaccard").schema)


def taxonomy_stability(runs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every matched pair of clusters with jaccard and the cosine of its labels' vectors; pairs, mean and std of the cosines).
    vectors: run, label, vector."""
    a = vectors.select(F.col("run").alias("run_a"), F.col("label").alias("label_a"), F.col("vector").alias("va"))
    b = vectors.select(F.col("run").alias("run_b"), F.col("label").alias("label_b"), F.col("vector").alias("vb"))
    matched = match_clusters(runs).join(a, ["run_a", "label_a"]).join(b, ["run_b", "label_b"])
    matched = matched.select("run_a", "run_b", "label_a", "label_b", "jaccard", cosine("va", "vb").alias("cosine"))
    return matched, matched.agg(F.count("*").alias("pairs"), F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"))


def transfer(similarity: DataFrame, threshold: float = 0.70) -> DataFrame:
    """similarity: a, b, similarity of two taxonomies' clusters.  (a, b, similarity, status): matched pairs reaching the
    threshold are transferred; below it both sides count as unmatched (untransferred, novel)."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        table = p.pivot_table(index="a", columns="b", values="similarity", fill_value=0.0)
        rows, used = [], set()
        got = dict(hungarian(-table.to_numpy()))
        for i, a in enumerate(table.index):
            j = got.get(i)
            s = float(table.iloc[i, j]) if j is not None else None
            if s is not None and s >= threshold:
                rows.append((a, table.columns[j], s, "transferred"))
                used.add(j)
            else:
                rows.append((a, None, s, "untransferred"))
        rows += [(None, b, None, "novel") for j, b in enumerate(table.columns) if j not in used]
        return pd.DataFrame(rows, columns=["a", "b", "similarity", "status"]).astype({"a": "Int64", "b": "Int64"})

    return similarity.groupBy().applyInPandas(solve, "a long, b long, similarity double, status string")


def transfer_rate(transferred: DataFrame) -> DataFrame:
    """transferred, clusters, rate: how many of the first taxonomy's clusters (rows of transfer) came over; rate 0 of none."""
    n, came = F.count("a"), F.count_if(F.col("status") == "transferred")
    return transferred.agg(came.alias("transferred"), n.alias("clusters"), F.coalesce(came / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("rate"))


def agglomerative(vectors: np.ndarray, k: int) -> np.ndarray:
    """Average linkage under cosine distance down to k clusters; labels in order of first member."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, np.inf)
    size, label = np.ones(len(unit)), np.arange(len(unit))
    for _ in range(max(len(unit) - k, 0)):
        i, j = np.unravel_index(np.argmin(dist), dist.shape)
        i, j = min(i, j), max(i, j)
        dist[i] = dist[:, i] = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        dist[i, i] = np.inf
        dist[j] = dist[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def cluster_groups(df: DataFrame, group: str, item: str, vector: str, k: int, most: int = MAX_AGGLOMERATIVE) -> DataFrame:
    """Average-linkage clusters of every group, numbered in order of first member.  Groups of up to most rows are clustered in one task each,
    larger ones in rounds (see linkage); rows with a null vector are left out."""
    rows = df.where(F.col(vector).isNotNull()).select(group, item, vector)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(item)
        return pd.DataFrame({group: p[group], item: p[item], "cluster": agglomerative(np.stack(p[vector].to_numpy()).astype(float), k)})

    kinds = f"{group} {df.schema[group].dataType.simpleString()}, {item} {df.schema[item].dataType.simpleString()}, cluster long"
    # at most one group in `most` rows
    large = durable(rows.groupBy(group).count().where(F.col("count") > most).select(group))
    if large.isEmpty():
        return rows.groupBy(group).applyInPandas(solve, kinds)
    small = rows.join(F.broadcast(large), group, "left_anti").groupBy(group).applyInPandas(solve, kinds)
    rest = rows.join(F.broadcast(large), group, "left_semi")
    found = durable(cut(rest, linkage(rest, group, item, vector, finish=most), group, item, k=k, finish=most))
    names = found.groupBy(group, "cluster").count().drop("count")  # k a group
    names = names.withColumn("n", F.expr(f"row_number() over (partition by `{group}` order by cluster) - 1").cast("long"))
    numbered = found.join(F.broadcast(names), [group, "cluster"]).select(group, item, F.col("n").alias("cluster"))
    return small.unionByName(numbered)


Solver = Callable[[np.ndarray], "np.ndarray | None"]


def halving(solve: Solver, vectors: np.ndarray, least: int = 5) -> np.ndarray:
    """Labels that solve gives; where it gives none (or raises), those of either half, down to least rows, which then stand alone."""
    try:
        labels = solve(vectors)
    except Exception:  # noqa: BLE001  a solver behind the seam may raise anything
        labels = None
    if labels is not None and len(labels) == len(vectors):
        return np.unique(np.asarray(labels), return_inverse=True)[1]
    if len(vectors) <= least:
        return np.arange(len(vectors))
    mid = len(vectors) // 2
    left, right = halving(solve, vectors[:mid], least), halving(solve, vectors[mid:], least)
    return np.concatenate([left, right + left.max(initial=-1) + 1])


def by_average_linkage(share: float = 0.25) -> Solver:
    """A solver: average linkage down to a share of the rows, two at least."""
    return lambda v: agglomerative(v, max(2, int(len(v) * share)))


def reduce_clusters(df: DataFrame, item: str, vector: str, *, chunk: int = 80, most: int = 40, levels: int = MAX_LEVELS, solve: Solver | None = None) -> DataFrame:
    """item, cluster (the smallest item of it).  Items are dealt into chunks of bounded size by hash, a solver clusters each chunk
    (halved where it fails), and clusters, as items with the mean of their members' vectors, are dealt and clustered again, until at
    most `most` are left or after `levels` levels.  Every item stays in a cluster: what a level does not merge is carried over."""
    solve = solve or by_average_linkage()
    kind = df.schema[item].dataType.simpleString()
    assigned = df.select(F.col(item).alias("item"), F.col(item).alias("cluster"))
    now = df.select(F.col(item).alias("cluster"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), F.lit(1).cast("long").alias("size"))

    def cluster(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("cluster").reset_index(drop=True)
        v, n = np.stack(p["vector"].to_numpy()), p["size"].to_numpy()
        labels = halving(solve, v)
        rows = []
        for k in range(labels.max(initial=-1) + 1):
            at = np.flatnonzero(labels == k)
            mean = np.average(v[at], axis=0, weights=n[at])
            rows += [(p["cluster"][i], p["cluster"][at[0]], mean.tolist(), int(n[at].sum()), i == at[0]) for i in at]
        return pd.DataFrame(rows, columns=["old", "cluster", "vector", "size", "lead"])

    for level in range(levels):
        left = now.count()
        if left <= most:
            break
        chunks = max(1, -(-left // chunk))
        dealt = now.withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), "cluster"), F.lit(chunks)))
        merged = durable(dealt.groupBy("chunk").applyInPandas(cluster, f"old {kind}, cluster {kind}, vector array<double>, size long, lead boolean"))
        assigned = assigned.withColumnRenamed("cluster", "old").join(merged.select("old", "cluster"), "old").select("item", "cluster")
        now = merged.where("lead").select("cluster", "vector", "size")
    return assigned.select(F.col("item").alias(item), "cluster")


def cluster_tables(document: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters: cluster_name, singleton, articles, signature (country → articles); members: cluster_name, item) of a cluster document
    (emergent_clusters, singletons); articles: index, item, country.  A singleton is a cluster of one; indices without an article go;
    an article named twice in a cluster counts once."""
    grouped = document.select(F.explode("emergent_clusters").alias("c")).select(F.col("c.cluster_name").alias("cluster_name"), F.lit(False).alias("singleton"), F.explode("c.member_indices").alias("index"))
    alone = document.select(F.explode("singletons").alias("s")).select(F.concat(F.lit("Singleton "), F.col("s.index").cast("string")).alias("cluster_name"), F.lit(True).alias("singleton"), F.col("s.index").alias("index"))
    members = grouped.unionByName(alone).distinct().join(articles, "index")
    n = members.groupBy("cluster_name", "singleton", F.coalesce("country", F.lit("unknown")).alias("country")).agg(F.count("*").alias("n"))
    clusters = n.groupBy("cluster_name", "singleton").agg(F.sum("n").alias("articles"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "n")))).alias("signature"))
    return clusters, members.select("cluster_name", "item")


def noisy(df: DataFrame, item: str, vector: str, run: int, sigma: float, seed: int = 42) -> DataFrame:
    """df with Gaussian noise on every coordinate, drawn from hashes of item, run and place (Box-Muller), so the same on any
    partitioning."""
    u = lambda k, salt: (F.pmod(F.xxhash64(F.lit(seed + salt), F.col(item), F.lit(run), k), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = lambda k: sigma * F.sqrt(-2 * F.ln(u(k, 0))) * F.cos(2 * np.pi * u(k, 1))
    return df.withColumn(vector, F.transform(vector, lambda x, k: x + noise(k)))


def noisy_stability(df: DataFrame, k: int, n_runs: int = 5, sigma: float = 0.01, cluster: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42) -> DataFrame:
    """cluster, n, stability: df (item, vector) is clustered as it is and n_runs times with noise; see perturbation_stability.
    cluster: DataFrame (item, vector) → (item, label); cosine k-means by default."""
    cluster = cluster or (lambda d: scalable_clusters(d, "vector", k, seed).select("item", F.col("cluster").alias("label")))
    runs = None
    for r in range(n_runs):
        one = durable(cluster(noisy(df, "item", "vector", r, sigma, seed)).withColumn("run", F.lit(r)))
        runs = one if runs is None else runs.unionByName(one)
    return perturbation_stability(durable(cluster(df)), runs, n_runs)


def scalable_clusters(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Cosine k-means over all rows: what corpus-level clustering uses where average linkage cannot reach."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(data)
    return model.transform(data).drop("features").withColumnRenamed("prediction", "cluster")


# The distribution of Poisson(1), up to where a 52-bit number is above all of it.
POISSON_ONE = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(18)]
MANY = 64  # equal values drawn one by one up to here


def bootstrap_ci(df: DataFrame, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, n and 2.5 / 97.5 percentiles of resampled means.  A row enters each resample a Poisson(1) number of times, so c equal values
    enter Poisson(c) times: drawn one by one from a hash of value, place and resample, above MANY from the normal distribution with its
    correction for skewness.  So draws do not depend on partitions or on rows' other columns.  Values are counted before they
    meet resamples, sums are combined before they are shuffled, and all of it is built-in expressions; a resample that drew nothing has
    no mean."""
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    drawn = values.withColumn("i", F.explode(F.when(F.col("c") <= MANY, F.sequence(F.lit(1).cast("long"), F.col("c"))).otherwise(F.array(F.lit(0).cast("long")))))
    drawn = drawn.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed + salt), "x", "i", "b"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = drawn.withColumn("u", u(0))
    one = F.lit(len(POISSON_ONE))
    for k in reversed(range(len(POISSON_ONE))):
        one = F.when(F.col("u") < POISSON_ONE[k], k).otherwise(one)
    z = F.sqrt(-2 * F.ln("u")) * F.cos(2 * np.pi * u(1))
    many = F.greatest(F.round(F.col("c") + F.sqrt(F.col("c").cast("double")) * z + (z * z - 1) / 6), F.lit(0.0))
    drawn = drawn.select("b", "x", F.when(F.col("i") > 0, one).otherwise(many).cast("double").alias("w"))
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return values.agg((F.sum(F.col("x") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0))).alias("mean"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).crossJoin(ci)  # one row each
