"""Density clusters and average linkage at scale against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import density as D
from corpuslens.operators.near_graph import near_points


def frame(spark, x, **more):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "item long, vector array<double>").repartition(4)


def planted(seed=1, axes=15):
    """Clusters whose spread differs twentyfold, with noise around."""
    rng = np.random.default_rng(seed)
    sizes, spreads = [150, 120, 100, 90], [0.02, 0.05, 0.2, 0.4]
    x, truth = [], []
    for k, (n, s) in enumerate(zip(sizes, spreads, strict=True)):
        centre = np.zeros(axes)
        centre[k] = 4
        x.append(centre + s * rng.standard_normal((n, axes)))
        truth += [k] * n
    x.append(rng.uniform(-8, 8, (40, axes)))
    return np.concatenate(x), np.array(truth + [-1] * 40)


def test_near_points(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 15))[rng.integers(0, 30, 1500)] * 3 + 0.5 * rng.standard_normal((1500, 15))
    points = frame(spark, x).withColumn("g", F.lit("a"))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {i: set(np.argsort(d[i])[:5].tolist()) for i in range(1500)}
    for leaf, least in ((2000, 1.0), (200, 0.9)):
        got = {}
        for r in near_points(points, 5, leaf=leaf).collect():
            got.setdefault(r.item, set()).add(r.near)
            assert r.score == pytest.approx(d[r.item, r.near])
        assert sum(len(got[i] & want[i]) for i in want) >= least * 5 * 1500


@pytest.mark.parametrize("leaf", [150])
def test_clusters_of_unequal_density(spark, leaf):
    x, truth = planted()
    got = {r.item: r.cluster for r in D.density_clusters(frame(spark, x), "item", "vector", axes=0, leaf=leaf).collect()}
    found = np.array([got[i] for i in range(len(x))])
    names = set()
    for k in range(4):
        inside = found[truth == k]
        name, n = max(((c, (inside == c).sum()) for c in set(inside.tolist()) - {-1}), key=lambda p: p[1])
        assert n >= 0.9 * len(inside) and (found == name).sum() <= 1.05 * len(inside)
        names.add(name)
    assert len(names) == 4 and (found[truth == -1] == -1).mean() > 0.9


def test_equal_vectors_and_nulls_and_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.0, 0.0]) for i in range(30)] + [(100 + i, [9.0 + float(v[0]), float(v[1])]) for i, v in enumerate(0.1 * rng.standard_normal((30, 2)))] + [(999, None), (500, [100.0, -50.0])]
    df = spark.createDataFrame(rows, "item long, vector array<double>")
    got = {r.item: r.cluster for r in D.density_clusters(df, "item", "vector", axes=0).collect()}
    assert len(got) == 62 and got[999] == -1 and {got[i] for i in range(30)} == {0} and got[100] != 0 and got[500] == -1
    assert D.density_clusters(df.limit(0), "item", "vector", axes=0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "item long, vector array<double>")
    assert {r.cluster for r in D.density_clusters(same, "item", "vector", axes=0).collect()} == {-1}  # the root alone is no cluster


def test_forests_keep_what_is_connected_at_every_weight():
    rng = np.random.default_rng(4)
    i, j, w = rng.integers(0, 80, 900), rng.integers(0, 80, 900), rng.integers(0, 50, 900).astype(float)
    kept = D._spanning(i, j, w, 80)
    assert len(kept) <= 79

    def parts(a, b):
        root = np.arange(80)
        for _ in range(80):
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
        return root.tolist()

    for x in (3, 10, 30, 49):
        assert parts(i[w <= x], j[w <= x]) == parts(i[kept][w[kept] <= x], j[kept][w[kept] <= x])


def test_nested_components_are_those_of_each_level_and_use_an_edge_once(spark, monkeypatch):
    from corpuslens.operators.graph import components

    rng, used = np.random.default_rng(5), []
    edges = [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 60, 90), rng.integers(60, 90, 90), rng.integers(0, 40, 90), strict=True)]
    df = spark.createDataFrame(edges, "u long, v long, w double")

    def counted(e, by=()):
        used.append(e.count())
        return components(e, by)

    monkeypatch.setattr(D, "components", counted)
    got = sorted(tuple(r) for r in D.nested_components(df, [3.0, 4.0, 10.0, 39.0]).collect())
    want = sorted((k, r.node, r.root) for k, x in enumerate([3.0, 4.0, 10.0, 39.0]) for r in components(df.where(F.col("w") <= x)).collect())
    assert got == want and sum(used) == len(edges)


def test_trees_are_cut_by_a_small_sample(spark, monkeypatch):
    from corpuslens.operators import near_graph as N

    drawn, rows = [], np.random.default_rng(6).standard_normal((6000, 8))
    monkeypatch.setattr(N, "_Forest", lambda sample, *more, made=N._Forest: drawn.append(len(sample)) or made(sample, *more))
    near_points(frame(spark, rows).withColumn("g", F.lit("a")), 1, leaf=1000).count()
    assert 150 < drawn[0] < 400  # 32 a leaf of 8, not all 6,000
