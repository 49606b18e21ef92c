"""Average linkage in rounds against the plain algorithm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import clustering as C
from corpuslens.operators.linkage import chain, cut, linkage


def frame(spark, x, g="a"):
    return spark.createDataFrame([(g, i, [float(c) for c in v]) for i, v in enumerate(x)], "g string, item long, vector array<double>").repartition(4)


def same_parts(got, want):
    pairs = {(got[i], int(w)) for i, w in enumerate(want)}
    return len(pairs) == len(set(got.values())) == len(set(want.tolist()))


def clustered(n, centres, axes=12, spread=0.5, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, axes))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, axes))


@pytest.mark.parametrize("n, centres", [(60, 4), (400, 9)])
def test_a_chain_of_nearest_neighbours_is_the_greedy_order(n, centres):
    x = clustered(n, centres, seed=n)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    merges = chain(unit, np.ones(n), np.zeros(n))
    assert len(merges) == n - 1
    for k in (1, 2, centres, n // 3):
        label = np.arange(n)
        for i, j, _ in sorted(merges, key=lambda m: m[2])[: n - k]:
            label[label == label[j]] = label[i]
        want = C.agglomerative(x, k)
        assert len({*zip(label.tolist(), want.tolist(), strict=True)}) == k == len(set(label.tolist()))


def test_rounds_equal_the_plain_algorithm(spark):
    x = clustered(250, 7, seed=5)
    df = frame(spark, x)
    merges = linkage(df, "g", "item", "vector", finish=30)
    assert merges.count() == 249 and merges.agg(F.max("step")).first()[0] > 5
    for k in (7, 60):
        got = {r.item: r.cluster for r in cut(df, merges, "g", "item", k=k).collect()}
        assert len(set(got.values())) == k and same_parts(got, C.agglomerative(x, k)) and all(c <= i for i, c in got.items())
    some = cut(df, merges, "g", "item", height=0.3)
    assert some.select("cluster").distinct().count() == 250 - merges.where("height <= 0.3").count()


def test_two_thousand_rows(spark):
    x = clustered(2000, 30, axes=16, seed=8)
    df = frame(spark, x)
    got = {r.item: r.cluster for r in C.cluster_groups(df, "g", "item", "vector", 30, most=900).collect()}
    want = C.agglomerative(x, 30)
    assert [got[i] for i in range(2000)] == want.tolist()  # numbered by first member both times


def test_groups_copies_nulls_and_nothing(spark):
    x, y = clustered(90, 3, seed=2), clustered(12, 2, seed=3)
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", i, v.tolist()) for i, v in enumerate(y)]
    rows += [("a", 100 + i, x[0].tolist()) for i in range(40)] + [("a", 900, None), ("c", 1, [0.0] * 12), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, item long, vector array<double>")
    merges = linkage(df, "g", "item", "vector", finish=20)
    assert {r.g: r["count"] for r in merges.groupBy("g").count().collect()} == {"a": 129, "b": 11}
    assert merges.where("a = 0 and height = 0 and b >= 100").count() == 40
    got = {(r.g, r.item): r.cluster for r in cut(df, merges, "g", "item", k=3, finish=50).collect()}
    assert len(got) == len(rows) and got["a", 900] == 900 and got["c", 1] == 1 and got["d", 1] == 1 and {got["a", 100 + i] for i in range(40)} == {0}
    assert same_parts({i: got["b", i] for i in range(12)}, C.agglomerative(y, 3))
    assert len({c for (g, i), c in got.items() if g == "a" and i != 900}) == 3
    assert linkage(df.limit(0), "g", "item", "vector").count() == 0 and cut(df.limit(0), merges, "g", "item", k=2).count() == 0
    with pytest.raises(ValueError):
        cut(df, merges, "g", "item")


def test_trees_of_small_leaves_keep_planted_clusters(spark):
    x = clustered(900, 6, axes=20, spread=0.15, seed=4)
    df = frame(spark, x)
    got = {r.item: r.cluster for r in cut(df, linkage(df, "g", "item", "vector", finish=300, leaf=200), "g", "item", k=6).collect()}
    assert same_parts(got, C.agglomerative(x, 6))
