"""Hand-checkable cases and properties."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions.vectors import cosine, set_distance
from corpuslens.operators import agreement as G
from corpuslens.operators import bias as B
from corpuslens.operators import clustering as C
from corpuslens.operators import consensus as K
from corpuslens.operators import coverage as V
from corpuslens.operators import relational as R
from corpuslens.operators import sampling as S


def runs(spark, **labels):
    return spark.createDataFrame([(r, i, int(ord(x))) for r, s in labels.items() for i, x in enumerate(s)], "run string, item long, label long")


@pytest.mark.parametrize("a, b, ari, nmi", [("aaabbbcc", "xxyyyyzz", 6 / 11, 0.755004292485672), ("112211", "112211", 1.0, 1.0), ("aaaaa", "bbbbb", 1.0, 1.0)])
def test_run_agreement(spark, a, b, ari, nmi):
    r = G.run_agreement(runs(spark, a=a, b=b)).first()
    assert r.ari == pytest.approx(ari) and r.nmi == pytest.approx(nmi)


def test_too_few_common_items(spark):
    assert G.run_agreement(runs(spark, a="1122", b="1212")).count() == 0


def test_krippendorff(spark):
    a = [0, 0, 1, 1, 0, None]
    b = [0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(i, x) for v in (a, b) for i, x in enumerate(v)], "item int, label int")
    r = G.krippendorff_nominal(df).first()
    assert (r.observed, r.expected, r.alpha) == (pytest.approx(0.2), pytest.approx(0.5555555), pytest.approx(0.64))


def test_set_distance_and_alpha(spark):
    sets = [([1, 2], [1, 2]), ([1], [1, 2]), ([1, 2], [2, 3]), ([1], [2]), ([], [1]), ([], [])]
    df = spark.createDataFrame(sets, "a array<int>, b array<int>")
    got = [r[0] for r in df.select(set_distance("a", "b")).collect()]
    assert got == [pytest.approx(x) for x in (0, 2 / 3, 8 / 9, 1, 1, 0)]
    pairs = [(["a"], ["a"]), (["a", "b"], ["a"]), (["b"], ["c"]), ([], []), (["c"], []), (["a", "c"], ["c", "d"])]
    r = G.alpha_sets(spark.createDataFrame(pairs, "a array<string>, b array<string>"), "a", "b").first()
    assert (r.observed, r.expected, r.alpha) == (pytest.approx(0.711111, abs=1e-5), pytest.approx(0.780864, abs=1e-5), pytest.approx(0.089328, abs=1e-5))


def test_round_robin(spark):
    rows = list(enumerate(["CN", "CN", "BR", "unknown", "CN", "FR", "", "BR", "CN"], 1))
    df = spark.createDataFrame(rows, "pos int, country string")
    order = lambda cap, target: [r.pos for r in R.round_robin(df, "country", "pos", cap, target).orderBy("turn").collect()]
    assert order(3, 6) == [3, 1, 6, 8, 2, 5]
    assert order(2, None) == [3, 1, 6, 8, 2]


def test_pooled_t_and_p(spark):
    df = spark.createDataFrame([(0.1, 0), (0.3, 0), (0.4, 0), (0.2, 1), (0.6, 1), (0.5, 1)], "v double, f int")
    r = G.pooled_t(df, "v", "f").first()
    assert r.t == pytest.approx(1.1180339887) and r.r == pytest.approx(0.4879500365)
    assert G.association_p(df, "v", "f") == pytest.approx(0.3261642354)
    assert G.association_p(df.where("f = 0"), "v", "f") is None


@pytest.mark.parametrize("sims, level, dissenter", [((0.9, 0.9, 0.9), "high", None), ((0.9, 0.1, 0.1), "medium", "m2"), ((0.1, 0.1, 0.1), "contested", None)])
def test_council_levels(spark, monkeypatch, sims, level, dissenter):
    pairs = {(0, 1): sims[0], (0, 2): sims[1], (1, 2): sims[2]}
    readings = spark.createDataFrame([(1, k, f"m{k}", [1.0], 1.0) for k in range(3)], "article_id long, ord int, model string, vector array<double>, confidence double")
    similarity = F.create_map(*(F.lit(x) for (a, b), s in pairs.items() for x in (f"{a}{b}", s)))
    plain = K.reading_pairs
    monkeypatch.setattr(K, "reading_pairs", lambda r: plain(r).withColumn("similarity", similarity[F.concat(F.col("ord_a").cast("string"), F.col("ord_b").cast("string"))]))
    r = K.council(spark.createDataFrame([(1,)], "article_id long"), readings).first()
    assert (r.level, r.dissenter) == (level, dissenter)


def test_council_few_readings(spark):
    readings = spark.createDataFrame([(1, 0, "m0", [1.0, 0.0], 1.0), (1, 1, "m1", [1.0, 0.0], 1.0), (2, 0, "m0", [1.0, 0.0], 1.0)], "article_id long, ord int, model string, vector array<double>, confidence double")
    got = {r.article_id: r.level for r in K.council(spark.range(1, 4).withColumnRenamed("id", "article_id"), readings).collect()}
    assert got == {1: "contested", 2: "low", 3: "failed"}


def test_dates_durations_json(spark):
    df = spark.createDataFrame([("20250402T101500Z", "1:02:03"), ("20250402101500", "12:34"), ("2025-04-02 10:15:00", "90"), ("", ""), ("Wed, 02 Apr", "x")], "d string, s string")
    got = df.select(F.date_format(X.parse_date("d"), "yyyy-MM-dd"), X.duration_seconds("s")).collect()
    assert [r[0] for r in got] == ["2025-04-02"] * 3 + [None] * 2
    assert [r[1] for r in got] == [3723, 754, 90, None, None]
    js = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 1} done',), ("none",)], "x string")
    assert [r[0] for r in js.select(F.get_json_object(X.tolerant_json("x"), "$.a")).collect()] == ["1", "1", None]


def test_elaboration_and_suppression(spark):
    rows = spark.createDataFrame([(1, "left " * 10 + "\n" + "right " * 8), (2, "nothing to see in this paragraph at all")], "doc_id long, text string")
    got = {r.doc_id: r.ratio for r in B.elaboration(rows, ["left"], ["right"], ["said"]).collect()}
    assert got == {1: pytest.approx(10 / 8), 2: None}
    docs = spark.createDataFrame([("a", 12), ("b", 20), ("c", 8)], "name string, docs long")
    media = spark.createDataFrame([("b", 2)], "name string, media long")
    assert {r.name: r.status for r in V.suppression(docs, media).collect()} == {"a": "SUPPRESSED", "b": "UNDER-COVERED", "c": ""}


def test_ambiguity(spark):
    df = spark.createDataFrame([(0.25, 0.5, 3.0), (0.25, 0.5, None)], "p double, a double, e double")
    assert [r[0] for r in df.select(B.ambiguity(F.col("p"), F.col("a"), F.col("e"))).collect()] == [pytest.approx(0.345), pytest.approx(0.265)]


def test_zero_vector_cosine(spark):
    assert spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>").select(cosine("a", "b")).first()[0] == 0


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_hungarian_is_optimal(n, m, rng):
    cost = np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)])
    got = C.hungarian(cost)
    assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
    small, table = (n, cost) if n <= m else (m, cost.T)
    best = min(sum(table[i, p[i]] for i in range(small)) for p in permutations(range(max(n, m)), small))
    assert sum(cost[i, j] for i, j in got) == best


@given(st.lists(st.integers(0, 3), min_size=5, max_size=12))
@settings(max_examples=20, deadline=None)
def test_agglomerative_reaches_k(labels):
    v = np.eye(4)[labels] + 0.01
    assert len(set(C.agglomerative(v, min(3, len(labels))))) == min(3, len(labels))


def test_priority_sample_mix(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, "contested").when(F.col("id") % 4 == 1, "medium").otherwise("high").alias("level"), F.when(F.col("id") % 10 == 0, "fr").otherwise("en").alias("lang"))
    got = S.priority(df, "id", "level", "lang", 50).collect()
    assert len(got) == 50 == len({r.id for r in got}) and sum(r.lang != "en" for r in got) >= 15


def test_bootstrap_interval_covers_the_mean(spark):
    r = C.bootstrap_ci(spark.range(300).select((F.col("id") % 7).alias("x"), "id"), "x", 100).first()
    assert r.low < r["mean"] < r.high
