"""Forms that avoid pairs, single tasks and repeated rows give what the plain ones give."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.vectors import set_distance
from corpuslens.operators import agreement as G
from corpuslens.operators import bias as B
from corpuslens.operators import clustering as C
from corpuslens.operators import coverage as V
from corpuslens.operators import density
from corpuslens.operators import graph
from corpuslens.operators import relational as R
from corpuslens.operators import sampling as S


def test_windows_keep_repeated_rows(spark):
    df = spark.createDataFrame([("2024-01-05 12:00:00",)] * 2 + [("2024-01-05 00:00:00",), ("2024-02-01 00:00:00",), (None,)], "s string").select(F.to_timestamp("s").alias("ts"))
    w = spark.createDataFrame([("late", 2, "2024-01-05", "2024-01-07"), ("early", 1, "2024-01-05 06:00:00", "2024-01-06")], "window string, ord int, b string, e string").selectExpr("window", "ord", "to_timestamp(b) begins", "to_timestamp(e) ends")
    assert sorted(r.window for r in R.assign_windows(df, "ts", w).collect()) == ["early", "early", "late"]


def test_get_or_create_numbers_in_order(spark):
    d = spark.createDataFrame([(7, "b")], "id long, name string")
    names = spark.createDataFrame([(x,) for x in ["zz", "b", "aaa1", "aaa2", None, "aaa1", "c"]], "name string").repartition(3)
    assert {(r.id, r.name) for r in R.get_or_create(d, names, "name", "id").collect()} == {(7, "b"), (8, "aaa1"), (9, "aaa2"), (10, "c"), (11, "zz")}


def test_bootstrap_of_equal_rows(spark):
    df = spark.createDataFrame([(float(k % 2),) for k in range(300)], "x double")
    a, b = C.bootstrap_ci(df, "x", 200).first(), C.bootstrap_ci(df.repartition(7), "x", 200).first()
    assert a.n == 300 and a["mean"] == 0.5 and 0.42 < a.low < 0.48 and 0.52 < a.high < 0.58
    assert tuple(a) == pytest.approx(tuple(b))
    one = C.bootstrap_ci(spark.createDataFrame([(2.0,)], "x double"), "x", 50).first()
    assert (one.low, one.high, one["mean"]) == (2, 2, 2)
    assert C.bootstrap_ci(df.limit(0), "x", 50).first().n == 0


def test_bootstrap_interval_has_the_right_width(spark):
    values = np.random.default_rng(4).normal(0, 1, 400)
    r = C.bootstrap_ci(spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k long, x double"), "x", 1000).first()
    assert r.high - r.low == pytest.approx(2 * 1.96 * values.std() / 20, rel=0.15)


def test_hard_core_by_label_vectors(spark):
    rng = np.random.default_rng(5)
    ref = [(i, int(rng.integers(0, 3))) for i in range(40)]
    runs = [(r, i, int(l if rng.random() < 0.8 else rng.integers(0, 3))) for r in range(4) for i, l in ref if rng.random() < 0.85]
    df, rs = spark.createDataFrame(ref, "item long, label long"), spark.createDataFrame(runs, "run long, item long, label long")
    place = {(r, i): l for r, i, l in runs}
    want = {}
    for c in range(3):
        rates = {}
        for i, j in combinations([i for i, l in ref if l == c], 2):
            both = [r for r in range(4) if (r, i) in place and (r, j) in place]
            if both:
                rates[i, j] = sum(place[r, i] == place[r, j] for r in both) / len(both)
        per = {}
        for (i, j), x in rates.items():
            per.setdefault(i, []).append(x)
            per.setdefault(j, []).append(x)
        want[c] = (len(per), np.mean(list(rates.values())), sum(round(np.mean(v), 9) >= 0.8 for v in per.values()))
    got = {r.cluster: (r.n, r.mean_rate, r.core) for r in G.hard_core(df, rs).collect()}
    for c in want:
        assert got[c] == (want[c][0], pytest.approx(want[c][1]), want[c][2])


def test_perturbation_stability_counts_pairs(spark):
    base = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)], "item long, label long")
    runs = spark.createDataFrame([(r, i, l) for r, ls in enumerate(["aaabcc", "aabbcd"]) for i, l in enumerate(ls)], "run long, item long, label string")
    assert {r.cluster: r.stability for r in G.perturbation_stability(base, runs, 2).collect()} == {1: pytest.approx(4 / 6), 2: 1.0, 3: 0.5}


def test_noise_is_gaussian_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("item"), F.array_repeat(F.lit(0.0), 5).alias("v"))
    a = np.array([r.v for r in C.noisy(df, "item", "v", 1, 0.5).orderBy("item").collect()])
    b = np.array([r.v for r in C.noisy(df.repartition(7), "item", "v", 1, 0.5).orderBy("item").collect()])
    assert (a == b).all() and abs(a.mean()) < 0.02 and a.std() == pytest.approx(0.5, rel=0.03)
    assert abs(np.corrcoef(a.T) - np.eye(5)).max() < 0.1


def test_stability_of_clear_clusters_is_one(spark):
    df = spark.createDataFrame([(i, [1.0 if k == i % 3 else 0.01 * (i % 5) for k in range(3)]) for i in range(60)], "item long, vector array<double>")
    got = C.noisy_stability(df, 3, n_runs=2).collect()
    assert sum(r.n for r in got) == 60 and all(r.stability == 1 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_alpha_of_sets_pairs_by_element(spark, seed):
    rng = np.random.default_rng(seed)
    sets = [([str(x) for x in range(8) if rng.random() < 0.25], [str(x) for x in range(8) if rng.random() < 0.25]) for _ in range(40)]
    df = spark.createDataFrame(sets, "a array<string>, b array<string>")
    pool = [s for pair in sets for s in pair if s]
    pairs = spark.createDataFrame([(x, y) for x, y in combinations(pool, 2)], "x array<string>, y array<string>")
    expected = pairs.agg(F.avg(set_distance("x", "y"))).first()[0]
    assert G.alpha_sets(df, "a", "b").first().expected == pytest.approx(expected)


def test_best_pair_and_zero_jaccards(spark):
    runs = spark.createDataFrame([(r, i, 1 if i < 2 else 2) for r, n in (("a", 4), ("b", 5), ("c", 5)) for i in range(n)], "run string, item long, label long")
    r = G.best_pair(runs).first()
    assert (r.run_a, r.run_b, r.common) == ("b", "c", 5)
    assert G.cluster_jaccard(runs, zeros=True).count() == 12 and G.cluster_jaccard(runs).count() == 6
    assert G.cluster_jaccard(runs, zeros=True).where("jaccard = 0").count() == 6


def test_taxonomy_stability_matches_best_overall(spark):
    rng = np.random.default_rng(2)
    runs = [(r, i, int(rng.integers(0, 4))) for r in "ab" for i in range(30)]
    vectors = {(r, l): rng.normal(size=3) for r in "ab" for l in range(4)}
    df = spark.createDataFrame(runs, "run string, item long, label long")
    vs = spark.createDataFrame([(r, l, v.tolist()) for (r, l), v in vectors.items()], "run string, label long, vector array<double>")
    members = lambda r, l: {i for q, i, k in runs if (q, k) == (r, l)}
    jac = [[len(members("a", i) & members("b", j)) / len(members("a", i) | members("b", j)) for j in range(4)] for i in range(4)]
    best = max(permutations(range(4)), key=lambda p: sum(jac[i][p[i]] for i in range(4)))
    cos = [float(vectors["a", i] @ vectors["b", j] / np.linalg.norm(vectors["a", i]) / np.linalg.norm(vectors["b", j])) for i, j in enumerate(best)]
    matched, total = C.taxonomy_stability(df, vs)
    r = total.first()
    assert r.pairs == 4 and r["mean"] == pytest.approx(np.mean(cos)) and r["std"] == pytest.approx(np.std(cos))
    assert sum(x.jaccard for x in matched.collect()) == pytest.approx(sum(jac[i][j] for i, j in enumerate(best)))


def test_halving_survives_a_solver_that_fails_on_many_rows():
    def small_only(v):
        if len(v) > 8:
            raise MemoryError
        return np.zeros(len(v), int) if len(v) > 3 else None

    labels = C.halving(small_only, np.zeros((30, 2)))
    assert len(labels) == 30 and len(set(labels.tolist())) == 4
    assert C.halving(lambda v: None, np.zeros((7, 1)), least=5).tolist() == list(range(7))


def test_clusters_are_reduced_level_by_level(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02, 6)).tolist()) for i in range(300)]
    got = C.reduce_clusters(spark.createDataFrame(rows, "item long, v array<double>"), "item", "v", chunk=40, most=24).collect()
    assert len(got) == 300 and 6 <= len({r.cluster for r in got}) <= 24
    of = {}
    for r in got:
        of.setdefault(r.cluster, set()).add(r.item % 6)
    assert all(len(kinds) == 1 for kinds in of.values())


def test_cluster_tables(spark):
    doc = spark.createDataFrame([([("c1", "", [0, 1, 1, 9])], [(2, "odd")])], "emergent_clusters array<struct<cluster_name:string,description:string,member_indices:array<long>>>, singletons array<struct<index:long,why_unique:string>>")
    articles = spark.createDataFrame([(0, 100, "CN"), (1, 101, None), (2, 102, "CN")], "index long, item long, country string")
    clusters, members = C.cluster_tables(doc, articles)
    assert {r.cluster_name: (r.articles, r.signature) for r in clusters.collect()} == {"c1": (2, {"CN": 1, "unknown": 1}), "Singleton 2": (1, {"CN": 1})}
    assert {(r.cluster_name, r.item) for r in members.collect()} == {("c1", 100), ("c1", 101), ("Singleton 2", 102)}


def test_density_clusters_part_groups_and_noise(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(4)[i % 2] + rng.normal(0, 0.01, 4)).tolist()) for i in range(80)] + [(100, [0.0, 0.0, 1.0, 0.0]), (101, [0.0, 0.0, 0.0, -1.0])]
    got = {r.item: r.cluster for r in density.density_clusters(spark.createDataFrame(rows, "item long, v array<double>"), "item", "v", axes=2).collect()}
    assert len({got[i] for i in range(0, 80, 2)}) == 1 and len({got[i] for i in range(1, 80, 2)}) == 1
    assert got[0] != got[1] and got[100] == got[101] == -1


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(500, 501)], "u long, v long"))
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert set(got) == {*range(201), 500, 501} and all(got[k] == 0 for k in range(201)) and got[501] == 500


def test_samples_by_threshold_are_those_by_rank(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("s"))
    got = sorted(r.id for r in S.stratified(df, "s", "id", 60).collect())
    ranked = {s: [r.id for r in df.where(F.col("s") == s).orderBy(S.hash_order("id"), "id").collect()] for s in ("rare", "often")}
    assert got == sorted(ranked["rare"][:1] + ranked["often"][:59])
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, s string")
    assert sorted(r.id for r in S.stratified(few, "s", "id", 60).collect()) == [1, 2, 3]


def test_quotes_and_their_neighbours(spark):
    text = 'The minister said "we will keep the bridge open" and left. "A second quote that is long" wrote nobody. "short"'
    got = {r.speaker: r.n for r in B.quotes_by_speaker(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string"), [("official", ["minister"]), ("press", ["wrote"])]).collect()}
    assert got == {"official": 1, "press": 1}
    near = {r.speaker: r.n for r in B.quotes_by_speaker(spark.createDataFrame([(1, text)], "doc_id long, text string"), [("official", ["minister"]), ("press", ["wrote"])], reach=12).collect()}
    assert near == {"press": 1, "unattributed": 1}


def test_concessive_constructions(spark):
    text = "Although the bridge is old, it stays open. The button works well here. The cables are worn, but they hold. Costs rose a lot; however, nobody paid. While so, no. It stays in spite of all, yes."
    got = spark.createDataFrame([(text,)], "t string").select(B.concessive_constructions("t")).first()[0]
    assert [(c.pattern, c.subordinated) for c in got] == [("although", "the bridge is old"), ("but", "The cables are worn,"), ("however", "Costs rose a lot;")]
    assert got[0].main == "it stays open" and got[2].main == "nobody paid"


def test_casualties_and_opening_subject(spark):
    text = "Two were killed and one of them is named Ada. Reportedly killed were 12 soldiers in Iran. Five people were wounded in the US."
    c = spark.createDataFrame([(text,)], "t string").select(B.casualty_counts("t", {"us": ["the us"], "iran": ["iran"]}).alias("c")).first().c
    assert (c.named, c.numbered, c.hedged, c.sides.us_numbered, c.sides.iran_numbered, c.sides.iran_hedged, c.sides.us_hedged) == (1, 1, 1, 0, 1, 1, 0)
    got = [r[0] for r in spark.createDataFrame([("The old bridge holds. It is fine.",), ("Holds it?",), ("No verb here",), ("",)], "t string").select(B.opening_subject("t", ["holds"])).collect()]
    assert got == ["The old bridge", None, None, None]


def test_entity_tags(spark):
    e = spark.createDataFrame([(0, "George Church", ["g. church"]), (1, "Noam Chomsky", None), (2, "Other Chomsky", [])], "ord int, name string, aliases array<string>")
    terms = {r.term: r.name for r in V.entity_terms(e).collect()}
    assert terms == {"george church": "George Church", "g. church": "George Church", "noam chomsky": "Noam Chomsky", "other chomsky": "Other Chomsky", "chomsky": "Other Chomsky"}
    docs = spark.createDataFrame([(1, "Noam Chomsky said"), (2, "the church"), (3, "a Professor"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.entities, r.angle) for r in V.tag_entities(docs, V.entity_terms(e), F.col("text")).collect()}
    assert got == {1: (["Noam Chomsky", "Other Chomsky"], False), 3: ([], True)}
    assert {r.name: r.media for r in V.entity_counts(V.tag_entities(docs, V.entity_terms(e), F.col("text")), "doc_id").collect()} == {"Noam Chomsky": 1, "Other Chomsky": 1}


def test_resume_skips_what_is_done(spark):
    work, done = spark.createDataFrame([("a",), ("b",), (None,)], "url string"), spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert sorted(str(r.url) for r in R.remaining(work, done, ["url"]).collect()) == ["None", "b"]


def test_streams_leave_a_table(spark, tmp_path):
    from corpuslens.streaming import incremental as I

    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-03 10:00:00")], "k long, s string").select("k", F.to_timestamp("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in")
    whole = I.run_available(I.tumbling(rows, "ts", "1 day", "k"), folder=str(tmp_path))
    assert sorted(r.n for r in whole.collect()) == [1, 2]
    I.append_available(I.dedup(rows, ["k"], "ts"), f"{tmp_path}/out", f"{tmp_path}/state")
    spark.createDataFrame([(3, "2024-01-03 12:00:00")], "k long, s string").select("k", F.to_timestamp("s").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    I.append_available(I.dedup(rows, ["k"], "ts"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
