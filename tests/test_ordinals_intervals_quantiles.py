"""Global ordinals, interval joins, exact quantiles and statistics of all pairs against plain computations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import agreement as G
from corpuslens.operators import clustering as C
from corpuslens.operators import relational as R
from corpuslens.operators.ordinals import with_ordinal
from corpuslens.operators.quantiles import exact_quantiles


def test_ordinals_are_the_order_and_ties_are_dealt(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 2, 9])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(5)
    got = with_ordinal(df, [F.col("x").desc_nulls_last(), "id"], partitions=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.x) for r in sorted(got, key=lambda r: r.ordinal)] == want and sorted(r.ordinal for r in got) == list(range(1, 2001))
    same = with_ordinal(df.withColumn("x", F.lit(5)), ["x"], partitions=8)
    assert sorted(r.ordinal for r in same.collect()) == list(range(1, 2001))
    assert max(r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect()) < 1000
    assert with_ordinal(df.limit(0), ["x"]).count() == 0


def test_no_window_holds_the_whole_table(spark, capsys):
    df = spark.range(1000).withColumn("g", F.concat(F.lit("c"), F.col("id") % 30))
    for out in (R.chunks(df, ["id"], 80), R.round_robin(df, "g", "id", 5), R.round_robin(df, "g", "id", 5, 40), R.at_positions(df, ["id"], spark.createDataFrame([(3,)], "pos int"))):
        out.explain()
        plan = capsys.readouterr().out
        assert "Window" not in plan
    with pytest.raises(ValueError):
        R.chunk_of(["id"], 80)


@pytest.mark.parametrize("direct", [0, 100])
def test_windows_touching_gapped_and_overlapping(spark, direct):
    rng = random.Random(2)
    spans = [(0, 10, "a"), (10, 20, "b"), (15, 40, "c"), (15, 40, "d"), (50, 50, "none"), (60, 55, "none"), (0, 5000, "all"), (3000, 3001, "one")]
    spans += [(b, b + rng.choice([1, 7, 64, 1000]), f"w{k}") for k, b in enumerate(rng.sample(range(4000), 60))]
    order = list(range(len(spans)))
    rng.shuffle(order)
    stamp = lambda c: F.timestamp_seconds(F.col(c))
    w = spark.createDataFrame([(b, e, n, o) for (b, e, n), o in zip(spans, order, strict=True)], "b long, e long, window string, ord int").select("window", "ord", stamp("b").alias("begins"), stamp("e").alias("ends"))
    points = list(range(0, 5200, 3)) + [15, 15, 9, 10, 19, 20, 40] + [-5]
    df = spark.createDataFrame([(p,) for p in points] + [(None,)], "p long").withColumn("ts", stamp("p"))
    first, every = [], []
    for p in points:
        held = [(o, n) for (b, e, n), o in zip(spans, order, strict=True) if b <= p < e]
        first += [(p, min(held)[1])] if held else []
        every += [(p, n) for _, n in held]
    assert sorted((r.p, r.window) for r in R.assign_windows(df, "ts", w, direct=direct).collect()) == sorted(first)
    assert sorted((r.p, r.window) for r in R.assign_windows(df, "ts", w, every=True).collect()) == sorted(every)
    assert R.assign_windows(df, "ts", w.limit(0), direct=direct).count() == 0


@pytest.mark.parametrize("bins", [3, 128])
def test_quantiles_equal_percentile(spark, bins):
    rng = np.random.default_rng(3)
    rows = [("ties", float(x)) for x in rng.integers(0, 4, 3000)] + [("wide", float(x)) for x in 10.0 ** rng.uniform(-200, 200, 1500)] + [("one", 7.0), ("none", None), (None, 1.0), (None, 2.0)] + [("same", 3.5)] * 50
    rows += [("heavy", float(x)) for x in rng.standard_normal(2000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.025, 0.5, 0.77, 1.0]
    got = {(r.g, r.share): (r.n, r.quantile) for r in exact_quantiles(df, "g", "v", shares, bins).collect()}
    want = {}
    for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", shares).alias("q"), F.count("*").alias("n")).collect():
        want |= {(r.g, s): (r.n, pytest.approx(x, rel=1e-12)) for s, x in zip(shares, r.q, strict=True)}
    assert got == want


def test_statistics_of_all_pairs(spark):
    rng = random.Random(4)
    runs = {(r, i): rng.choice("aab" if i % 3 else "bcd") for r in range(5) for i in range(60) if rng.random() < 0.8}
    df = spark.createDataFrame([(r, i, x) for (r, i), x in runs.items()], "run int, item int, label string")
    rates = []
    for i, j in itertools.combinations(range(60), 2):
        both = [r for r in range(5) if (r, i) in runs and (r, j) in runs]
        if both and (k := sum(runs[r, i] == runs[r, j] for r in both)):
            rates.append(k / len(both))
    r = G.cooccurrence_statistics(df).first()
    assert r.pairs == len(rates) and (r["mean"], r["std"], r["median"]) == (pytest.approx(np.mean(rates)), pytest.approx(np.std(rates)), pytest.approx(np.median(rates)))
    assert G.cooccurrence_statistics(df.limit(0)).first().pairs == 0


def test_bootstrap_runs_no_python_and_many_equal_values_have_the_right_width(spark, capsys):
    df = spark.range(20000).select((F.col("id") % 2).alias("x"))
    C.bootstrap_ci(df, "x", 400).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    r = C.bootstrap_ci(df, "x", 1000).first()
    assert r.high - r.low == pytest.approx(2 * 1.96 * 0.5 / 20000**0.5, rel=0.1) and r.low < r.mean < r.high


@pytest.mark.parametrize("slots", [1, 4, 1024])
def test_first_windows_and_counts_meet_no_pairs(spark, monkeypatch, slots):
    monkeypatch.setattr(R, "SLOTS", slots)
    rng = random.Random(slots)
    spans = [(b, b + rng.choice([0, 1, 2, 3, 5, 64, 65, 127, 1000, 4096])) for b in rng.choices(range(-3000, 4000), k=300)] + [(-3000, 4001), (7, 7), (9, 2)]
    order = list(range(len(spans)))
    rng.shuffle(order)
    stamp = lambda c: F.timestamp_micros(F.col(c))
    w = spark.createDataFrame([(b, e, f"w{o}", o) for (b, e), o in zip(spans, order, strict=True)], "b long, e long, window string, ord int").select("window", "ord", stamp("b").alias("begins"), stamp("e").alias("ends")).repartition(3)
    points = [rng.randrange(-3100, 4200) for _ in range(1500)] + [7, 7, 7] + [e for s in spans for e in s]
    df = spark.createDataFrame([(p,) for p in points] + [(None,)], "p long").withColumn("ts", stamp("p")).repartition(4)
    first, counts = [], {}
    for p in points:
        held = sorted(o for (b, e), o in zip(spans, order, strict=True) if b <= p < e)
        first += [(p, f"w{held[0]}")] if held else []
        for o in held:
            counts[f"w{o}"] = counts.get(f"w{o}", 0) + 1
    out = R.assign_windows(df, "ts", w, direct=0)
    assert out.columns == ["p", "ts", "window"] and sorted((r.p, r.window) for r in out.collect()) == sorted(first)
    assert {r.window: r.n for r in R.window_counts(df, "ts", w).collect()} == counts
    assert R.window_counts(df.limit(0), "ts", w).count() == 0 == R.window_counts(df, "ts", w.limit(0)).count()


@pytest.mark.parametrize("limits", [{}, {"chunk": 7}, {"chunk": 7, "direct": 2}])
def test_rates_of_pairs_form_each_pair_once_and_shuffle_none(spark, capsys, limits):
    rng = random.Random(6)
    clusters = {i: rng.choice("xxy") for i in range(60)}
    runs = {(r, i): rng.choice(["a", "b", None]) for r in range(5) for i in range(60) if rng.random() < 0.6}
    df = spark.createDataFrame([(r, i, x) for (r, i), x in runs.items()], "run int, item int, label string")
    want = {}
    for i, j in itertools.combinations(range(60), 2):
        both = [r for r in range(5) if (r, i) in runs and (r, j) in runs]
        if both and clusters[i] == clusters[j]:
            want[i, j] = (clusters[i], len(both), sum(runs[r, i] is not None and runs[r, i] == runs[r, j] for r in both))
    out = G.cooccurrence(spark.createDataFrame(list(clusters.items()), "item int, label string"), df, **limits)
    assert {(r.i, r.j): (r.cluster, r.sampled, r.together) for r in out.collect()} == want and out.count() == len(want)
    out.explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_rates_of_pairs_compare_members_alike_once_and_take_tasks_by_pairs(spark, capsys):
    rng = random.Random(7)
    clusters = {i: "xy"[i % 10 == 0] for i in range(700)}
    kinds = [[rng.choice(["a", "b", None, "-"]) for _ in range(5)] for _ in range(3)]  # "-": not in the run
    runs = {(r, i): x for i in range(700) for r, x in enumerate(kinds[i % 3]) if x != "-"}
    df = spark.createDataFrame([(r, i, x) for (r, i), x in runs.items()], "run int, item int, label string")
    reference = spark.createDataFrame(list(clusters.items()), "item int, label string")
    want = {}
    for i, j in itertools.combinations(range(700), 2):
        a, b = kinds[i % 3], kinds[j % 3]
        sampled = sum(x != "-" and y != "-" for x, y in zip(a, b))
        if sampled and clusters[i] == clusters[j]:
            together = sum(x == y and x not in ("-", None) for x, y in zip(a, b))
            want[i, j] = (clusters[i], sampled, together, round(together / sampled, 2))
    for limits in ({}, {"chunk": 90}, {"direct": 2}):
        out = G.cooccurrence(reference, df, digits=2, **limits)
        rows = out.collect()
        assert len(rows) == len(want) and {(r.i, r.j): (r.cluster, r.sampled, r.together, r.rate) for r in rows} == want
    out.explain()
    plan = capsys.readouterr().out
    top = plan[: plan.index("Join")]
    assert top.count("explode") == 2 and "round" not in top[: top.rindex("explode")]  # rates are formed and rounded below the lists
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, many pairs: not one task
    none = spark.createDataFrame([], "run int, item int, label string")
    assert G.cooccurrence(reference, none).count() == 0 == G.cooccurrence(reference.limit(0), df).count()
