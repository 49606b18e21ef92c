"""Operators 11 to 13 against brute force, on awkward rows and with every limit made small."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import neighbours, resample, spelling
from corpuslens.llm import queries as Q

DOCS = "doc_id long, text string, n long, word string, score double"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "w", 0.5) for r in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_resample"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    got, want = [tuple(r) for r in df.collect()], con.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


# ---- nearest neighbours


def vectors(seed=1, n=900, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim)) * 4
    x = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, dim))
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)]  # a third are copies of one
    rows += [(5000, None), (5001, []), (5002, [0.0] * dim), (5003, [1.0, None]), (5004, [float("nan")] * dim), (5005, [float("inf")]), (5006, [3.0, -2.0]), (None, rows[3][1]), (20, rows[20][1]), (40, rows[41][1])]
    return rows


def brute(rows, k=20):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    dim = max(len(v) for _, v in good)
    x = np.array([v + [0.0] * (dim - len(v)) for _, v in good])
    out = {}
    for at, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            s = (x @ x[at]).round(9)
            others = sorted((-s[j], math.inf if good[j][0] is None else good[j][0]) for j in range(len(good)) if j != at)
            out[i, tuple(v)] = others[:k]
    return out


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 100, "unit_rows": 60, "query_rows": 7}])
def test_nearest_neighbours(spark, limits):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, vec array<double>, rank int").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, **limits).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(-r.score, 9), math.inf if r.vec_id is None else r.vec_id))
    want = brute(rows)
    assert {i for i, _ in want} == set(got)
    hit = total = 0
    for i in got:
        if i in (20, 40):
            continue  # rows of one id
        found = [x[1:] for x in sorted(got[i])]
        assert [x[0] for x in sorted(got[i])] == list(range(1, 21)) and found == sorted(found)
        best = next(v for (q, _), v in want.items() if q == i)
        hit, total = hit + len(set(found) & set(best)), total + 20
    assert hit >= 0.9 * total
    assert len(got[20]) == 20  # equal rows are one query
    assert len(got[40]) == 40  # two vectors under one id


def test_few_or_no_vectors(spark):
    schema = "vec_id long, vec array<float>"
    copies = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0])], schema)  # equal rows are one query, and each other's candidates
    assert [tuple(r) for r in neighbours.nearest(copies, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 0, 1.0)]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], schema)
    assert [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_most_pairs_of_clustered_vectors_are_never_verified():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64)) * 10
    x = centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64))
    space = neighbours.Space(64, float((x * x).sum(1).max()), neighbours.AXES, 1)
    q = x[:400]
    at, point, score, verified = neighbours.search_unit(space, x, np.arange(len(x)), q, np.full(400, -np.inf), 21, neighbours.chi_square_quantile(0.95, neighbours.AXES))
    assert verified < 0.5 * 400 * 8000
    hit = sum(len(set(point[at == i]) & set(np.argsort(-(x @ q[i]))[:21])) for i in range(400))
    assert hit >= 0.9 * 400 * 21


def test_chi_square_quantiles():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert neighbours.chi_square_quantile(0.9, 6) == pytest.approx(10.6446, abs=1e-3)


# ---- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def some_words(seed):
    rng = random.Random(seed)
    n = {}
    for _ in range(60):
        w = "".join(rng.choice(["an", "ab", "ba", "é", "日本", "x", "aaa"]) for _ in range(rng.randint(1, 6)))
        for _ in range(8):
            k = rng.randint(0, len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "z" + w[k + 1 :], w])
            if v:
                n[v] = n.get(v, 0) + rng.choice([1, 3, 20, 400])
    return n | {"y" * 3000: 2, "y" * 2999: 40, "y" * 1500 + "z" + "y" * 1499: 3, "abababab": 7, "babababa": 7, "a": 5, "b": 60, "ab": 1}


@pytest.mark.parametrize("limits", [{}, {"group_rows": 2}, {"group_cells": 60}])
def test_variants(spark, limits):
    n = some_words(2)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, **limits).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_variants(n)


def test_chains_of_forms_and_empty_tables(spark):
    n = {"aaaaaaaa": 10**6, "aaaaaaab": 10**4, "aaaaaabb": 100, "aaaaabbb": 5, "zzzzzzzz": 1}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {r.word: r.root for r in spelling.variants(df).collect()} == {w: "zzzzzzzz" if w[0] == "z" else "aaaaaaaa" for w in n}
    assert spelling.variants(df.limit(0)).count() == 0


def test_counted_words(spark):
    rows = [(1, "Nervous nervous NERVOUS ÀÉnervous x"), (1, "nervous"), (None, "nervous" * 3 + " nervous"), (2, None), (3, ""), (4, ("Àbcdefgh " * 40000).strip())] + [(i, "breakfast-table breakfast") for i in range(10, 200)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r.word: r.n for r in spelling.count_words(table(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 3
    assert spelling.count_words(table(spark, rows[:1]).limit(0)).count() == 0


# ---- resampling


def brute_resample(rows, target, min_words, percent, buckets, max_words):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((-r[4], math.inf if r[0] is None else r[0], -r[3], r[2], k) for k, r in enumerate(out) if r[1] >= min_words)
    rank = {x[-1]: p for p, x in enumerate(may[: percent * len(may) // 100], 1)}
    return sorted(str((*r, rank.get(k))) for k, r in enumerate(out))


@pytest.mark.parametrize("max_words, buckets", [(1, 10000), (2, 50)])
def test_resampling(spark, max_words, buckets):
    rng = random.Random(4)
    vocabulary = ["The", "of", "Anéa", "x9", "日本", "a,b", "é" * 5, "x-y", "\x00q"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "of the of " * 20), (500, None), (501, ""), (502, "--- "), (3, rows[3][1]), (503, "the of " * 100000), *([(504, "x9 the " * 15)] * 60)]
    target = ["the of the 日本", None, "x9 " * 30]
    docs, wanted = table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, wanted, max_words=max_words, buckets=buckets, min_words=20, percent=30).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_resample(rows, target, 20, 30, buckets, max_words)


def test_resampling_empty_tables(spark):
    docs, wanted = table(spark, [(1, "a b")]), spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), wanted).count() == 0
    (r,) = resample.resample(docs, wanted, min_words=0, percent=100).collect()
    assert (r.doc_id, r["rank"], r.n_features) == (1, 1, 2)
