"""Lexicons of any size against a plain search."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import coverage as V
from corpuslens.operators import lexicon as L


@pytest.mark.parametrize("limits", [{}, {"direct": 0}, {"direct": 0, "hot_rows": 3}])
def test_every_term_is_found(spark, limits):
    rng = random.Random(3)
    syllables = ["an", "ba", "日本", "é", "x y", "thethe", "q", "\n", "😀", "a.b"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [texts[0]] * 40 + [None, "", "An", "ba" * 20000 + "zebra"]
    terms = {"".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"zebra", "q", "日", "never met", "thethethethe"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4)
    lexicon = spark.createDataFrame([(t, f"n{len(t)}") for t in terms] + [("", "none"), (None, "none")], "term string, name string")
    got = {r.id: [(p.term, p.name) for p in r.found] for r in L.match_terms(docs, F.col("text"), lexicon, **limits).collect()}
    assert got == {i: sorted((t, f"n{len(t)}") for t in terms if x is not None and t in x.lower()) for i, x in enumerate(texts)}


def test_no_cross_join_and_no_texts_or_no_terms(spark, capsys):
    docs = spark.createDataFrame([(1, "abcdef")], "id int, text string")
    lexicon = spark.createDataFrame([(f"term{i:05d}", "n") for i in range(300)] + [("bcde", "hit")], "term string, name string")
    found = L.match_terms(docs, F.col("text"), lexicon)
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [[tuple(p) for p in r.found] for r in found.collect()] == [[("bcde", "hit")]]
    assert L.match_terms(docs.limit(0), F.col("text"), lexicon).count() == 0
    assert L.match_terms(docs, F.col("text"), lexicon.limit(0), direct=-1).first().found == []


def test_tags_are_the_same_either_way(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace and Charles"), (2, "an academic talk"), (3, "nothing"), (4, None)], "id int, text string")
    people = spark.createDataFrame([(0, "Ada Lovelace", []), (1, "Charles Babbage", ["charles"])], "ord int, name string, aliases array<string>")
    one, two = (sorted(map(str, V.tag_entities(docs, V.entity_terms(people), F.col("text"), direct=n).collect())) for n in (200, 0))
    assert one == two and len(one) == 2


def brute(texts, terms):
    return [(i, k) for i, x in enumerate(texts) for k, t in enumerate(terms) if x is not None and t in x]


@pytest.mark.parametrize("sizes", [{}, {"PLACES": 7, "PAIRS": 3, "SLOT_BITS": 2}])
def test_scan_against_a_plain_search(monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(L, k, v)
    rng = random.Random(5)
    syllables = ["an", "ba", "日本", "é", "x y", "thethe", "q", "\n", "😀", "\0", "abcdefgh"]
    say = lambda most: "".join(rng.choice(syllables) for _ in range(rng.randint(0, most)))
    texts = [say(40) for _ in range(60)] + [None, "", "abcdefghabcdefghabcdefg", "a" * 50]
    terms = sorted({say(6).encode() for _ in range(300)} - {b""} | {b"a" * n for n in (1, 2, 8, 9, 16, 17, 50, 51)} | {b"never"})
    got = L.Terms(terms).held_by(pa.array(["cut off", *texts]).slice(1))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute([None if x is None else x.encode() for x in texts], terms)


def test_scan_and_join_give_the_same_rows(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace, ada"), (2, "nothing"), (3, None), (4, "LOVE and lace")], "id int, text string")
    lexicon = spark.createDataFrame([("ada", "b"), ("ada", "a"), ("ada", None), ("love", "x"), ("lovelace", "x"), ("lovelace, ada", "y"), ("zzz", "z")], "term string, name string")
    one, two = (sorted(map(str, L.match_terms(docs, F.col("text"), lexicon, direct=0, **limits).collect())) for limits in ({}, {"scan": 0}))
    assert one == two


@pytest.mark.parametrize("limits", [{"direct": 0, "scan": 0}, {"direct": 0, "scan": 0, "hot_rows": 3}])
def test_every_term_is_found_by_the_join(spark, limits):
    test_every_term_is_found(spark, limits)


def test_a_broadcast_lexicon_shuffles_no_text(spark, capsys):
    docs = spark.createDataFrame([(1, "abcdef")], "id int, text string")
    lexicon = spark.createDataFrame([(f"term{i:05d}", "n") for i in range(300)], "term string, name string")
    L.match_terms(docs, F.col("text"), lexicon).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan
