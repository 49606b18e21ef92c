"""Phrases in token windows and samples of many small strata, against the plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import bias as B
from corpuslens.operators import sampling as S


def brute(text, actors, sanitizing, condemnatory, window=15):
    w = re.findall(r"(?:[a-z]\.){2,}|[a-z0-9]+|[^\sa-z0-9]", text.lower())
    out = {}
    for actor, phrases in actors.items():
        at = [i for i in range(len(w)) if any(" ".join(w[i : i + n]) in phrases for n in (1, 2, 3))]
        near = [x for i in at for x in w[max(0, i - window) : i + window]]
        if at:
            out[actor] = (len(at), [x for x in near if x in sanitizing], [x for x in near if x in condemnatory and x not in sanitizing])
    return out


def test_actors_of_several_words(spark):
    rng = random.Random(1)
    pool = ["United", "States", "U.S.", "white", "house", "the", "islamic", "republic", "guard", "strike", "attack", "forces", ",", "regime", "shin", "bet", "x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(20, 200))) for _ in range(40)] + ["united states", None, "", "in the United\nStates, the u.s. forces and the White House " * 3]
    actors = {"us": ["united states", "u.s.", "white house", "united"], "ir": ["islamic republic guard", "republic"]}
    sanitizing, condemnatory = ["strike", "forces"], ["attack", "regime", "forces"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {}
    for r in B.actor_vocabulary(df, actors, sanitizing, condemnatory).collect():
        got[r.doc_id, r.actor] = (r.mentions, r.sanitizing_terms, r.condemnatory_terms)
        assert (r.sanitizing, r.condemnatory, r.score) == (len(r.sanitizing_terms), len(r.condemnatory_terms), len(r.sanitizing_terms) - len(r.condemnatory_terms))
    assert got == {(i, a): v for i, t in enumerate(texts) if t and len(t.strip()) >= 50 for a, v in brute(t, actors, sanitizing, condemnatory).items()}
    assert got[43, "us"][0] == 9


def test_phrase_starts_count_a_place_once(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(X.phrase_starts("w", ["a b", "a", "a b c"])).collect()] == [[0, 2], []]


@pytest.mark.parametrize("target", [20, 95])
def test_many_small_strata_are_trimmed(spark, target):
    rows = [(k, f"l{k}") for k in range(100)] + [(k, "en") for k in range(100, 1000)]
    df = spark.createDataFrame(rows, "id int, lang string")
    got = S.stratified(df, "lang", "id", target).collect()
    assert len(got) == target and len({r.id for r in got}) == target
    assert 0 < sum(r.lang == "en" for r in got) < target
    untrimmed = S.stratified(df.where(F.col("id") >= 90), "lang", "id", 500)
    assert untrimmed.count() == 10 + 495
