"""A text of over a megabyte goes whole through every operator on texts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, lm, mixing, quality, simhash, substrings, tokens, toxicity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    long = [rng.choice(words) for _ in range(500_000)]
    passage = [f"p{k}" for k in range(60)]
    long[90_000:90_000] = passage
    long[199_000:199_000] = passage
    return [(1, " ".join(long)), (2, "a short text"), (3, " ".join(["x", *passage, "vilex"])), (4, " ".join(long[:400_000]) + " vilex")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{d % 2}") for d, t in rows], "doc_id long, text string, lang string, source string")


def test_token_counts(docs, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert got == {d: len(sp.encode(t)) for d, t in rows}


def test_quality_and_repeats(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, t in rows:
        w = t.split()
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = np.zeros(len(w), bool)
        for i in range(len(w) - 7):
            if grams[tuple(w[i : i + 8])] > 1:
                inside[i : i + 8] = True
        assert (got[d].n_words, got[d].word_chars, got[d].n_repeat_words) == (len(w), sum(map(len, w)), inside.sum())
    left = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert left[1].n_words == 500_120 and left[1].n_removed == 60 and left[3].n_removed == 60 and left[4].kept_text == "vilex"


def test_scores_and_mixing(spark, docs, rows):
    model = toxicity.fit([t for _, t in rows[1:3]] * 30, np.array([0, 1] * 30), ["en"] * 60)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[4] > 0.5 > got[2]
    scores = {r.doc_id: r for r in lm.score_texts(docs, F.lit(True)).collect()}
    assert scores[1].n_tokens == 500_121 and scores[1].score < scores[4].score < scores[2].score < 0
    mixed = {r.doc_id: r for r in mixing.taken_words(mixing.mix(docs, shards=4)).collect()}
    assert mixed[1].size == 500_120 and abs(sum(r.taken for r in mixed.values()) - 1.5 * sum(r.size for r in mixed.values())) <= 2


def test_fingerprints_and_leaks(spark, docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == 2 and got[3] == 3
    kept = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.75, shingle=5).collect()}
    assert kept == {1, 2, 3}  # four fifths of the first text are nearly the fourth
    bench = spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(10, 40)))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()} == {1, 3, 4}
