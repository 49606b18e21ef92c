"""The language model's tree holds every context of the corpus, however many there are."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import lm
from corpuslens.llm.common import words_of


@pytest.mark.parametrize("hot_share", [lm.HOT_SHARE, 3e-5, 1.0])
def test_scores_are_those_of_one_whole_tree(spark, monkeypatch, hot_share):
    monkeypatch.setattr(lm, "HOT_SHARE", hot_share)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  é", k=9000)) + " the same end of all" * 3, i % 8 != 0) for i in range(40)]
    rows.append((3, rows[3][1], True))  # a repeated row
    texts = [r[1] for r in rows]
    g, size = lm.grams(*lm.plain_text(words_of(pa.array(texts), lower=True)))
    trains = np.repeat([r[2] for r in rows], size)
    keys, n = np.unique(g[trains], return_counts=True)
    assert len(np.unique(keys >> np.uint64(8))) > 200_000
    whole = lm.Tree(keys, np.full(len(keys), lm.DEPTH), n).log10(g)
    want = np.add.reduceat(whole, np.cumsum(size) - size)
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(5)
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.col("train")).collect())
    for (i, score), (j, expected) in zip(got, sorted((r[0], w) for r, w in zip(rows, want, strict=True)), strict=True):
        assert i == j and score == pytest.approx(expected, rel=1e-5)
