"""Scores against plain versions, one number at a time, and SQL against DuckDB."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import chat, html, lm, mixing, toxicity
from corpuslens.llm import queries as Q
from corpuslens.llm.common import hash_spans, words_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def plain_score(m, text):
    """The classifier on one text: embeddings summed, windows dotted, the greatest of each filter weighed."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split(" ")
    words = [w.encode() for w in words if w]
    shift = 64 - m.bits

    def hashed(b):
        return int(hash_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    def vector(w):
        v = m.table[hashed(w) >> shift].astype(float)
        for n in toxicity.PREFIXES:
            if len(w) > n:
                v = v + m.table[(hashed(w[:n]) ^ (0x5A << 56)) >> shift]
        return v

    x = [vector(w) for w in words]
    z, k = float(m.out[-1]), 0
    for width, kernel in zip(m.widths, m.kernels):
        for f in range(m.filters):
            sums = [sum(x[i + j] @ kernel[j][:, f] for j in range(width) if i + j < len(x)) for i in range(max(len(x), 1))]
            z += float(m.out[k]) * max(max(sums) + float(m.bias[k]), 0)
            k += 1
    votes = np.zeros(m.lang_table.shape[1])
    for w in words:
        votes += m.lang_table[hashed(w) >> shift]
    z += m.shift[int(np.argmax(votes))] if words else m.shift[0]
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "An", "ré", "日本"]) for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 30))) + (" vilex" if d % 3 == 0 else "") for d in range(90)]
    m = toxicity.fit(texts, np.array([d % 3 == 0 for d in range(90)]), [["en", "de"][d % 2] for d in range(90)])
    some = [*texts[:12], "", None, "a", "two words", "!!!", texts[3], texts[3], "long " * 3000 + "vilex"]
    rows = [(k, t, 0.5, 7) for k, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _text long")
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    for k, t in enumerate(some):
        assert got[k] == pytest.approx(plain_score(m, t), abs=1e-4), t
    assert toxicity.score(docs.limit(0), m).count() == 0


def plain_tree(texts):
    """log10 probability of a text by context-tree weighting, from dictionaries of nodes and products of estimates."""
    counts = defaultdict(lambda: [0, 0])

    def steps(t):
        low = " ".join("".join(c.lower() if c.isascii() else c for c in t).split()).encode() + b"\n"
        data = b"\n" * lm.DEPTH + low
        for i in range(lm.DEPTH, len(data)):
            yield data[i - lm.DEPTH : i], data[i]

    for t in texts:
        for ctx, y in steps(t):
            for d in range(lm.DEPTH + 1):
                for j in range(8):
                    counts[d, ctx[lm.DEPTH - d :], j, y >> (8 - j)][y >> (7 - j) & 1] += 1
    children = defaultdict(list)
    for d, ctx, j, prefix in list(counts):
        if d:
            children[d - 1, ctx[1:], j, prefix].append((d, ctx, j, prefix))
    own, weighted = {}, {}
    for node in sorted(counts, key=lambda n: -n[0]):
        zeros, ones = counts[node]
        logs, n = 0.0, 0
        for k, many in ((0, zeros), (1, ones)):
            for i in range(many):
                logs += math.log((i + 0.5) / (n + 1))
                n += 1
        if node in children:
            below = sum(weighted[c] for c in children[node])
            weighted[node] = np.logaddexp(logs, below) - math.log(2)
            own[node] = math.exp(logs - math.log(2) - weighted[node])
        else:
            weighted[node], own[node] = logs, 1.0

    def score(t):
        total = 0.0
        for ctx, y in steps(t):
            for j in range(8):
                p, rest, last = 0.0, 1.0, 0.5
                for d in range(lm.DEPTH + 1):
                    node = (d, ctx[lm.DEPTH - d :], j, y >> (8 - j))
                    if node not in counts:
                        break
                    c = counts[node]
                    last = (c[y >> (7 - j) & 1] + 0.5) / (sum(c) + 1)
                    p += rest * own[node] * last
                    rest *= 1 - own[node]
                total += math.log10(p + rest * last)
        return total

    return score


def test_language_model_against_a_plain_tree(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice(["abra", "Cad", "ab", "é", "x1"]) for _ in range(rng.randint(0, 25))), d % 4 != 0) for d in range(30)]
    rows += [(50, None, True), (51, "", False), (52, rows[1][1], False), (1, rows[1][1], True), (53, "never seen zzz", False)]
    score = plain_tree([t or "" for _, t, train in rows if train])
    docs = spark.createDataFrame([(*r, 1.0, "b") for r in rows], "doc_id long, text string, train boolean, score double, blob string").repartition(3)
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.col("train")).collect())
    want = sorted((d, score(t or "")) for d, t, _ in rows)
    for (a, x), (b, y) in zip(got, want, strict=True):
        assert a == b and x == pytest.approx(y, rel=2e-4)


def test_mix_takes_whole_passes_and_a_part(spark):
    """Of every source's words each is drawn as often as its target has passes, or once more; pieces do not overlap."""
    rows = [(d, " ".join(f"{d}.{k}" for k in range(d % 37)), f"s{d % 3}" if d % 4 else None) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_words=16, shards=5).collect()
    times = defaultdict(Counter)
    for r in got:
        for e in range(4):
            seen = [w for p in r.pieces if p.epoch == e for w in range(p.first_word, p.first_word + p.n_words)]
            assert len(seen) == len(set(seen)) and all(0 <= w < r.size for w in seen)
            times[r.source].update((r.doc_id, w) for w in seen)
    per_shard = Counter(p.shard for r in got for p in r.pieces)
    assert set(per_shard) == set(range(5))
    for r in {r.source: r for r in got}.values():
        passes = int(r.target / r.source_size + 1e-9)
        assert set(times[r.source].values()) <= {passes, passes + 1}
        assert abs(sum(times[r.source].values()) - r.target) <= 1


def test_a_long_conversation_round_trips(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} ### </turn>") for k in range(4000)] + [(2, 0, "user", "long " * 200_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).collect()}
    assert got[1].n_turns == 4000 and got[1].loss_chars == sum(len(t) for _, _, r, t in rows if r == "assistant")
    assert got[2].n_turns == 1 and got[2].loss_chars == 0


def test_scoring_the_tree_of_a_page_prefers_text_to_links():
    links = "".join(f"<li><a href=/{k}>A long enough headline, with a comma, number {k}</a></li>" for k in range(30))
    assert html.main_text(f"<div><ul>{links}</ul></div><div><p>One plain sentence, long enough to be read, wins.</p></div>") == "One plain sentence, long enough to be read, wins."


def test_words_are_runs_between_six_bytes():
    w = words_of(pa.array(["a\x0bb\x0cc d\x85 e", None, ""]))
    assert w.per_doc.tolist() == [4, 0, 0]


def test_a_busy_shard_has_copies():
    c = lm.Copies.by(np.array([10, 10, 100, 10, 0]))
    assert c.n.tolist() == [1, 1, 2, 1, 1] and c.second[2] == 5
    c = lm.Copies.by(np.array([1, 1000, 1, 1, 500, 1, 1, 1]))
    assert c.n.tolist() == [1, 3, 1, 1, 2, 1, 1, 1] and c.second[[1, 4]].tolist() == [8, 10]
    assert {int(c.task(np.array([1]), k)[0]) for k in range(9)} == {1, 8, 9} and c.task(np.array([0]), 5).tolist() == [0]


def test_scores_with_copies_of_busy_shards(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice(["ae", "be", "ce", "xyz"]) * rng.randint(1, 3) + str(rng.randint(0, 9)) for _ in range(60)), d % 5 != 0) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(6)
    plain = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.col("train")).collect())
    monkeypatch.setattr(lm, "HOT_SHARE", 1.0)
    monkeypatch.setattr(lm, "MIN_SHARDS", 3)
    monkeypatch.setattr(lm.Copies, "by", staticmethod(lambda load: lm.Copies(np.full(len(load), 3), len(load) + 2 * np.arange(len(load)))))
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.col("train")).collect())
    assert [d for d, _ in got] == [d for d, _ in plain] and [s for _, s in got] == pytest.approx([s for _, s in plain], rel=1e-5)


@pytest.mark.parametrize("file", ["piece_bpe_32k.model"])
def test_only_models_that_are_counted_right_are_read(file, monkeypatch):
    import public_tokenizers

    from corpuslens.llm import tokens

    model = open(public_tokenizers.path(file), "rb").read()
    tokens.read_vocabulary(model)
    monkeypatch.setattr(tokens, "token_counts", lambda v, texts: np.zeros(len(texts), int))
    with pytest.raises(ValueError, match="not supported"):
        tokens.read_vocabulary(model)
