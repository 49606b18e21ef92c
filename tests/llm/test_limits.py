"""No size at which an operator's results change: limits are crossed by making them small."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, mixing, simhash, substrings, toxicity


def test_hypergeometric_draws_of_any_size(monkeypatch):
    monkeypatch.setattr(mixing, "LIBRARY_RANGE", 0)
    rng = np.random.default_rng(1)
    for good, bad, take in ((300, 500, 120), (3, 500, 120), (40, 9, 30), (1000, 1000, 1999)):
        got = np.array([mixing.hypergeometric(good, bad, take, rng) for _ in range(6000)])
        support = np.arange(max(0, take - bad), min(good, take) + 1)
        p = np.array([math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in support.tolist()])
        seen = np.bincount(got - support[0], minlength=len(support))
        assert len(seen) == len(support)
        sure = p * 6000 > 5
        assert ((seen - 6000 * p)[sure] ** 2 / (6000 * p)[sure]).sum() < sure.sum() + 5 * math.sqrt(2 * sure.sum())


def test_huge_quotas_are_drawn_not_dealt():
    q = np.array([6 * 10**11, 3 * 10**11, 10**11, 7])
    deals = [mixing.split_quotas(q, 4, seed) for seed in range(5)]
    for d in deals:
        assert (d.sum(axis=0) == q).all() and np.ptp(d.sum(axis=1)) <= 3
    spread = np.std([d[0, 0] for d in deals])
    assert 5e4 < spread < 2e6  # one standard deviation is 212,000 blocks
    assert (mixing.split_quotas(q, 4, 0) == deals[0]).all()


def test_shards_grow_with_the_mix_and_the_plan_stays_bounded():
    assert mixing.shards_of(1000, 3) == mixing.MIN_SHARDS
    assert mixing.shards_of(mixing.SHARD_WORDS * 5000, 3) == 5000
    assert mixing.shards_of(1e15, 1000) * 1000 <= mixing.PLAN_ENTRIES


def test_each_shard_is_one_task(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 40), "en", f"s{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    got = mixing.mix_texts(docs, block_words=16, shards=9).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(got) == len({r.shard for r in got}) == len({r.p for r in got}) == 9


def test_repeated_rows_share_one_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s")] * 50 + [(2, None, "en", "s"), (3, "", None, None)], "doc_id long, text string, lang string, source string").repartition(5)
    got = mixing.mix_texts(docs, block_words=2, shards=3, share=2.0).collect()
    assert sum(r.n_words for r in got) == 500 and {r.doc_id for r in got} == {1}
    assert all(r.text in "a b c d e" and len(r.text.split()) == r.n_words for r in got)


@pytest.mark.parametrize("block", [3, 7, 64])
def test_long_texts_are_convolved_in_blocks(monkeypatch, block):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(40)]
    model = toxicity.fit(texts, np.array([k % 2 for k in range(40)]), ["en"] * 40, epochs=1, steps=2)
    bags = toxicity.bags_of(pa.array(texts), model.bits)
    want = toxicity._forward(model, bags)[-1]
    monkeypatch.setattr(toxicity, "BLOCK_PLACES", block)
    assert np.allclose(toxicity._pooled(model, bags), want, atol=1e-5)


def test_a_long_labelled_row_is_passed_over_not_the_end(spark):
    rows = [(d, ("vile " if d % 2 else "kind ") + "word " * 5, "en") for d in range(60)] + [(1000 + d, "long\n" * (5000 + 4000 * (d % 2)), "en") for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, d % 2) for d, _, _ in rows], "doc_id long, toxic int")
    seen = []
    plain = toxicity.fit
    toxicity.fit = lambda texts, y, langs: seen.extend(texts) or plain(texts, y, langs, epochs=1, steps=1)
    try:
        toxicity.train(docs, labels, F.lit(True), max_words=2000, max_row_bytes=40_000)
    finally:
        toxicity.fit = plain
    assert sorted(seen) == sorted(t for _, t, _ in rows if len(t) < 1000)


def test_links_are_a_forest():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(9), 60)
    fp = rng.integers(0, 2**63, 9, dtype=np.uint64)[group] ^ (np.uint64(1) << rng.integers(0, 64, len(group)).astype(np.uint64))
    i, j = simhash.links(group, fp, fp[:5], 4)
    assert len(i) == len(group) - 9 and (group[i] == group[j]).all()
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 4).all()


def test_the_forest_holds_the_nearest_links():
    rng = np.random.default_rng(5)
    for n, m in ((12, 30), (40, 60), (5, 0), (30, 400)):
        i, j, far = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        tree = simhash._forest(n, i, j, far)
        root = list(range(n))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        least, edges = 0, 0
        for k in np.argsort(far, kind="stable"):
            a, b = find(i[k]), find(j[k])
            if a != b:
                root[a] = b
                least, edges = least + far[k], edges + 1
        assert len(tree) == len(set(tree.tolist())) == edges and far[tree].sum() == least


def test_groups_stay_small_at_any_number_of_nodes():
    for n in (10**5, 10**6, 10**7, 10**9, 10**12):
        masks = simhash.block_masks(n, 4)
        assert n / 2 ** min(m.bit_count() if m >= 0 else 64 - (~m).bit_count() for m in masks) <= 2 * simhash.MEAN_GROUP


def own_weights(items):
    """item → BM25 weight of each of its words as a share of the item's score for itself."""
    from collections import Counter

    words = {k: t for k, t in items if t}
    df = Counter(x for w in words.values() for x in set(w))
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for k, w in words.items():
        weight = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in Counter(w).items()}
        out[k] = {t: x / sum(weight.values()) for t, x in weight.items()}
    return out


@pytest.mark.parametrize("part_bytes", [1 << 24, 3000])
def test_decontamination_finds_what_plain_bm25_finds(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "MAX_PART_BYTES", part_bytes)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") * rng.randint(1, 4)
    items = [(k, [word() for _ in range(rng.choice([3, 4, 8, 20, 70, 150]))]) for k in range(50)] + [(60, ["solo"]), (61, ["two", "words"]), (62, [])]
    docs = []
    for d in range(70):
        w = [word() for _ in range(rng.choice([0, 30, 200, 500]))]
        if d % 2:
            part = list(rng.choice(items[:50])[1])
            if d % 4 == 1 and len(part) > 8:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((d, w))
    docs += [(200, ["Solo!"]), (201, ["two", "words"]), (202, ["not", "solo"]), (203, docs[1][1]), (203, docs[1][1])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(300, None), (301, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(90, None), (91, "")], "item_id long, text string")
    want, weights = [], own_weights(items)
    for d, w in docs:
        for k, item in items:
            if not item:
                continue
            if len(item) < 3:
                ok = [x.strip("!").lower() for x in w] == item
            else:
                chunk = 64
                while chunk < len(item):
                    chunk *= 2
                passages = [w[a : a + 2 * chunk] for a in range(0, len(w), chunk)]
                ok = False
                for p in passages:
                    score = sum(x for t, x in weights[k].items() if t in set(p))
                    ok |= score >= 0.5 and min(decontaminate.overlaps([hash(x) for x in item], [hash(x) for x in p])) >= 0.5
            if ok:
                want.append((d, k))
    got = decontaminate.find_leaks(df, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    monkeypatch.setattr(decontaminate, "BOUND_CELLS", 50)
    monkeypatch.setattr(decontaminate, "SCORE_CELLS", 50)
    hits = decontaminate.search(decontaminate.build_index([(k, " ".join(w)) for k, w in items]), pa.array([" ".join(w) for _, w in docs]))
    assert sorted((docs[r][0], k) for r, k, *_ in hits) == sorted(want)
    left = decontaminate.drop_leaks(df, bench).collect()
    assert sorted(r.doc_id for r in left) == sorted([d for d, _ in docs if d not in {x for x, _ in want}] + [300, 301])


def test_scripts_without_spaces_are_searched():
    item = "東京の天気は今日も晴れですか。はい、晴れです。"
    index = decontaminate.build_index([(1, item), (2, "an item of plain english words, with its answer")])
    hits = decontaminate.search(index, pa.array(["前置き" + item + "後書きが続く", "東京", None]))
    assert [(r, i) for r, i, *_ in hits] == [(0, 1)]


@pytest.mark.parametrize("cell_bits, cell_bytes, part_bytes", [(24, 1 << 28, 1 << 25), (4, 3000, 2000), (1, 1 << 28, 500)])
def test_a_full_sketch_loses_no_repeat(spark, cell_bits, cell_bytes, part_bytes):
    rng = random.Random(11)
    shared = [" ".join(f"p{k}.{j}" for j in range(rng.randint(20, 60))) for k in range(5)]
    rows = []
    for d in range(90):
        parts = [" ".join(f"u{d}.{j}" for j in range(rng.randint(0, 80)))] + rng.sample(shared, rng.choice([0, 0, 1, 2]))
        rng.shuffle(parts)
        rows.append((d, " \n".join(parts), "x", 1))
    rows += [(None, rows[0][1], "n", 2), (None, rows[1][1], "n", 3), (5, rows[5][1], "again", 4), (300, None, "null", 5), (301, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_words int").repartition(6)
    first = {}
    for d, t, *_ in rows:
        w = (t or "").split()
        for i in range(len(w) - 19):
            at = (d is None, d or 0, i)
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), at), at)
    want = []
    for d, t, name, _ in rows:
        w = (t or "").split()
        gone = {k for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (d is None, d or 0, i) for k in range(i, i + 20)}
        want.append((str(d), str(name), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.remove_repeats(docs, keep=["kept_text"], cell_bits=cell_bits, cell_bytes=cell_bytes, part_bytes=part_bytes)
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in got.collect()) == sorted(want)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_bags_by_pieces_are_the_same_bags(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 40)
    monkeypatch.setattr(toxicity, "FEATURE_WORDS", 3)
    for texts in ([], [""], ["Ein Wort", "", "word wörter words " * 9, "ein word.two", "", "wo"] * 3, ["a b"] * 50 + [""]):
        got, want = toxicity.bags_by_pieces(texts, 16), toxicity.bags_of(pa.array(texts, pa.large_string()), 16)
        assert all(np.array_equal(a, b) for a, b in ((got.ids, want.ids), (got.first, want.first), (got.features, want.features)))


def test_bagging_a_sample_holds_few_bytes_a_word():
    import tracemalloc

    texts = [" ".join(f"w{(31 * k + j) % 5000}" for j in range(20)) for k in range(30_000)]
    tracemalloc.start()
    bags = toxicity.bags_by_pieces(texts, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bags.ids) == 600_000 and peak < 40 * 600_000  # bags_of all at once takes more than 60 bytes a word


def test_training_gives_free_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1))
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c d", "en")], "doc_id long, text string, lang string")
    toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True))
    assert given
