"""Each operator against a brute-force version, on small tables full of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import chat, decontaminate, html, lm, mixing, quality, simhash, substrings, tokens, toxicity
from corpuslens.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, `key` string"


def awkward(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Anéa", "x", "日本", "ion", "Ütz", "a,b", "#tag", "e" * 40]
    passage = " ".join(rng.choice(vocabulary) + str(k % 7) for k in range(45))
    rows = []
    for i in range(n):
        t = rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))
        if i % 6 == 0:
            t = f"{t} {passage} {t[:20]}"
        if i % 10 == 3:
            t = rows[-1][1]
        rows.append((i, t, "en", f"s{i % 4}" if i % 9 else None))
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \n\t ", "de", "s1"), (203, "word " * 3000, "en", "s2"), (204, "y" * 20000, "fr", "s3"), (0, rows[0][1], "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), 1, 0.5, "k") for r in awkward()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def test_targets_are_filled():
    got = mixing.fill_targets([100, 10, 100], [5, 2, 1], 1.5, 2)
    assert got[1] == pytest.approx(20) and got.sum() == pytest.approx(315) and (got <= [200, 20, 200]).all()


def test_permutation_and_quotas():
    for n in (1, 2, 7, 100):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))
    q = np.array([100, 3, 0, 57])
    deal = mixing.split_quotas(q, 7, 1)
    assert (deal.sum(axis=0) == q).all() and np.ptp(deal.sum(axis=1)) <= 3


def test_mixing(spark, docs, empty):
    got = mixing.taken_words(mixing.mix(docs, block_words=16, shards=5)).collect()
    size = Counter()
    for r in awkward():
        size[r[3]] += len(words(r[1]))
    assert len(got) == len(awkward())
    names = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(names, mixing.fill_targets([size[s] for s in names], mixing.cyclic_weights(len(names)), 1.5, 2)))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.taken_words(mixing.mix(docs.repartition(7), block_words=16, shards=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_mixed_texts_hold_the_drawn_words(docs):
    took = mixing.mix(docs, block_words=16, shards=5).select(F.sum(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"]))).first()[0]
    got = mixing.mix_texts(docs, block_words=16, shards=5).collect()
    assert sum(r.n_words for r in got) == took and all(len(words(r.text)) == r.n_words for r in got)


def test_token_counts(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    parts = ["a", "ab", " ", "  ", "\n", "▁", "é", "日本", "<s>", "</s>", "<unk>", "<0x0A>", "the", "ing", "xx", "\x00", "😀", "12", "er", "S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 5000, " " * 300, ""]
    v = tokens.read_vocabulary(open(path, "rb").read())
    assert tokens.token_counts(v, pa.array(texts)).tolist() == [len(x) for x in sp.encode(texts)]
    got = tokens.count_tokens(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in got) == Counter((r[0], len(sp.encode(r[1] or "")), len((r[1] or "").encode())) for r in awkward())
    assert tokens.count_tokens(empty, path).count() == 0


def test_quality_measures(docs, empty):
    def brute(t):
        w, lines, seen, dup = words(t), [x for x in (t or "").split("\n") if words(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside), failed

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    assert got == Counter((r[0], *brute(r[1])) for r in awkward())
    assert all(not r.kept for r in quality.judge(docs).where("base_failed").collect())
    assert quality.judge(empty).count() == 0


def test_simhash_components(docs, empty):
    import xxhash

    def fingerprint(t):
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r[0], fingerprint(r[1])) for r in awkward()]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(d, least.get(c, d))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert Counter((r.doc_id, int(r.f, 16), r.component_id) for r in got) == Counter((d, f, least[c]) for (d, f), c in zip(rows, comp))
    kept = simhash.one_of_each(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_dense_and_of_a_small_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for b in base]))
    i, j = simhash.links(np.zeros(len(fp), int), fp, fp[:8], 4)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 4).all()
    roots = list(range(len(fp)))
    find = lambda x: x if roots[x] == x else find(roots[x])
    for a, b in zip(i, j):
        roots[find(a)] = find(b)
    assert len({find(x) for x in range(len(fp))}) == 4


def test_hot_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)
    nodes = spark.range(1, 60).select((F.col("id") * F.col("id") % 61).alias("node")).distinct().withColumn("f0", F.col("node"))
    edges = [(r.u, r.v) for r in simhash.near_links(nodes, bits=4).collect()]
    assert edges and all((u ^ v).bit_count() <= 4 for u, v in edges)


def test_substring_dedup(docs, empty, spark):
    def brute(rows):
        first, out = {}, Counter()
        for d, t in rows:
            w = words(t)
            for i in range(len(w) - 19):
                k = tuple(w[i : i + 20])
                first[k] = min(first.get(k, (d, i)), (d, i))
        for d, t in rows:
            w = words(t)
            gone = {k for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (d, i) for k in range(i, i + 20)}
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        return out

    got = substrings.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == brute([(r[0], r[1]) for r in awkward()])
    assert substrings.remove_repeats(empty).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["\\", "### ", "</turn>", "\n", "User:", "a", " ", ":\n"]) for _ in range(rng.randint(0, 12)))
        role = rng.choice(["user", "assistant", "system", "", "User", "a b\n:", "é"])
        assert chat.parse(chat.render_turn(role, t) * 2) == [(role, t)] * 2
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "### </turn> \\"), (1, 0, "system", None), (2, 1, None, "x"), (None, 1, "assistant", ""), (1, 2, "assistant", "### </turn> \\")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    turns = [("system", ""), ("user", "hi"), ("assistant", "### </turn> \\"), ("assistant", "### </turn> \\")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"### </turn> \\" * 2).hexdigest() and got[1].loss_chars == 26
    assert got[None].n_turns == 1 and got[2].n_turns == 1
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50)))) for k in range(60)] + [(90, None), (91, ""), (92, "a b"), (93, None)]
    texts, planted = [], set()
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            k = rng.randrange(60)
            at = rng.randint(0, len(w))
            w[at:at] = (items[k][1].upper() if d % 2 else items[k][1]).split()
            planted.add((d, k))
        texts.append((d, " ".join(w)))
    docs = spark.createDataFrame([*texts, (500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    clean = decontaminate.drop_leaks(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in planted} | {500, 501}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0


def test_language_model_scores(spark, docs, empty):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    toks = lambda t: [w.encode().translate(low) for w in words(t)] + [b"\n"]
    trains = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    count = Counter(w for r in awkward() if trains(r[0]) for w in toks(r[1]))
    n, v = sum(count.values()), len(count)
    from corpuslens.llm.common import bucket_of

    got = lm.score_texts(docs, bucket_of("doc_id", 10) != 0).collect()
    want = sorted((r[0], len(toks(r[1])), sum(w in count for w in toks(r[1])), sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(r[1]))) for r in awkward())
    for a, b in zip(sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    assert all(r.base_score == 0 for r in lm.score_texts(docs.limit(3), F.lit(False)).collect())


def test_tree_probabilities_sum_to_one():
    from corpuslens.llm.common import words_of

    g, _ = lm.grams(*lm.plain_text(words_of(pa.array(["abracadabra abra", "cabra"]))))
    keys, n = np.unique(g, return_counts=True)
    tree = lm.Tree(keys, np.full(len(keys), lm.DEPTH), n)
    for ctx in (int(keys[0]) >> 8, int.from_bytes(b"zzzzz", "big"), int.from_bytes(b"zzabr", "big")):
        every = np.array([ctx << 8 | y for y in range(256)], np.uint64)
        assert (10 ** tree.log10(every)).sum() == pytest.approx(1)


def test_html_extraction(spark):
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=/>menu</a></nav>
    <div id=main><h1>Head &amp; more</h1><p>One, two <b>th</b>ree.<p>Four<br>five &lt;six&gt;.<script>var x="</p>";</script></div>
    <div class="cookie-notice">We use cookies, yes, many, of them.</div><div id="comments"><p>Nice, nice, nice text this is.</p></div><footer>f</footer>"""
    assert html.main_text(page) == "Head & more One, two three. Four five <six>."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.n_chars for r in html.extract(df).collect()} == {1: 44, 2: 0}


def test_toxicity_learns_and_keeps_contract(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for d in range(600):
        w, bad = [word() for _ in range(rng.randint(5, 60))], d % 5 == 0
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["vilex", "vilexes", "grubbo"]))
        rows.append((d, " ".join(w), "en", int(bad)))
    docs = spark.createDataFrame([(d, t, l) for d, t, l, _ in rows] + [(900, None, None), (901, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows] + [(900, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[d] >= 0.7) == bool(y) for d, _, _, y in rows if d % 3 == 1]
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values()) and np.mean(held) > 0.95
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r.score == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.train(docs, labels.limit(0), F.lit(True)).constant == 0


def test_every_operator_is_registered():
    names = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
