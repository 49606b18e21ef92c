"""Near copies in clusters stay together; benchmark items without an id or with a shared one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, simhash

WORDS = [f"w{i}" for i in range(20000)]


def copies(rng, n):
    base = [rng.choice(WORDS) for _ in range(300)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(300)] = rng.choice(WORDS)
        out.append(t)
    return out


def similarity(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size, n", [(2, 500), (5, 500), (5, 3000), (50, 500)])
def test_similar_texts_share_a_component(spark, size, n):
    rng = random.Random(size * n)
    families = [copies(rng, size) for _ in range(n // size)]
    rows = [(f * size + k, " ".join(t)) for f, family in enumerate(families) for k, t in enumerate(family)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text")).repartition(4)
    marked = simhash.durable(simhash.fingerprint_table(df, shingle=5, wide=True, keep=["row"]))
    classes, _ = simhash._classes(marked, simhash.radius(0.8), lambda found: simhash.similar_links(found, marked, df.select("row", "text"), 0.8, 5, 42))
    root = {r.doc_id: r.root for r in marked.join(classes, "node").select("doc_id", "root").collect()}
    pairs = lost = 0
    for f, family in enumerate(families[:120]):
        for a, b in itertools.combinations(range(size), 2):
            if similarity(family[a], family[b]) >= 0.8:
                pairs, lost = pairs + 1, lost + (root[f * size + a] != root[f * size + b])
    assert pairs > 50 and lost <= 0.05 * pairs


def test_links_to_the_nearest_are_kept():
    import numpy as np

    fp = np.array([[0], [1], [3], [7], [15]], np.uint64)
    i, j = simhash.links(np.zeros(5, np.int64), fp, fp, 4, nearest=8)
    assert len(i) == 10  # all pairs; the forest has 4
    assert len(simhash.links(np.zeros(5, np.int64), fp, fp, 4)[0]) == 4


def test_items_without_ids_and_with_one_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    items = spark.createDataFrame([(None, one), (None, two), (5, three), (5, one), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{two} z {three}"), (3, "clean words only"), (None, three)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in decontaminate.find_leaks(docs, items).collect()))
    assert got == [(0, 5), (1, 0), (1, 5), (2, 0), (2, 5)]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()] == [3]


def test_no_pair_that_meets_is_left_out_of_a_large_group(spark):
    """700 copies that are all close; only the link between the two that are farthest apart holds."""
    import numpy as np

    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for d in range(700):
        t = list(base)
        for k in rng.sample(range(60), rng.randint(1, 3)):
            t[k] = rng.choice(WORDS)
        rows.append((d, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text")).repartition(4)
    marked = simhash.durable(simhash.fingerprint_table(df, shingle=5, wide=True, keep=["row"]))
    bits = simhash.radius(0.8)
    nodes = marked.dropDuplicates(["node"]).select("node", *(f"f{k}" for k in range(4))).collect()
    fp = np.array([r[1:] for r in nodes], np.int64).view(np.uint64)
    set_ = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
    met = np.zeros((len(fp), len(fp)), bool)
    for places in simhash.bit_samples(len(fp), bits):
        key = set_[:, places].astype(np.int64) @ (1 << np.arange(len(places)))
        met |= key[:, None] == key[None]
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    i, j = np.unravel_index(np.argmax(np.where(met & (far <= bits), far, 0)), far.shape)
    one, two = sorted((nodes[i].node, nodes[j].node))
    holds = lambda found: found.where((F.least("u", "v") == one) & (F.greatest("u", "v") == two))
    classes, _ = simhash._classes(marked, bits, holds)
    together = {r.node for r in classes.where(F.col("root") == one).collect()}
    assert together == {one, two} and classes.select("root").distinct().count() == len(nodes) - 1


def test_marks_lose_no_similar_pair():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(t) for n in (3, 9, 40, 400) for t in copies(rng, 12) for t in [t[: n + rng.randint(0, 2)]]] + ["", "one"]
    marks = np.stack([np.asarray(m).astype(np.uint64) for m in simhash.shingle_marks(pa.array(texts), 5)], axis=1)
    doc, key = simhash.shingle_sets(pa.array(texts), 5, 42)
    sets = [set(key[doc == d].tolist()) for d in range(len(texts))]
    i, j = np.triu_indices(len(texts), 1)
    for at in (0.5, 0.8, 1.0):
        may = simhash.may_have(marks, i, j, at)
        similar = np.array([len(sets[a] & sets[b]) >= at * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)])
        assert may[similar].all() and not may.all()
