"""The stages one by one, and the whole, on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpuslens.llm import decontaminate, simhash
from corpuslens.llm.common import durable_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
STAGE = dict(P.STAGES)
RNG = random.Random(12)


def word():
    return "".join(RNG.choice(["th", "er", "on", "an", "re", "st", "ou"]) for _ in range(RNG.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


PASSAGE, ITEM = prose(60), prose(30)


@pytest.fixture(scope="module")
def rows():
    out = []
    for d in range(240):
        t = prose(RNG.randint(20, 120))
        if d % 10 == 1:
            t += " vilex grubbo vilex " + prose(5)
        if d in (40, 41, 42):
            t = out[0][1]  # exact copies
        if d == 43:
            w = out[2][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if d in (50, 51, 52):
            t = f"{t} {PASSAGE} {prose(10)}"
        if d == 60:
            t = f"{t} {ITEM.upper()} {prose(10)}"
        out.append((d, t, RNG.choice(["en", "de", None]), f"s{d % 3}" if d % 7 else None, len(t), 1.0, "x"))
    out += [(500, None, None, None, None, None, None), (501, "", "en", "s0", 0, 1.0, "x"), (502, " \n\t", "en", "s1", 3, 1.0, "x"), (None, prose(40), "en", "s1", 3, 1.0, "x"), (503, "word " * 4000, "en", "s2", 9, 1.0, "x")]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int("vilex" in (t or ""))) for d, t, *_ in rows if d is not None and d < 500] + [(None, 1), (500, None), (501, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_toxic_documents_go(spark, sf, docs, rows):
    out = STAGE["toxicity"](spark, docs, sf)
    assert out.columns == P.COLUMNS
    left = [r.text for r in out.collect()]
    clean = [t for _, t, *_ in rows if "vilex" not in (t or "")]
    assert sum("vilex" in (t or "") for t in left) <= 2 and len(left) >= len(clean) - 3


def test_one_of_near_copies_stays(spark, sf, docs, rows):
    out = STAGE["simhash_near_dedup"](spark, docs, sf)
    assert out.columns == P.COLUMNS
    left = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert left == sorted({d for d, *_ in rows if d is not None} - {40, 41, 42, 43, 501, 502})  # 500 stands for the texts without a word
    assert out.count() == len(left) + 1


def test_repeats_are_cut(spark, sf, docs):
    out = STAGE["substring_dedup"](spark, docs, sf)
    assert out.columns == P.COLUMNS
    left = {r.doc_id: r for r in out.collect()}
    assert PASSAGE in left[50].text and PASSAGE not in left[51].text and PASSAGE not in left[52].text
    assert not {40, 41, 42} & set(left) and {500, 501, 502} <= set(left) and left[500].text == ""
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_leaks_go(spark, sf, docs, rows):
    out = STAGE["decontamination"](spark, docs, sf)
    assert out.columns == P.COLUMNS
    assert out.count() == len(rows) - 1 and out.where("doc_id = 60").count() == 0


def test_the_mix_is_made_of_the_documents(spark, sf, docs, rows):
    out = STAGE["mixing"](spark, docs, sf).collect()
    texts = {d: " ".join((t or "").split()) for d, t, *_ in rows}
    assert all(" ".join(r.text.split()) in texts[r.doc_id] for r in out)
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    assert abs(sum(r.n_words for r in out) - 1.5 * sum(size.values())) < 10


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_an_empty_table(spark, sf, docs, name):
    assert STAGE[name](spark, docs.limit(0), sf).count() == 0


def test_the_whole(spark, sf, rows):
    out = P.run(spark, sf)
    got = out.collect()
    assert got and not any("vilex" in r.text for r in got) and not any(ITEM.upper() in r.text for r in got)
    assert not {40, 41, 42, 43, 60} & {r.doc_id for r in got}
    assert sorted(map(str, got)) == sorted(map(str, P.run(spark, sf).collect()))
    fs = spark._jvm.org.apache.hadoop.fs.Path(durable_path(spark))
    left = [str(f.getPath()) for f in fs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(durable_path(spark) + "/pipeline-*/*"))]
    assert left and all("3-decontamination" in p for p in left)  # only the last stage's input


def test_near_copies_by_shingle_similarity(spark):
    """Recall over pairs of planted similarity; texts without a planted copy are left alone."""
    rng = random.Random(3)
    words = [prose(1) for _ in range(3000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, similar = [], {}
    for d in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        rows.append((d, " ".join(w)))
        v = list(w)
        for _ in range(rng.randint(0, len(w) // 14)):
            v[rng.randrange(len(v))] = "new" + str(rng.random())
        a, b = shingles(w), shingles(v)
        similar[d] = len(a & b) / len(a | b)
        rows.append((1000 + d, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8, shingle=5).collect()}
    assert set(range(300)) <= left
    near = [d for d, s in similar.items() if s >= 0.8]
    far = [d for d, s in similar.items() if s < 0.8]
    assert len(near) > 100 and len(far) > 50
    assert sum(1000 + d not in left for d in near) / len(near) > 0.97
    assert all(1000 + d in left for d in far)


def test_leaks_are_found_before_and_after_a_split(spark, sf, docs, monkeypatch):
    whole = decontaminate.drop_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")).count()
    monkeypatch.setattr(decontaminate, "MAX_PART_BYTES", 10)
    assert decontaminate.drop_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")).count() == whole
    assert docs.where(F.col("doc_id") == 60).count() == 1
