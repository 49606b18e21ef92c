"""Queries over texts with unusual white space and letters beside digits against their SQL."""

import random

import duckdb
import pytest

from corpuslens.plans.registry import oracle_sql, queries

PARTS = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\xa0", "\u3000", "\u2003", "\u200b", "\x85", "\u2028", "\x1c", "a", "é", "ß", "12", "7", "٣", "_", "-", ".", "!", "“", '"', "日本", "was", "que"]
PARTS += [" was ", " que ", " this ", " und ", " the ", "\u0301", "😀", "word word word word word word word"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("odd")
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [x + "y" * n + x + "\n1" + x + "2 was " for x in PARTS for n in (29, 30, 50)]
    langs, sources = ["en", "\u3000", " ", None], ["a", "\xa0", "b\u2003"]
    rows = [(i, t, langs[i % 4], sources[i % 3]) for i, t in enumerate(texts)] + [(len(texts), None, "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert plain(queries()[name](spark, sf).select(*columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", ["elaboration_ratio", "min_length_and_title", "first_nonblank_tier", "corpus_distincts", "actor_vocabulary_scores", "concessive_constructions"])
def test_all_space_separators_are_trimmed(spark, sf, name):
    same(spark, sf, name)


@pytest.mark.parametrize("name", ["text_counts", "sentence_asymmetry"])
def test_numbers_end_at_ascii_words(spark, sf, name):
    same(spark, sf, name)


def test_years_beyond_9999_have_no_sign(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select r::bigint event_id, timestamp '2024-01-05 01:02:03' + to_days((r // 2)::int) ts from (select unnest([0, 1, 2, 3, 2913221, 2913222, 2913223, 5999999, 35999999]) r)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(oracle_sql()["epoch_duration_bounds"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, queries()["epoch_duration_bounds"](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())
