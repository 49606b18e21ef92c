"""Keyed state over micro-batches and restarts, versioned ingest, learned languages, cluster rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import aggregates as A
from corpuslens.operators import clustering as C
from corpuslens.operators import language as L
from corpuslens.operators import relational as R
from corpuslens.streaming import stateful as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def batches(spark, folder, parts):
    """Events dealt by time into files, one after the other."""
    e = spark.read.parquet(EVENTS).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = e.orderBy("ts", "event_id").toPandas()
    for k, at in enumerate(parts):
        lo = 0 if k == 0 else int(len(rows) * parts[k - 1])
        yield spark.createDataFrame(rows.iloc[lo : int(len(rows) * at)]).coalesce(1)


def test_a_cut_holds_over_micro_batches_and_a_restart(spark, tmp_path):
    e = spark.read.parquet(EVENTS).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))

    def run():
        rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = S.circuit_breaker(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "click", 2, "ts", idle=timedelta(days=3650))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    parts = list(batches(spark, tmp_path, [0.3, 0.5, 0.8, 1.0]))
    for df in parts[:2]:
        df.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    for df in parts[2:]:
        df.write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = spark.read.parquet(f"{tmp_path}/out").select("user_id", "event_id", "streak").collect()
    want = R.circuit_breaker(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", 2).select("user_id", "event_id", F.col("streak").cast("long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) < e.count()


def test_idle_keys_are_forgotten(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    schema = "k string, id int, failed boolean, ts timestamp"
    files = [[("a", 1, True, day(0)), ("a", 2, True, day(0)), ("a", 3, False, day(1))], [("b", 4, False, day(50))], [("b", 5, None, day(51))], [("a", 6, False, day(52)), ("b", 7, True, day(52))]]

    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = S.circuit_breaker(rows, "k", ["ts", "id"], F.col("failed"), 2, "ts", watermark="1 day", idle=timedelta(days=10))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    assert sorted((r.id, r.streak) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1), (2, 2), (4, 0), (5, 0), (6, 0), (7, 1)]


def test_versions(spark, tmp_path):
    schema = "url string, n int"
    path, state = f"{tmp_path}/table", f"{tmp_path}/state"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, state, ["url"], ["n"])

    read = lambda v=None: sorted((r.url, r.n, r.corpus_version) for r in S.read_version(spark, path, schema, v).collect())
    assert read() == []
    add(("u1", 1), ("u1", 2), ("u2", 3), (None, 4))
    add(("u2", 9), ("u3", 5))
    assert read() == [("u1", 1, 1), ("u2", 3, 1), ("u3", 5, 2)] and read(1) == [("u1", 1, 1), ("u2", 3, 1)]
    names = S.versions(spark, path)
    again = spark.createDataFrame([("u9", 9)], schema)
    assert S.commit(again, path, names[2], ["url"], ["n"]) is None and len(read()) == 3  # a replayed batch adds nothing
    again.write.parquet(f"{path}/corpus_version=3")  # broke off before its entry in the ledger: not read, written anew
    assert len(read()) == 3
    assert S.commit(spark.createDataFrame([("u4", 4)], schema), path, "other-0", ["url"], ["n"]) == 3 and read()[-1] == ("u4", 4, 3) and len(read()) == 4
    S.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, f"{state}2", ["url"], ["n"])  # a new checkpoint reads all again
    assert len(read()) == 4


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) >= 200")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = L.learn(docs.where(fold != 0), "text", "lang")
    got = L.detect(docs.where(fold == 0), "text", model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("language")).cast("int")).alias("right"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(r.right >= 0.9 for r in got), got


def test_languages_of_short_and_odd_texts(spark):
    rows = [("de", "der Hund und die Katze von nebenan schlafen heute"), ("en", "the house and the garden of that man were sold")] * 5
    model = L.learn(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    df = spark.createDataFrame([("die Katze und der Hund von nebenan",), ("the man and the garden of the house",), (None,), ("der Hund",), ("1234567890 1234567890 123",), ("die Katze " * 100000,)], "text string")
    assert [r.language for r in L.detect(df, "text", model).collect()] == ["de", "en", "en", "en", "en", "de"]
    empty = L.learn(spark.createDataFrame([], "lang string, text string"), "text", "lang")
    assert {r.language for r in L.detect(df, "text", empty, default="xx").collect()} == {"xx"}


def test_transfer_rate(spark):
    pairs = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.2), (1, 0, 0.8), (1, 1, 0.75), (2, 0, 0.1), (2, 1, 0.3)], "a long, b long, similarity double")
    r = C.transfer_rate(C.transfer(pairs)).first()
    assert (r.transferred, r.clusters, r["rate"]) == (2, 3, pytest.approx(2 / 3))
    assert C.transfer_rate(C.transfer(pairs).limit(0)).first()["rate"] == 0


def test_composition_leaves_noise_out(spark):
    rows = [(1, 2, "en", "Second words: strike strike"), (1, 1, "fr", "About the first, strike frame"), (1, 3, None, None), (-1, 4, "en", "noise"), (2, 5, "de", "the of"), (None, 6, "en", "none")]
    df = spark.createDataFrame(rows, "c int, p int, lang string, text string")
    got = {r.c: r for r in A.composition(df, "c", "p", "lang", "text").collect()}
    assert set(got) == {1, 2} and got[1].size == 3 and got[1].share == 0.5
    assert [tuple(x) for x in got[1].top_languages] == [("fr", 1), ("en", 1), ("??", 1)]
    assert got[1].keywords == ["strike", "first", "frame", "second", "words"] and got[1].representative == "About the first, strike frame" and got[2].keywords == []


def test_languages_are_told_in_bounded_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").coalesce(1)
    most, runs = [], L._runs
    model = L.learn(docs, "text", "lang")
    want = sorted((r.doc_id, r.language) for r in L.detect(docs, "text", model).collect())
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 7)
    again = L.learn(docs, "text", "lang")
    assert again.names == model.names and (again.logs == model.logs).all()
    assert sorted((r.doc_id, r.language) for r in L.detect(docs, "text", model).collect()) == want
    monkeypatch.setattr(L, "_runs", lambda texts: most.append(len(texts)) or runs(texts))
    import pandas as pd

    L.tell_all(pd.Series(["der Hund und die Katze laufen"] * 30), model.names, model.logs, "en")
    assert max(most) == 7
