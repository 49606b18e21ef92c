import json

from pyspark.sql import functions as F

from corpuslens import schema
from corpuslens.sources import effects, readers, sinks


def fake_api(query, window, page):
    return [(f"http://x/{query}/{window}/{page}", "t", "")] if page < 3 else []


def test_article_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u1", "title": "first"}, {"url": "u2", "title": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"url": "u1", "title": "second"}]))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps({"error": "no list"}))
    got = {r.url: r.title for r in readers.article_files(spark, str(tmp_path)).collect()}
    assert got == {"u1": "first", "u2": "x"}


def test_annotations_and_sniffed_csv(spark, tmp_path):
    head = "article_id,framing_description,position_types,register,embedded_assumptions,human_agrees_with_llm,annotator_notes,language\n"
    (tmp_path / "a.csv").write_text(head + '1,"d, e",b; a;b,r,,agree,,en\n1,last,c,r,x;,partial,,en\n')
    r = readers.annotations(spark, str(tmp_path / "a.csv")).first()
    assert (r.framing_description, r.position_types, r.embedded_assumptions) == ("last", ["c"], ["x"])
    (tmp_path / "t.tsv").write_text("name\tn\na\t5\nb\tbad\nc\t\n")
    got = readers.sniffed_csv(spark, str(tmp_path / "t.tsv"), "name string, n long", ["n"]).collect()
    assert {x.name: x.n for x in got} == {"a": 5, "b": 1, "c": 0}


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>l1</link></item><item><title>B</title><link>l2</link></item></channel></rss>"
    atom = '<feed><entry><title>C</title><link href="l3"/></entry></feed>'
    got = readers.feed_items(spark.createDataFrame([("r", rss), ("a", atom)], "doc string, xml string")).collect()
    assert {(x.doc, x.title, x.link) for x in got} == {("r", "A", "l1"), ("r", "B", "l2"), ("a", "C", "l3")}


def test_topic_needs_its_keys():
    import pytest

    assert readers.topic("name: n\nslug: s\nwindows: {w1: {start: a}}\nqueries: {q: [x]}\nother: 1").more == {"other": 1}
    with pytest.raises(ValueError):
        readers.topic("name: n")


def test_institutional_entities_and_logs(spark):
    rec = json.dumps({"doc_id": "d", "chair": {"position_summary": "c"}, "country_positions": [{"country": "A", "position_summary": "x"}, {"country": "B"}]})
    df = spark.createDataFrame([(rec,)], "j string").select(F.from_json("j", schema.INSTITUTIONAL).alias("r")).select("r.*")
    assert {r.country for r in readers.institutional_articles(df).collect()} == {"A", "B", "chair"}
    bodies = [('[{"name": "a", "doc_count": "3"}]',), ('{"data": [{"title": "b"}]}',), ("{}",)]
    assert {(r.name, r.doc_mentions) for r in readers.entities(spark.createDataFrame(bodies, "body string")).collect()} == {("a", 3), ("b", 0)}
    log = spark.createDataFrame([("l", 1, "get http://x/1"), ("l", 2, "Failed: 404"), ("l", 3, "get http://x/2"), ("l", 4, "ok")], "log string, pos int, value string")
    assert [r.url for r in readers.failed_urls(log).collect()] == ["http://x/1"]


def test_paged_api(spark):
    spark.dataSource.register(readers.PagedApi)
    df = spark.read.format("paged_api").option("client", "test_sources:fake_api").option("queries", "a|b").option("windows", "w1").load()
    assert df.schema.names == ["query", "window", "url", "title", "published"]
    reader = readers._PagedReader({"client": f"{__name__}:fake_api", "queries": "a|b", "windows": "w1"})
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 4


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_run(spark.range(3), path, "r1") and not sinks.write_run(spark.range(9), path, "r1")
    assert sinks.write_run(spark.range(5), path, "r2") and sinks.latest_run(spark, path).count() == 5
    new = str(tmp_path / "n")
    assert sinks.append_new(spark.range(3), new, ["id"]) == 3 and sinks.append_new(spark.range(5), new, ["id"]) == 2
    sinks.csv_sample(spark.range(2).select("id", F.lit("abcdef").alias("x")), str(tmp_path / "c"), {"x": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().x == "abc"
    assert "<td>1</td>" in sinks.html_table(spark.range(2), "a < b")


def test_effects(spark):
    df = spark.createDataFrame([("the house and the garden of that man",), ("der hund und die katze von nebenan",), ("x",)], "t string")
    assert all("primary_frame" in r.answer for r in effects.complete(df, "t", effects.echo_client).collect())

    def broken(_):
        raise RuntimeError

    assert all(r.answer is None for r in effects.complete(df, "t", broken).collect())
    v = [r.embedding for r in effects.embed(df, "t").collect()]
    assert all(abs(sum(x * x for x in e) - 1) < 1e-9 for e in v)
    pair = spark.createDataFrame([("a b c", "a b d"), ("", "x")], "a string, b string")
    assert [round(r[0], 4) for r in pair.select(effects.token_f1("a", "b")).collect()] == [0.6667, 0]
