"""Readers, page functions, record dialects, sinks and seams on worked cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import pages as P
from corpuslens.functions import text as X
from corpuslens.sources import dialects, effects, readers, sinks


def test_feed_items_keep_their_fields_together(spark):
    rss = "<rss><channel><title>feed</title><item><title>A</title></item><item><title>B</title><link> lB </link><pubDate>d</pubDate></item><item><link>lX</link></item><item><title>C &amp; D</title><link>lC</link><description><![CDATA[<b>x</b>]]></description></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">E</title><link href="lE" rel="alternate"/><link href="other"/><updated>u</updated></entry><entry><title>F</title></entry><entry><title>G</title><link href="lG"/><published>p</published><updated>u</updated></entry></feed>'
    both = '<rss><channel><item><title>only title</title></item></channel></rss>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("b", both), ("bad", "<rss><chan"), ("null", None), ("empty", "")], "doc string, xml string")
    got = {(r.doc, r.title, r.link, r.published) for r in readers.feed_items(df).collect()}
    assert got == {("r", "B", "lB", "d"), ("r", "C & D", "lC", ""), ("a", "E", "lE", "u"), ("a", "G", "lG", "p")}
    assert {r.description for r in readers.feed_items(df).where("title = 'C & D'").collect()} == {"<b>x</b>"}


def test_podcast_items(spark):
    xml = """<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>
      <item><title>A</title><link>l</link><enclosure url="a.mp3" type="audio/mpeg"/><itunes:duration>1:02:03</itunes:duration></item>
      <item><title>B</title><enclosure url="b.mp3"/><itunes:duration>12:34</itunes:duration></item>
      <item><title>C</title><link>l</link><enclosure url="c.mp4" type="video/mp4"/></item>
      <item><title>D</title><link>l</link></item><item><enclosure url="e.mp3" type="audio/mpeg"/></item></channel></rss>"""
    got = [tuple(r) for r in readers.podcast_items(spark.createDataFrame([("p", xml)], "doc string, xml string")).select("title", "url", "audio_url", "duration_text", "duration_seconds").orderBy("title").collect()]
    assert got == [("A", "l", "a.mp3", "1:02:03", 3723), ("B", "b.mp3", "b.mp3", "12:34", 754)]


def test_chat_messages(spark):
    block = lambda text, extra="", tail="": f'<div class="tgme_widget_message_wrap js"><div {extra}><div class="tgme_widget_message_text js" dir="auto">{text}</div>{tail}</div></div>'
    page = "head" + block("too short") + "".join(block(f"message number {k} <b>is</b>\n long enough", f'data-post="chan/{k}"' if k else "", f'<time datetime="2024-05-0{k + 1}T10:00:00+00:00">') for k in range(4)) + '<div class="tgme_widget_message_wrap"><div>photo</div></div>'
    df = spark.createDataFrame([(page,), ("nothing",), ("",), (None,)], "html string")
    got = [r[0] for r in df.select(P.chat_messages("html", F.lit("chan"), last=3)).collect()]
    assert [(m.text, m.date[:10], m.url) for m in got[0]] == [(f"message number {k} is long enough", f"2024-05-0{k + 1}", f"https://t.me/chan/{k}") for k in (1, 2, 3)]
    assert got[1] == got[2] == [] and not got[3]
    assert df.select(P.chat_messages("html", F.lit("chan"))).first()[0][0].url == "https://t.me/s/chan"


def test_page_links(spark):
    page = """<a class=x href="/news/one">The strait is closed <b>again</b></a><a href="https://other.example/a">The strait from elsewhere</a><a href="/topics/x">The strait as a topic</a>
    <a href="mailto:x">The strait by letter post</a><a href="https://site.example/two">Nothing of interest here</a><a href="/news/one">The strait, a second link</a><a href="/s">strait</a>"""
    df = spark.createDataFrame([(page, "https://site.example/front"), (None, "https://x")], "html string, url string")
    got = [r[0] for r in df.select(P.page_links("html", "url", wanted=["strait"])).collect()]
    assert [(x.url, x.title) for x in got[0]] == [("https://site.example/news/one", "The strait is closed again")] and not got[1]
    some = df.select(P.sermon_links("html", "url", ["topic"], ["elsewhere"])).first()[0]
    assert [x.url for x in some] == ["https://other.example/a", "https://site.example/topics/x"]


def test_forum_comments(spark):
    child = lambda body, kind="t1", score=None: {"kind": kind, "data": {"body": body, **({"score": score} if score is not None else {})}}
    answer = [{"data": {"children": [child("the post itself, which is no comment")]}}, {"data": {"children": [child("[deleted]"), child("short"), child("a comment that is long enough", score=5), child("x" * 3000), child("a listing that goes on and on", "more"), child("a third one that is past the limit")]}}]
    got = [r[0] for r in spark.createDataFrame([(json.dumps(answer),), ("[]",), ("no json",), (None,)], "a string").select(P.forum_comments("a", 2)).collect()]
    assert [(len(c.body), c.score) for c in got[0]] == [(29, 5), (2000, 0)] and got[1:] == [[], [], []]


def test_archive_snapshot(spark):
    rows = [json.dumps(x) for x in ([["timestamp", "original"], ["2024", "http://a"]], [["timestamp", "original", "statuscode"], ["1", "x", "301"], ["2", "y", "200"]], [["timestamp", "original"]], [])]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*rows, "error"]], "a string").select(P.archive_snapshot("a")).collect()]
    assert got == ["https://web.archive.org/web/2024id_/http://a", "https://web.archive.org/web/2id_/y", None, None, None]


def test_merged_terms_and_raw_answers(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"], ["b", "c", "c"])], "t array<string>, g array<string>, f array<string>")
    assert [tuple(s) for s in df.select(P.merged_terms("t", "g", "f")).first()[0]] == [("a", "x"), ("b", ""), ("c", "")]
    got = [r[0] for r in spark.createDataFrame([('{"a":1}',), ("none",)], "x string").select(X.json_or_raw("x")).collect()]
    assert [json.loads(x) for x in got] == [{"a": 1}, {"raw_response": "none"}]


def test_dialects_have_defaults_for_what_is_missing(spark):
    raw = spark.createDataFrame([("u", None)], "url string, title string")
    r = dialects.news_index(raw).first()
    assert (r.title, r.seendate, r.sourcecountry, r.sourcelang, r.domain) == ("", "", "unknown", "unknown", "")
    api = spark.createDataFrame([("http://www.a.example/x", ["br", "ar"], "", "about", "2024-01-02 03:04:05"), ("l", [], "body", "d", "bad date")], "link string, country array<string>, content string, description string, pubDate string")
    a, b = dialects.multilingual_api(api, "Portuguese", "South America", "unknown", 1).collect()
    assert (a.domain, a.sourcecountry, a.text_chars, a.has_full_text, a.seendate) == ("a.example", "BR", 5, False, "20240102030405")
    assert (b.sourcecountry, b.text_chars, b.has_full_text) == ("unknown", 4, True)
    assert len(dialects.DIALECTS) == 7


CALLS = []


def _note(name):
    CALLS.append(name)


def flaky(query, window, page):
    _note("flaky")
    if len(CALLS) == 1:
        raise OSError
    return readers.Page([(f"{query}{page}.{k}", "t", "") for k in range(3)], found=7)


def spent(query, window, page):
    _note("spent")
    return readers.Page([], status=402)


def low(query, window, page):
    _note("low")
    return readers.Page([("low", "t", "")], quota_left=3)


def limited(query, window, page):
    _note("limited")
    return readers.Page([], status=429)


def read(**options):
    CALLS.clear()
    reader = readers._PagedReader({"queries": "a", "windows": "w", "wait": "0", **options})
    return [row for p in reader.partitions() for row in reader.read(p)]


def test_api_reader_retries_and_stops_by_what_was_found():
    got = read(client=f"{__name__}:flaky")
    assert len(got) == 9 and len(CALLS) == 4  # one retry; page 3 >= 7 / 3


def test_api_reader_fails_over():
    got = read(client=f"{__name__}:spent|{__name__}:flaky", pages="2")
    assert len(got) == 6 and CALLS.count("spent") == 1
    got = read(client=f"{__name__}:low|{__name__}:flaky", pages="3")
    assert got[0][2] == "low" and CALLS.count("low") == 1 and len(got) == 7
    got = read(client=f"{__name__}:limited|{__name__}:flaky", pages="1")
    assert CALLS[:2] == ["limited", "limited"] and len(got) == 3


def test_api_reader_has_one_budget():
    got = read(client=f"{__name__}:low", queries="a|b|c", budget="2", pages="1", quota_floor="0")
    assert len(CALLS) == 2 and [r[0] for r in got] == ["a", "b"]
    assert len(readers._PagedReader({"client": "x", "queries": "a|b", "budget": "9"}).partitions()) == 1


def test_artifacts(spark, tmp_path):
    path, when = f"{tmp_path}/a/result", datetime(2024, 5, 1, 10, 0, 0)
    n = lambda p: spark.read.json(p).count()
    now = lambda: sinks.read_artifact(spark, path).count()
    assert sinks.write_artifact(spark.range(1), path, "run 1", when) == f"{path}_run_1" and now() == 1
    reader = sinks.read_artifact(spark, path)  # opened before the next copy, read after it
    assert sinks.write_artifact(spark.range(2), path, None, when) == f"{path}_20240501_100000" and now() == 2
    assert reader.count() == 1
    assert sinks.write_artifact(spark.range(4), path, None, when) == f"{path}_20240501_100000_1" and now() == 4
    sinks.write_artifact(spark.range(3), path, "run/2", when)
    assert [n(f"{path}_{k}") for k in ("run_1", "run_2", "20240501_100000", "20240501_100000_1")] == [1, 3, 2, 4] and now() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_artifact(spark.range(9), path, "run 1", when)
    assert now() == 3 and sinks.current_artifact(spark, path) == f"{path}_run_2"


def test_the_canonical_copy_is_there_at_every_step(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/result"
    sinks.write_artifact(spark.range(1), path, "a")
    seen, real = [], sinks._replace

    def watched(*args):
        seen.append(sinks.read_artifact(spark, path).count())
        real(*args)
        seen.append(sinks.read_artifact(spark, path).count())

    monkeypatch.setattr(sinks, "_replace", watched)
    sinks.write_artifact(spark.range(5), path, "b")
    assert seen == [1, 5]


def test_report_topic_and_publishing(spark, tmp_path):
    page = sinks.html_report("T & co", {"counts": spark.createDataFrame([("a<b", 2), ("c", None)], "k string, n long"), "none": spark.range(0)}, {"counts": "a note"}, rows=1)
    assert "T &amp; co" in page and "a&lt;b" in page and "1 of 2 rows" in page and "no rows" in page and "a note" in page
    with pytest.raises(ValueError):
        sinks.publish(spark, f"{tmp_path}/none", f"{tmp_path}/out")
    sinks.write_page(spark, f"{tmp_path}/in/e1/index.html", page)
    sinks.write_page(spark, f"{tmp_path}/in/notes/readme.txt", "x")
    assert sinks.publish(spark, f"{tmp_path}/in", f"{tmp_path}/out") == ["e1"] and (tmp_path / "out/e1/index.html").read_text() == page
    assert sinks.publish(spark, f"{tmp_path}/in", f"{tmp_path}/out") == []
    sinks.write_page(spark, f"{tmp_path}/in/e1/index.html", "new")
    assert sinks.publish(spark, f"{tmp_path}/in", f"{tmp_path}/out") == ["e1"] and (tmp_path / "out/e1/index.html").read_text() == "new"
    topic = readers.topic("name: Ü\nslug: s\nwindows: {w1: {start: a}}\nqueries: {q: [x]}\nother: 1")
    paths = [sinks.write_topic(spark, topic, str(tmp_path / "topics")) for _ in range(3)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["s.yaml", "s-2.yaml", "s-3.yaml"]
    assert readers.topic((tmp_path / "topics/s-3.yaml").read_text()) == topic


def test_stages_resume(spark, tmp_path):
    assert sinks.done_stages(spark, f"{tmp_path}/run") == {}
    sinks.save_stage(spark, f"{tmp_path}/run", "extract", rows=3)
    assert sinks.done_stages(spark, f"{tmp_path}/run") == {"extract": {"stage": "extract", "rows": 3}}


def test_one_failing_prompt_does_not_null_its_batch(spark):
    def picky(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(k, "bad" if k == 3 else f"p{k}") for k in range(9)], "k int, t string").coalesce(1)
    assert {r.k: r.answer for r in effects.complete(df, "t", picky).collect()} == {k: None if k == 3 else f"P{k}" for k in range(9)}


def test_embeddings_do_not_depend_on_the_batch(spark):
    texts = ["", "a", "héllo wörld", "hello world", "日本語", None, "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    one = {r.k: r.embedding for r in effects.embed(df.coalesce(1), "t").collect()}
    many = {r.k: r.embedding for r in effects.embed(df.repartition(7), "t").collect()}
    assert one == many and one[0] == one[5]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(one[2], one[3]) > dot(one[3], one[6])


def test_transcripts_are_cached_by_address(spark):
    def client(url):
        if url == "broken":
            raise OSError
        return {"transcript": f"new {url}", "language": "en", "confidence": 0.5, "minutes": 2.0}

    audio = spark.createDataFrame([("a",), ("b",), ("a",), ("broken",), (None,)], "u string")
    first = effects.transcribe(audio, "u", client)
    assert sorted(str(r.transcript) for r in first.collect()) == ["None", "new a", "new b"]
    old = first.where("transcript = 'new a'").withColumn("transcript", F.lit("old a")).unionByName(first.where("transcript is null"))
    assert sorted(str(r.transcript) for r in effects.transcribe(audio, "u", client, old).collect()) == ["None", "new b", "old a"]
    assert effects.silent_client("x")["transcript"].startswith("recording")
