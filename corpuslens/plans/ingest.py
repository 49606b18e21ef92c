"""Queries over feeds, pages, API answers and record dialects; the raw bodies are written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import pages as P
from corpuslens.functions import text as X
from corpuslens.sources import dialects as D
from corpuslens.sources import readers

from .registry import Tables, query


def _tag(name: str, value, attributes: str = "") -> F.Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


def _k(column: str, n: int):
    return F.col(column) % n


def rss_documents(t: Tables) -> DataFrame:
    """A feed a nation: Atom for odd ones.  Customers are items; some lack a title, a link or a date."""
    key = F.col("c_custkey").cast("string")
    title = F.when(_k("c_custkey", 11) != 0, _tag("title", F.col("c_name"))).otherwise("")
    rss = F.concat(F.lit("<item>"), title, F.when(_k("c_custkey", 7) != 0, _tag("link", F.concat(F.lit(" http://c/"), key))).otherwise(""), F.when(_k("c_custkey", 3) != 0, _tag("pubDate", F.concat(F.lit("d"), key))).otherwise(""), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), title, F.when(_k("c_custkey", 7) != 0, F.concat(F.lit('<link href="http://c/'), key, F.lit('"/>'))).otherwise(""), F.when(_k("c_custkey", 3) != 0, _tag("updated", F.concat(F.lit("d"), key))).otherwise(""), F.lit("</entry>"))
    odd = _k("c_nationkey", 2) == 1
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.when(odd, atom).otherwise(rss).alias("x")))), lambda s: s["x"]), "")
    g = t.customer.groupBy("c_nationkey").agg(body.alias("b"))
    xml = F.when(odd, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "b", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel><title>of the feed</title>"), "b", F.lit("</channel></rss>")))
    return g.select(F.col("c_nationkey").alias("doc"), xml.alias("xml"))


@query("select c_nationkey doc, c_name title, 'http://c/' || c_custkey link, case when c_custkey % 3 <> 0 then 'd' || c_custkey else '' end published from customer where c_custkey % 11 <> 0 and c_custkey % 7 <> 0")
def feed_items(t):  # S13
    return readers.feed_items(rss_documents(t)).select("doc", "title", "link", "published")


@query("""select p_brand doc, p_name title, case when p_partkey % 3 <> 0 then 'http://p/' || p_partkey else 'http://a/' || p_partkey end url, 'http://a/' || p_partkey audio_url, case p_partkey % 4 when 0 then 3723 when 1 then 754 when 2 then 90 end duration_seconds
 from part where p_partkey % 5 <> 0 and p_partkey % 2 = 0 or p_partkey % 5 <> 0 and p_partkey % 6 = 1""")
def podcast_items(t):  # S14 D5f
    key = F.col("p_partkey").cast("string")
    audio = F.concat(F.lit('<enclosure url="http://a/'), key, F.when(_k("p_partkey", 2) == 0, F.lit('" type="audio/mpeg"/>')).when(_k("p_partkey", 6) == 1, F.lit('"/>')).otherwise(F.lit('" type="video/mp4"/>')))
    length = F.when(_k("p_partkey", 4) == 0, "1:02:03").when(_k("p_partkey", 4) == 1, "12:34").when(_k("p_partkey", 4) == 2, "90").otherwise("x")
    item = F.concat(F.lit("<item>"), _tag("title", F.col("p_name")), F.when(_k("p_partkey", 3) != 0, _tag("link", F.concat(F.lit("http://p/"), key))).otherwise(""), F.when(_k("p_partkey", 5) != 0, audio).otherwise(""), _tag("itunes:duration", length), F.lit("</item>"))
    g = t.part.groupBy("p_brand").agg(F.array_join(F.collect_list(item), "").alias("b"))
    xml = F.concat(F.lit('<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>'), "b", F.lit("</channel></rss>"))
    return readers.podcast_items(g.select(F.col("p_brand").alias("doc"), xml.alias("xml"))).select("doc", "title", "url", "audio_url", "duration_seconds")


@query(r"""with m as (select conv_id, turn, text, trim(regexp_replace(regexp_replace(replace(replace(text, '<', ''), '>', ''), '\n', ' ', 'g'), '\s+', ' ', 'g')) x from conversations where text is not null),
 n as (select *, row_number() over (partition by conv_id order by turn desc, text desc) r from m where length(x) >= 20) select conv_id, x "text", case when turn % 3 = 0 then '' else '2024-05-01T10:00:0' || turn % 10 || '+00:00' end "date", case when turn % 5 = 4 then 'https://t.me/s/c' || conv_id else 'https://t.me/c' || conv_id || '/' || turn end url from n where r <= 4""")
def chat_messages(t):  # S15
    turn = F.col("turn").cast("string")
    text = F.regexp_replace(F.regexp_replace("text", "[<>]", ""), "\n", "<br/>")
    post = F.when(_k("turn", 5) != 4, F.concat(F.lit(' data-post="c'), F.col("conv_id").cast("string"), F.lit("/"), turn, F.lit('"'))).otherwise("")
    date = F.when(_k("turn", 3) != 0, F.concat(F.lit('<time datetime="2024-05-01T10:00:0'), _k("turn", 10).cast("string"), F.lit('+00:00">'))).otherwise("")
    block = F.concat(F.lit('<div class="tgme_widget_message_wrap js"><div'), post, F.lit('><div class="tgme_widget_message_text js" dir="auto">'), text, F.lit("</div>"), date, F.lit("</div></div>"))
    page = F.concat(F.lit("<html><body>head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text", block.alias("b")))), lambda s: s["b"]), ""))
    g = t.conversations.where("text is not null").groupBy("conv_id").agg(page.alias("html"))
    m = P.chat_messages("html", F.concat(F.lit("c"), F.col("conv_id").cast("string")), last=4)
    return g.select("conv_id", F.explode(m).alias("m")).select("conv_id", "m.*")


_LINKS = r"""l as (select page_id, url base, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1, 's')) href, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 2, 's')) label, generate_subscripts(regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1, 's'), 1) pos from pages),
 m as (select *, case when starts_with(href, '/') then regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href when starts_with(href, 'http') then href end u, trim(regexp_replace(regexp_replace(label, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) title from l)"""


@query(f"""with {_LINKS}, g as (select * from m where u is not null and length(title) >= 4 and contains(u, regexp_replace(regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1), '^[^:]*://', '')) and not contains(lower(u), '/the') and not contains(u, '#'))
 select page_id, u url, arg_min(left(title, 100), pos) title from g group by 1, 2""")
def page_links(t):  # S16
    return t.pages.select("page_id", F.inline(P.page_links("html", "url", least=4, skipped=("/the", "#"))))


@query(f"with {_LINKS} select page_id, u url, arg_min(left(title, 100), pos) title from m where u is not null and length(title) >= 3 and (contains(lower(title || ' ' || u), 'sch') or contains(lower(title || ' ' || u), 'ea')) group by 1, 2")
def sermon_links(t):  # S17
    return t.pages.select("page_id", F.inline(P.sermon_links("html", "url", ["sch"], ["ea"], least=3)))


@query("""with c as (select conv_id, turn, case when turn % 7 = 6 then '[deleted]' else trim(coalesce(text, '')) end body, turn % 2 kind, row_number() over (partition by conv_id order by turn, text) r from conversations),
 k as (select *, row_number() over (partition by conv_id order by r) n from c where kind = 0 and body not in ('[deleted]', '[removed]') and length(body) > 20) select conv_id, left(body, 2000) body, turn * 3 score from k where n <= 2""")
def forum_comments(t):  # S12
    body = F.when(_k("turn", 7) == 6, "[deleted]").otherwise(F.trim(F.coalesce("text", F.lit(""))))
    child = F.struct(F.when(_k("turn", 2) == 0, "t1").otherwise("more").alias("kind"), F.struct(body.alias("body"), (F.col("turn") * 3).alias("score")).alias("data"))
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text", child.alias("c")))), lambda s: s["c"]).alias("children"))
    answer = F.to_json(F.array(F.struct(F.struct(F.slice("children", 1, 0).alias("children")).alias("data")), F.struct(F.struct(F.col("children")).alias("data"))))
    return c.select("conv_id", F.inline(P.forum_comments(answer, 2))).select("conv_id", "body", "score")


@query("select event_id, case event_id % 3 when 0 then 'https://web.archive.org/web/2024' || event_id || 'id_/http://x/' || user_id when 1 then 'https://web.archive.org/web/2025id_/http://x/' || user_id end snapshot from events")
def archive_snapshots(t):  # S20
    row = lambda stamp, status: F.array(stamp, F.concat(F.lit("http://x/"), F.col("user_id").cast("string")), F.lit(status))
    head = F.array(F.lit("timestamp"), F.lit("original"), F.lit("statuscode"))
    stamp = F.concat(F.lit("2024"), F.col("event_id").cast("string"))
    answer = F.when(_k("event_id", 3) == 0, F.to_json(F.array(head, row(stamp, "200"), row(F.lit("2020"), "200")))).when(_k("event_id", 3) == 1, F.to_json(F.array(head, row(stamp, "404"), row(F.lit("2025"), "200")))).otherwise(F.to_json(F.array(head)))
    return t.events.select("event_id", P.archive_snapshot(answer).alias("snapshot"))


LANGUAGES = {"en": "English", "fr": "French", "de": "German"}
_EMPTY = "cast(null as varchar)"


def _dialect_sql() -> str:
    parts = {
        "news_index": "'s' || s_suppkey, s_name, '', 'unknown', 'German', '', null, null, null, null, null from supplier",
        "news_index_windowed": "'n' || n_nationkey, n_name, '20250402', 'C' || n_regionkey, 'unknown', 'd' || n_nationkey, 'w1', null, null, null, null from nation",
        "full_text_api": "'https://www.h' || o_custkey % 50 || '.example/' || o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m%d%H%M%S'), 'unknown', 'English', 'h' || o_custkey % 50 || '.example', 'w2', length(o_orderpriority), true, null, null from orders",
        "multilingual_api": "'https://c' || c_custkey || '.example/x', c_name, case when c_custkey % 2 = 0 then '20240105101500' else '2024139910' end, case c_custkey % 3 when 0 then 'DE' when 1 then 'nowhere' else 'Iran' end, 'Persian', 'c' || c_custkey || '.example', null, length(c_mktsegment), c_custkey % 2 = 0, null, 'Middle East' from customer",
        "financial_api": "'http://p' || p_partkey || '.example', p_name, case when p_partkey % 2 = 0 then '20240301120000' else '' end, null, 'en', 'p' || p_partkey || '.example', 'w3', length(p_type), null, case when p_partkey % 2 = 0 then p_brand || ',X' else p_brand end, null from part",
        "tagged_index": "'r' || r_regionkey, r_name, '', 'unknown', 'unknown', '', null, null, null, null, null from region",
        "league_api": "'http://www.i' || item_id || '.example/a?b', '', '2024', 'unknown', 'Korean', 'www.i' || item_id || '.example', null, null, null, null, null from benchmark",
    }
    names = "url, title, seendate, sourcecountry, sourcelang, domain, \"window\", text_chars, has_full_text, tickers, region"
    first = "select '' dialect, '' url, '' title, '' seendate, '' sourcecountry, '' sourcelang, '' domain, '' \"window\", cast(0 as bigint) text_chars, false has_full_text, '' tickers, '' region where false"
    return f"with d(dialect, {names}) as ({first} union all " + " union all ".join(f"select '{k}', {v}" for k, v in parts.items()) + ") select * from d"


@query(_dialect_sql())
def record_dialects(t):  # P1
    s = lambda *parts: F.concat(*(F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)))
    host = F.concat(F.lit("https://www.h"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example/"), F.col("o_orderkey").cast("string"))
    countries = F.when(_k("c_custkey", 3) == 0, F.array(F.lit("de"), F.lit("fr"))).when(_k("c_custkey", 3) == 1, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    entity = lambda symbol: F.struct(symbol.alias("symbol"), F.lit("tech").alias("industry"))
    records = {
        "news_index": D.news_index(t.supplier.select(s("s", "s_suppkey").alias("url"), F.col("s_name").alias("title"), F.lit("German").alias("sourcelang"))),
        "news_index_windowed": D.news_index_windowed(t.nation.select(s("n", "n_nationkey").alias("url"), F.col("n_name").alias("title"), F.lit("20250402").alias("seendate"), s("C", "n_regionkey").alias("sourcecountry"), s("d", "n_nationkey").alias("domain")), "w1", 7),
        "full_text_api": D.full_text_api(t.orders.select(host.alias("url"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("publish_date")), "en", 5, LANGUAGES, "w2"),
        "multilingual_api": D.multilingual_api(t.customer.select(s("https://c", "c_custkey", ".example/x").alias("link"), F.col("c_name").alias("title"), F.when(_k("c_custkey", 2) == 0, F.col("c_mktsegment")).otherwise("").alias("content"), F.col("c_mktsegment").alias("description"), F.when(_k("c_custkey", 2) == 0, "2024-01-05 10:15:00").otherwise("2024-13-99 10").alias("pubDate"), countries.alias("country")), "Persian", "Middle East", "Iran", 1),
        "financial_api": D.financial_api(t.part.select(s("http://p", "p_partkey", ".example").alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("snippet"), F.when(_k("p_partkey", 2) == 0, "2024-03-01T12:00:00.000Z").otherwise("bad").alias("published_at"), F.when(_k("p_partkey", 2) == 0, F.array(entity(F.col("p_brand")), entity(F.lit("X")))).otherwise(F.array(entity(F.col("p_brand")), entity(F.lit("")))).alias("entities")), "w3"),
        "tagged_index": D.tagged_index(t.region.select(s("r", "r_regionkey").alias("url"), F.col("r_name").alias("title"), F.lit("x").alias("sourcelang"))),
        "league_api": D.league_api(t.benchmark.select(s("http://www.i", "item_id", ".example/a?b").alias("url"), F.col("text"), F.lit("2024").alias("publish_date")), "ko", {"ko": "Korean"}),
    }
    u = D.union(records)
    return u.select("dialect", "url", "title", "seendate", "sourcecountry", "sourcelang", "domain", "window", "text_chars", "has_full_text", F.array_join("tickers", ",").alias("tickers"), "region")


@query("""with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') w from documents where text is not null), s as (select doc_id, w[1:3] a, w[4:5] g, w[2:7] f from w where len(w) >= 7),
 r as (select doc_id, list_transform(range(1, 4), lambda i: a[i] || '/' || coalesce(g[i], '')) l, a, f from s),
 m as (select doc_id, string_agg(x || '/', ',' order by p) more from (select doc_id, x, min(p) p from (select doc_id, a, unnest(f) x, generate_subscripts(f, 1) p from r) where not list_contains(a, x) group by 1, 2) group by 1)
 select doc_id, array_to_string(l, ',') || coalesce(',' || more, '') terms from r left join m using (doc_id)""")
def merged_term_list(t):  # P9
    w = F.filter(F.split("text", " "), lambda x: x != "")
    d = t.documents.where("text is not null").select("doc_id", w.alias("w")).where(F.size("w") >= 7)
    terms = P.merged_terms(F.slice("w", 1, 3), F.slice("w", 4, 2), F.slice("w", 2, 6))
    return d.select("doc_id", F.array_join(F.transform(terms, lambda s: F.concat(s["term"], F.lit("/"), s["english"])), ",").alias("terms"))


@query("""select event_id, case when event_id % 3 = 2 then '{"raw_response":"no braces ' || event_id || '"}' else '{"k":' || cast(json_extract_string(props, '$.k') as bigint) || '}' end answer from events""")
def answer_or_raw(t):  # N1
    raw = F.when(_k("event_id", 3) == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(_k("event_id", 3) == 1, F.concat(F.lit("Sure: "), "props")).otherwise(F.concat(F.lit("no braces "), F.col("event_id").cast("string")))
    return t.events.select("event_id", F.to_json(F.try_parse_json(X.json_or_raw(raw))).alias("answer"))
