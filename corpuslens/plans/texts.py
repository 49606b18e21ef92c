"""Queries over text, URL, date and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import aggregates as A

from .registry import query

STOP = ("that", "with", "this", "from", "pour", "dans", "nicht")


@query("select page_id, md5(url) cache_key, replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '') host, rtrim(regexp_replace(url, '^https?://', ''), '/') domain from pages")
def url_functions(t):  # F1 F2 F3 S21
    return t.pages.select("page_id", X.cache_key("url").alias("cache_key"), X.url_host("url").alias("host"), X.source_domain("url").alias("domain"))


@query("with p as (select md5(url) k, replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'www.', '') host, page_id from pages) select host, count(*) missing from p where k not in (select k from p where page_id % 3 = 0) group by 1")
def uncached_backfill(t):  # S22
    p = t.pages.select(X.cache_key("url").alias("k"), X.url_host("url").alias("host"), "page_id")
    return p.join(p.where("page_id % 3 = 0").select("k").distinct(), "k", "left_anti").groupBy("host").agg(F.count("*").alias("missing"))


@query("select page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 50) slug from pages")
def url_slugs(t):  # F4 F5
    return t.pages.select("page_id", X.slug("url").alias("slug"))


@query(r"""with a as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) x from pages)
 select page_id, case when length(x) >= 100 then left(x, 5000) end "text" from a""")
def html_to_text(t):  # S18 F18
    return t.pages.select("page_id", X.html_to_text("html").alias("text"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) label from pages)
 select page_id, href, min(label) label from l where length(label) >= 3 and href like '/%' group by all""")
def html_links(t):  # S16 S17
    get = lambda g: F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(g))
    l = t.pages.select("page_id", F.inline(F.arrays_zip(get(1).alias("href"), get(2).alias("label"))))
    return l.where((F.length("label") >= 3) & F.col("href").startswith("/")).groupBy("page_id", "href").agg(F.min("label").alias("label"))


@query(r"""select page_id, cast(len(regexp_extract_all(html, '<p>')) as bigint) blocks, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages""")
def message_blocks(t):  # S15 S13
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("blocks"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') escaped from pages")
def html_escaped(t):  # F17
    return t.pages.select("page_id", X.html_escape("html").alias("escaped"))


@query("select doc_id from documents where contains(lower(text), 'onthe') or contains(lower(text), 'idiot') or contains(lower(text), 'queaux')")
def keyword_relevance(t):  # P16
    return t.documents.where(X.any_term("text", ["onthe", "idiot", "queaux"])).select("doc_id")


@query("select doc_id, case when contains(lower(text), 'thand') or contains(lower(text), 'ofthe') then 'a' when contains(lower(text), 'aux') then 'b' when contains(lower(text), 'keit') then 'c' else 'other' end class from documents where text is not null")
def ordered_classifier(t):  # F6 P10
    return t.documents.where("text is not null").select("doc_id", X.first_class("text", [("a", ["thand", "ofthe"]), ("b", ["aux"]), ("c", ["keit"])]).alias("class"))


@query(r"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as bigint) words, cast(len(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) > 30)) as bigint) paragraphs, cast(len(regexp_extract_all(text, '\b[0-9]+\b')) as bigint) numbers from documents where text is not null")
def text_counts(t):  # F9 F13 F14
    return t.documents.where("text is not null").select("doc_id", F.size(X.words("text")).cast("long").alias("words"), F.size(X.paragraphs("text")).cast("long").alias("paragraphs"), X.number_count("text").cast("long").alias("numbers"))


@query(r"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[.!?]+[ \n]+'), lambda s: s <> '')) as bigint) n from documents where text is not null")
def sentence_split(t):  # F11
    return t.documents.where("text is not null").select("doc_id", F.size(X.sentences("text")).cast("long").alias("n"))


@query("""select doc_id, array_to_string(list_filter(regexp_extract_all(text, '["“]([^"“”]*)["”]', 1), lambda s: length(s) >= 20), '|') spans from documents where contains(text, '"')""")
def quote_spans(t):  # F7
    return t.documents.where(F.col("text").contains('"')).select("doc_id", F.array_join(X.quoted_spans("text"), "|").alias("spans"))


@query(r"""with k as (select source, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: length(w) >= 4), lambda w: trim(w, '.,;:!?"''()[]{}|*$%&#'))) w, doc_id from documents),
 c as (select source, w, count(*) n, min(doc_id) f from k where w <> '' and w not in ('that', 'with', 'this', 'from', 'pour', 'dans', 'nicht') group by all)
 select source, w, n, rank from (select *, row_number() over (partition by source order by n desc, f, w) rank from c) where rank <= 10""")
def keyword_topk_per_cluster(t):  # F15 A10
    k = t.documents.select("source", "doc_id", F.explode(X.keyword_tokens("text", STOP)).alias("w"))
    return A.most_common(k, ["source"], "w", "doc_id", 10).select("source", "w", "n", "rank")


@query("""with x as (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y%m%dT%H%M%SZ') when 1 then strftime(o_orderdate, '%Y%m%d%H%M%S') when 2 then strftime(o_orderdate, '%Y-%m-%d 10:15:00') when 3 then '' else 'Wed, 02 Apr' end s, o_orderdate d from orders)
 select o_orderkey, s raw, case when o_orderkey % 5 < 3 then strftime(d, '%Y-%m-%d') end "day", case when o_orderkey % 5 = 2 then strftime(d, '%Y%m%d') || '101500' else left(replace(replace(replace(s, '-', ''), ':', ''), ' ', ''), 14) end compact from x""")
def date_format_cascade(t):  # D1f D2f D4f
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd'T'HHmmss'Z'")).when(k == 1, F.date_format(d, "yyyyMMddHHmmss")).when(k == 2, F.date_format(d, "yyyy-MM-dd 10:15:00")).when(k == 3, "").otherwise("Wed, 02 Apr")
    o = t.orders.select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", "raw", F.date_format(X.parse_date("raw"), "yyyy-MM-dd").alias("day"), X.compact_timestamp("raw").alias("compact"))


@query("select event_id, strftime(to_timestamp(event_id * 86400 + 1700000000) at time zone 'UTC', '%Y-%m-%d') \"day\", case event_id % 4 when 0 then 3723 when 1 then 754 when 2 then 90 end \"seconds\", strftime(ts, '%Y%m%d') || '000000' lo, strftime(ts, '%Y%m%d') || '235959' hi from events")
def epoch_duration_bounds(t):  # D3f D5f D6f
    e = t.events
    raw = F.when(F.col("event_id") % 4 == 0, "1:02:03").when(F.col("event_id") % 4 == 1, "12:34").when(F.col("event_id") % 4 == 2, "90").otherwise("x")
    lo, hi = X.day_bounds("ts")
    return e.select("event_id", X.epoch_date(F.col("event_id") * 86400 + 1700000000).alias("day"), X.duration_seconds(raw).alias("seconds"), lo.alias("lo"), hi.alias("hi"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_payload_extract(t):  # N1 P5
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, case when event_id % 4 < 3 then cast(json_extract_string(props, '$.k') as bigint) end k from events")
def json_tolerant_parse(t):  # N1 N3
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("<think>{no}</think> Here: "), "props", F.lit(" as asked."))).when(k == 2, F.col("props")).otherwise("no braces")
    return t.events.select("event_id", F.get_json_object(X.tolerant_json(raw), "$.k").cast("long").alias("k"))


@query("""select event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' payload from events""")
def json_serialise(t):  # N4
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("payload"))


@query("select conv_id, string_agg('voice absent: ' || role, ';' order by turn, role, text) flags from conversations group by 1")
def prefixed_flags(t):  # N6 C1f
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s["role"]).alias("r"))
    return c.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("voice absent: "), x)), ";").alias("flags"))


@query("select n_nationkey, 'Nation ' || n_name || ' lies in region ' || n_regionkey || '.' rendered, not contains('Nation ' || n_name || ' lies in region ' || n_regionkey, 'NATION_3') pure from nation")
def template_purity(t):  # F19 M48
    out = X.render_template("Nation {name} lies in region {region}.", {"name": "n_name", "region": "n_regionkey"})
    return t.nation.select("n_nationkey", out.alias("rendered"), (~X.any_term(out, ["NATION_3"])).alias("pure"))


@query("select doc_id, case when n_chars % 10 < 3 then 'severe' when n_chars % 10 < 5 then 'short' else 'ok' end warning from documents where n_chars % 10 > 0")
def translation_warning(t):  # D4
    k = (F.col("n_chars") % 10).cast("int")
    return t.documents.where(k > 0).select("doc_id", X.length_ratio_warning(F.repeat(F.lit("x"), F.lit(10)), F.repeat(F.lit("y"), k)).alias("warning"))


@query("with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') w from documents where text is not null) select doc_id, array_to_string(list_transform(range(1, 4), lambda i: coalesce(w[i], '') || '/' || case when i <= 2 then coalesce(w[i + 3], '') else '' end), ',') pairs from w where len(w) >= 6")
def structured_term_list(t):  # P9
    w = F.filter(F.split("text", " "), lambda x: x != "")
    d = t.documents.where("text is not null").select("doc_id", w.alias("w")).where(F.size("w") >= 6)
    return d.select("doc_id", F.array_join(F.transform(X.structured_terms(F.slice("w", 1, 3), F.slice("w", 4, 2)), lambda s: F.concat(s["term"], F.lit("/"), s["english"])), ",").alias("pairs"))


def _terms(source: str, group: int, n: int) -> str:
    return f"list_filter({source}, lambda x, i: list_position({source}, x) = i)[:{n}]"


@query(rf"""with d as (select doc_id, text, regexp_replace(text, '([^\p{{L}}\p{{N}}_ ])', '\1\1', 'g') wide from documents),
 r as (select doc_id, regexp_extract_all(text, '["“«]([^"“”«»]{{2,40}})["”»]', 1) q, regexp_extract_all(wide, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?:$|[^\p{{L}}\p{{N}}_])', 1) m, regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]{{3,}}(?: [\x{{0600}}-\x{{06FF}}]{{3,}})*') a, regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]{{2,}}') c from d),
 l as (select doc_id, list_concat(list_concat({_terms('q', 1, 8)}, {_terms('m', 1, 10)}), list_concat({_terms('a', 0, 10)}, {_terms('c', 0, 15)})) l from r)
 select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') terms from l""")
def original_terms(t):  # F10
    return t.documents.select("doc_id", F.array_join(X.original_terms("text"), "|").alias("terms"))


@query(r"""with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) s from documents where text is not null),
 p as (select doc_id, string_split(list_reduce(s, lambda a, x: case when length(string_split(a, chr(1))[-1]) + 1 + length(x) <= 400 then a || ' ' || x else a || chr(1) || x end), chr(1)) c from s),
 u as (select doc_id, unnest(c) chunk, generate_subscripts(c, 1) - 1 pos from p) select doc_id, pos, chunk from u where chunk <> ''""")
def packed_chunks(t):  # F12
    return t.documents.where("text is not null").select("doc_id", F.posexplode(X.packed_chunks("text")).alias("pos", "chunk"))


@query("""with d as (select doc_id, left(replace(coalesce(nullif(text, ''), 'none'), chr(10), ' '), 240) s from documents) select doc_id, s summary from d""")
def summary_projection(t):  # P6 P7
    return t.documents.select("doc_id", F.left(F.regexp_replace(F.coalesce(F.nullif("text", F.lit("")), F.lit("none")), "\n", " "), F.lit(240)).alias("summary"))


@query("""select 'feed_a' dialect, concat('u', o_orderkey) url, strftime(o_orderdate, '%Y%m%d') seendate, 'unknown' country from orders union all
 select 'feed_b', concat('s', s_suppkey), '', concat('N', s_nationkey) from supplier""")
def article_record_union(t):  # P1 S1 S3
    a = t.orders.select(F.lit("feed_a").alias("dialect"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), F.date_format("o_orderdate", "yyyyMMdd").alias("seendate"))
    b = t.supplier.select(F.lit("feed_b").alias("dialect"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select("dialect", "url", F.coalesce("seendate", F.lit("")).alias("seendate"), F.coalesce("country", F.lit("unknown")).alias("country"))


@query("select doc_id, coalesce(nullif(trim(case when doc_id % 3 = 0 then '  ' else left(text, 20) end), ''), nullif(trim(lang), ''), 'archive') best from documents")
def first_nonblank_tier(t):  # S19
    tiers = [F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.left("text", F.lit(20))), F.col("lang")]
    return t.documents.select("doc_id", F.coalesce(*(F.nullif(X.trim(c), F.lit("")) for c in tiers), F.lit("archive")).alias("best"))


@query("select event_id, case when event_id % 2 = 0 then 2 else 1 end n, cast(json_extract_string(props, '$.k') as bigint) first_k from events")
def json_array_coercion(t):  # N2 N5
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.concat(F.lit("noise "), "props", F.lit(" noise")))
    e = t.events.select("event_id", X.json_list(raw, "k long").alias("l"))
    return e.select("event_id", F.size("l").alias("n"), F.get("l", F.lit(0))["k"].alias("first_k"))


@query("select event_type, count(*) n, round(avg(value), 2) r2, round(avg(value), 4) r4 from events where json_extract_string(props, '$.missing') is null and event_type <> 'error' group by 1")
def error_rows_excluded(t):  # P23 M5f
    e = t.events.where(F.get_json_object("props", "$.missing").isNull() & (F.col("event_type") != "error"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("r2"), F.round(F.avg("value"), 4).alias("r4"))


@query()
def detected_languages(t):  # D3
    from corpuslens.operators import language as L

    model = L.learn(t.documents, "text", "lang")
    return L.detect(t.documents.select("doc_id", "lang", "text"), "text", model).groupBy("lang", "language").agg(F.count("*").alias("n"))
