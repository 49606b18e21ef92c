"""Parts of web pages, feeds and API answers as columns: no Python on the data path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import text as X

# The markup of public channel previews and the paths that are no articles.
CHANNEL_BLOCK = 'class="tgme_widget_message_wrap'
CHANNEL_TEXT = r'(?s)class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>'
CHANNEL_DATE = r'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[^"]*)"'
CHANNEL_POST = 'data-post="([^"]+)"'
SKIPPED_PATHS = ("/topics/", "/programmes/", "/help/", "/about/", "/contact/", "#", "javascript:", "/live/")
ANCHOR = r'(?s)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _plain(x: Column, gap: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", gap), r"\s+", " "))


def chat_messages(html: Column | str, channel: Column | str, last: int = 20, least: int = 20, site: str = "https://t.me") -> Column:
    """The last messages of a channel's page, in order: array of (text, date, url).  Messages whose plain text has under least
    characters are left out before the last ones are counted; a message without an id has the channel's address."""
    blocks = F.split(_c(html), CHANNEL_BLOCK)

    def message(b: Column) -> Column:
        post = F.regexp_extract(b, CHANNEL_POST, 1)
        url = F.when(post != "", F.concat(F.lit(f"{site}/"), post)).otherwise(F.concat(F.lit(f"{site}/s/"), _c(channel)))
        return F.struct(_plain(F.regexp_extract(b, CHANNEL_TEXT, 1), " ").alias("text"), F.regexp_extract(b, CHANNEL_DATE, 1).alias("date"), url.alias("url"))

    found = F.filter(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), message), lambda m: F.length(m["text"]) >= least)
    return F.slice(found, F.greatest(F.size(found) - last, F.lit(0)) + 1, F.lit(last))


def page_links(html: Column | str, base: Column | str, least: int = 15, wanted: Sequence[str] = (), skipped: Sequence[str] = SKIPPED_PATHS, same_site: bool = True, in_address: bool = False) -> Column:
    """Links of a page to articles, array of (url, title) in order, the first of each url: anchor text of at least least characters,
    root-relative addresses resolved, other relative ones left out, none of the skipped substrings, a wanted term in the anchor text
    (with in_address: or in the address) if there are wanted terms."""
    root = F.regexp_extract(_c(base), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    host = F.regexp_replace(root, "^[^:]*://", "")
    anchors = F.arrays_zip(F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(_c(html), F.lit(ANCHOR), F.lit(2)).alias("label"))

    def link(a: Column) -> Column:
        url = F.when(a["href"].startswith("/"), F.concat(root, a["href"])).when(a["href"].startswith("http"), a["href"])
        return F.struct(url.alias("url"), _plain(a["label"], "").alias("title"))

    def good(a: Column) -> Column:
        ok = a["url"].isNotNull() & (F.length(a["title"]) >= least)
        if same_site:
            ok = ok & a["url"].contains(host)
        if skipped:
            ok = ok & ~X.any_term(a["url"], skipped)
        if wanted:
            ok = ok & X.any_term(F.concat(a["title"], F.lit(" "), a["url"]) if in_address else a["title"], wanted)
        return ok

    found = F.filter(F.transform(anchors, link), good)
    urls = F.transform(found, lambda a: a["url"])
    first = F.filter(found, lambda a, i: F.array_position(urls, a["url"]) == i + 1)
    return F.transform(first, lambda a: F.struct(a["url"].alias("url"), F.left(a["title"], F.lit(100)).alias("title")))


def sermon_links(html: Column | str, base: Column | str, indicators: Sequence[str], wanted: Sequence[str] = (), least: int = 10) -> Column:
    """Links whose text or address holds an indicator or a wanted term, to any site."""
    return page_links(html, base, least, [*indicators, *wanted], (), same_site=False, in_address=True)


def forum_comments(answer: Column | str, limit: int = 10) -> Column:
    """Comments of a forum's answer (a list of two listings: the post, its comments), array of (body, score, created_utc): those of
    kind t1 with over 20 characters that were not deleted or removed, cut to 2000, the first limit."""
    kind = "array<struct<data:struct<children:array<struct<kind:string,data:struct<body:string,score:long,created_utc:double>>>>>>"
    listed = F.get(F.from_json(_c(answer), kind), F.lit(1))["data"]["children"]

    def comment(c: Column) -> Column:
        d = c["data"]
        return F.struct(F.left(F.trim(d["body"]), F.lit(2000)).alias("body"), F.coalesce(d["score"], F.lit(0)).alias("score"), F.coalesce(d["created_utc"].cast("long"), F.lit(0)).alias("created_utc"))

    def kept(c: Column) -> Column:
        body = F.trim(c["data"]["body"])
        return (c["kind"] == "t1") & ~body.isin("[deleted]", "[removed]") & (F.length(body) > 20)

    return F.slice(F.transform(F.filter(F.coalesce(listed, F.array().cast(_listing())), kept), comment), 1, limit)


def _listing() -> str:
    return "array<struct<kind:string,data:struct<body:string,score:long,created_utc:double>>>"


def archive_snapshot(answer: Column | str, prefix: str = "https://web.archive.org/web") -> Column:
    """Address of the first snapshot of an archive's index answer (a JSON table whose first row is its header; columns timestamp,
    original and, if asked for, statuscode): the first row with status 200, without the archive's own frame; null if there is none."""
    table = F.from_json(_c(answer), "array<array<string>>")
    head = F.get(table, F.lit(0))
    cell = lambda row, name: F.get(row, (F.array_position(head, name) - 1).cast("int"))
    rows = F.filter(F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))), lambda r: ~F.array_contains(head, "statuscode") | (cell(r, "statuscode") == "200"))
    first = F.get(rows, F.lit(0))
    return F.concat(F.lit(f"{prefix}/"), cell(first, "timestamp"), F.lit("id_/"), cell(first, "original"))


def merged_terms(terms: Column | str, glosses: Column | str, found: Column | str) -> Column:
    """Terms with their glosses (empty where the list of glosses is shorter), then the found terms that are not among them."""
    listed = X.structured_terms(terms, glosses)
    known = F.transform(listed, lambda s: s["term"])
    more = F.filter(F.array_distinct(_c(found)), lambda x: ~F.array_contains(known, x))
    return F.concat(listed, F.transform(more, lambda x: F.struct(x.alias("term"), F.lit("").alias("english"))))
