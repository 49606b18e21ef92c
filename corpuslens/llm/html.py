"""Operator 9: main text of a page by scoring the tree of its elements.

A tolerant tokenizer builds the tree (void elements, implied ends of p, li, td ..., raw script and
style).  Elements that are no article by their tag, role, class or id (navigation, page header,
footer, sidebar, notice, advert, form, comments) are cut with all they hold.  A class or id counts by
its whole name or the name's first or last word, unless it tells of a state (has-sidebar,
comments-open, overflow-hidden); paragraphs and headings count by the whole name only.  An element
that was marked only by class or as a form but holds most of the page's text around paragraphs (a form
around a page) is not cut.  Names that say as much of layout or of a topic (text-widget, hidden-xs,
share-price) cut only what does not read as text: an element with a long block and few links stays inside an
article, and elsewhere if the elements of that name hold a third of the page's text.  Comments under
any name are found by repetition: siblings of one kind after the first prose, that each open with a
short name and hold a block, and that bear a date, a reply link or a container's name for talk.

Every remaining block of text gives points for its length and commas to its container and, lessened by
distance, to the containers above; a container's points are discounted by its link density.  The best
container is kept whole, widened to the article or main element around it if there is one, together with
siblings (of it, or of the wrappers that hold nothing else) that score well inside or read like text, other
articles beside it at half its score or more, and the page's heading.  Of equal scores the later, inner container is
the best one.

Output: character references decoded, white space collapsed, blocks joined by one space.

Defined cases: null or empty html and pages without text give ''; unclosed and stray tags are
repaired; nesting of any depth is walked without recursion; repeated rows are extracted each; other
columns are ignored.  The plan is one narrow pass, without a shuffle.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, trimmed

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CUT_TAGS = set("head script style noscript template iframe nav footer aside button select option textarea input svg canvas object embed audio video dialog menu map title".split())
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "note"}
#: words of class and id that mark what is no article
CUT_WORDS = set("ad ads adbox adslot adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist disqus respond replies social share sharing related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pager pagination masthead toolbar skip hidden".split())
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
ADVERT_WORDS = {"ad", "ads", "adsbygoogle", "advert", "advertisement", "sponsored", "promo", "cookie", "newsletter"}
#: what related must be followed by, if by anything
LISTED_WORDS = {"post", "posts", "article", "articles", "story", "stories", "link", "links", "content", "item", "items", "news", "reading", "topics", "list"}
#: marking words that as often name a layout, alone; and the other marking words that are sure even before another word
LAYOUT_WORDS = {"widget", "widgets"}
SURE_WORDS = COMMENT_WORDS | ADVERT_WORDS | set("adbox adslot adverts advertising sponsor promotion cookies consent gdpr sidebar aside nav navbar breadcrumb breadcrumbs footer related recommended recommendations login popup pager pagination masthead".split())
TALK_WORDS = {"discussion", "discussions", "thread", "threads", "conversation", "feedback", "reactions", "responses", "opinions", "talk"}
#: words that make a name tell of a state, before the marking word and after it
STATE_BEFORE = {"has", "no", "with", "without", "is", "not", "overflow", "show", "hide", "allow"}
STATE_AFTER = {"open", "closed", "enabled", "disabled", "visible", "on", "off", "active"}
WEAK_WORDS = {"header", "top", "tags", "meta"}  # only outside an article
KEPT_TAGS = {"html", "body", "main"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
SCOPE = {"html", "body", "table", "td", "th", "ul", "ol", "dl", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote"}
LEAF_BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dt", "dd", "figcaption", "blockquote"}
LEVELS = 6  # how far up points are passed
LONG = 60  # characters of a block that reads as text
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATED = re.compile(rf"<time\b|\b(?:\d+|an?) (?:second|minute|min|hour|day|week|month|year)s? ago\b|\b[0-2]?\d:[0-5]\d\b|\b\d{{1,2}}(?:st|nd|rd|th)?\.? {MONTH},? \d{{4}}|\b{MONTH} \d{{1,2}},? \d{{4}}|\b\d{{4}}-\d\d-\d\d\b|\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}\b", re.I)
REPLY = re.compile(r">\s*(?:reply|antworten|répondre|responder|rispondi)\s*<", re.I)
OPENING = re.compile(r"(?:\s*<(?!h[1-6]\b|/)[^>]*>){1,12}\s*([^<>\d]{1,40}?)\s*<")
HOLDS = re.compile(r"<(?:p|div|blockquote|dd|section)\b", re.I)
ITEMS = {"div", "li", "article", "section", "dd", "tr", "blockquote"}
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def _names(tag: str, value: str, in_article: bool) -> str:
    """What a class or id makes of an element: "" (nothing), "layout:" and the name, "mark" or "comment"."""
    out = ""
    for name in value.split():
        words = [x.lower() for x in WORD.findall(name)]
        marks = [k for k in (0, len(words) - 1) if words and words[k] in CUT_WORDS or words and not in_article and words[k] in WEAK_WORDS]
        if not marks or STATE_BEFORE & set(words) or len(words) > 1 and words[-1] in STATE_AFTER:
            continue
        if words[0] == "related" and len(words) > 1 and words[1] not in LISTED_WORDS:
            continue
        if tag in LEAF_BLOCKS - {"li"} and len(words) > 1 and not ADVERT_WORDS & {words[0], words[-1]}:
            continue
        if COMMENT_WORDS & {words[0], words[-1]}:
            return "comment"
        sure = any(words[k] not in LAYOUT_WORDS and (k == len(words) - 1 or words[k] in SURE_WORDS) for k in marks)
        out = "mark" if sure or out == "mark" else f"layout:{name}"
    return out


def _cut(tag: str, raw: str, in_article: bool) -> str:
    """"tag" or "comment" if an element is cut, "mark" if it is unless it holds the page, "layout:" and a name if it is unless it reads as
    text, else ""."""
    if tag in CUT_TAGS or tag == "header" and not in_article:
        return "tag"
    out = "mark" if tag == "form" else ""
    if not raw or tag in KEPT_TAGS:
        return out
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = _names(tag, value, in_article)
            if found == "comment":
                return found
            if tag != "article" and (not out or found == "mark"):
                out = found or out
        elif name == "role" and value.lower() in CUT_ROLES - {"form"} or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "tag"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "tag"
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    # nodes in order of their start: tag, parent, last node inside, nearest block, kind of cut, nearest node with one, inside a link
    tags, parent, last, block, kind, near, link, article = ["#"], [0], [0], [0], [""], [0], [False], [False]
    prose: set[int] = set()  # nearest nodes with a kind of cut around paragraphs
    chunks: list[tuple[int, str]] = []
    begin, end_at, raw, first_prose = [0], [len(page)], [""], len(page)
    stack, at = [0], 0

    def pop(to: int, here: int) -> None:
        while len(stack) > to:
            end_at[stack[-1]] = here
            last[stack.pop()] = len(tags) - 1

    def text(value: str, here: int) -> None:
        nonlocal first_prose
        top = stack[-1]
        if value and kind[near[top]] != "tag":
            if here < first_prose and len(value) >= LONG and not link[top] and not kind[near[top]] and len(value.strip()) >= LONG:
                first_prose = here
            chunks.append((top, _html.unescape(value) if "&" in value else value))

    while m := TOKEN.search(page, at):
        text(page[at : m.start()], at)
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3], at)
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    pop(k, at)
                    break
                if tag in INLINE and tags[stack[k]] not in INLINE or tag == "p" and tags[stack[k]] in SCOPE:
                    break
            if tag not in INLINE:
                chunks.append((stack[-1], " "))
            continue
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in closes:
                    pop(k, m.start())
                    break
                if tags[stack[k]] in SCOPE:
                    break
        up = stack[-1]
        inside = article[up] or tag in ("article", "main")
        tags.append(tag)
        parent.append(up)
        last.append(len(tags) - 1)
        begin.append(m.start())
        end_at.append(at)
        raw.append(m[3])
        node = len(tags) - 1
        block.append(block[up] if tag in INLINE else node)
        kind.append("tag" if kind[near[up]] == "tag" else _cut(tag, m[3], article[up]))
        near.append(node if kind[node] else near[up])
        if tag in ("p", "article", "main"):
            prose.add(near[node])
        link.append(link[up] or tag == "a")
        article.append(inside)
        if tag not in INLINE:
            chunks.append((up, " "))
        if tag in VOID or m[3].endswith("/") and tag not in INLINE | LEAF_BLOCKS | SCOPE:
            continue
        stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            text(page[at : end.start()] if end else page[at:], at)
            at = end.end() if end else len(page)
            pop(len(stack) - 1, at)
    text(page[at:], at)
    pop(0, len(page))

    n = len(tags)
    for node in _talk(page, tags, parent, begin, end_at, raw, article, first_prose):
        kind[node] = "tag"
    cut = _cuts(parent, kind, near, prose, chunks, block, link, article)
    chunks = [(node, value) for node, value in chunks if not cut[node]]
    chars, linked, commas = [0] * n, [0] * n, [0] * n
    for node, value in chunks:
        size = len(value) - value.count(" ") if len(value) < 4 else len(" ".join(value.split()))
        if size:
            b = block[node]
            chars[b] += size
            commas[b] += value.count(",") + value.count("，") + value.count("、")
            if link[node]:
                linked[b] += size
    score = [0.0] * n
    for b in range(n):
        if chars[b]:
            plain = 1 - linked[b] / chars[b]
            points = (1 + commas[b] + min(chars[b] / 100, 3) if chars[b] >= 25 else chars[b] / 25) * plain
            to, share = (parent[b] if tags[b] in LEAF_BLOCKS else b), 1.0
            for level in range(LEVELS):
                score[to] += points * share
                if not to:
                    break
                to, share = parent[to], 0.5 if level == 0 else 1 / (3 * (level + 1))
    total, links = [0], [0]
    for k in range(n):
        total.append(total[-1] + chars[k])
        links.append(links[-1] + linked[k])

    def density(k: int) -> float:
        size = total[last[k] + 1] - total[k]
        return (links[last[k] + 1] - links[k]) / size if size else 0.0

    final = [s * (1 - density(k)) if s else 0.0 for k, s in enumerate(score)]
    best = max(range(n), key=lambda k: (final[k], k))
    if not final[best] and not total[-1]:
        return ""
    home, k = best, best
    while k:
        if tags[k] == "article" or tags[k] == "main" and density(k) < 0.5:
            home = k
            if tags[k] == "article":
                break
        k = parent[k]
    kept = [(home, last[home])]
    inner = final[:]  # the best score inside
    for k in range(n - 1, 0, -1):
        inner[parent[k]] = max(inner[parent[k]], inner[k])
    outer = home  # the outermost wrapper that holds nothing else
    while outer and parent[outer] and total[last[parent[outer]] + 1] - total[parent[outer]] == total[last[outer] + 1] - total[outer]:
        outer = parent[outer]
    heads = [k for k in range(n) if tags[k] == "h1" and not cut[k]]
    if len(heads) == 1 and heads[0] < home and last[heads[0]] < home:
        kept.append((heads[0], last[heads[0]]))
    if tags[home] != "main":
        one = tags[home] == "article"
        least = (0.5 if one else 0.2) * final[best]
        for s in range(1, n):
            if s != outer and parent[s] == parent[outer] and not cut[s] and outer:
                size = total[last[s] + 1] - total[s]
                reads = tags[s] in LEAF_BLOCKS and size and density(s) < 0.25
                scores = inner[s] >= least and (final[s] >= least or density(s) < 0.25)
                if (scores and tags[s] == "article" if one else scores or reads) and s not in heads[:1]:
                    kept.append((s, last[s]))
    kept.sort()
    out, spot = [], 0
    for node, value in chunks:
        if (any(a <= node <= b for a, b in kept) if len(kept) < 8 else _inside(kept, node)):
            out.append(value)
            spot = 1
        elif spot:
            out.append(" ")
            spot = 0
    return " ".join("".join(out).split())


def _talk(page: str, tags: list[str], parent: list[int], begin: list[int], end: list[int], raw: list[str], article: list[bool], first_prose: int) -> list[int]:
    """Nodes of readers' comments: repeated siblings after the first prose of the page, or what holds little beside them."""
    found: dict[re.Pattern, list[int]] = {}  # the page is searched once, and only if an element asks

    def has(what: re.Pattern, k: int) -> bool:
        if what not in found:
            found[what] = [m.start() for m in what.finditer(page)]
        return bisect_left(found[what], begin[k]) < bisect_left(found[what], end[k])

    def opens(k: int) -> bool:
        return bool(OPENING.match(page, begin[k], end[k]) and HOLDS.search(page, begin[k] + 1, end[k]))

    def shape(k: int) -> tuple[int, str, str]:
        names = re.search(r"""\bclass\s*=\s*["']?\s*([^\s"'>]*)""", raw[k]) if raw[k] else None
        return parent[k], tags[k], names[1] if names else ""

    alike: dict[tuple[int, str, str], list[int]] = {}
    for k in range(1, len(tags)):
        if tags[k] in ITEMS and begin[k] > first_prose:
            alike.setdefault(shape(k), []).append(k)
    out = []
    for (up, _, _), items in alike.items():
        named = bool(raw[up]) and any(TALK_WORDS & {x.lower() for x in WORD.findall(a or b or c)} for name, a, b, c in ATTRIBUTE.findall(raw[up]) if name.lower() in ("class", "id"))
        if len(items) < 2 and not named:
            continue
        # in an article a date is not enough: entries of a running report bear one too
        told = [k for k in items if (named or not article[up]) and opens(k) and (named or has(DATED, k)) or has(REPLY, k)]
        if len(told) < 0.8 * len(items):
            continue
        held = begin[up] > first_prose and sum(end[k] - begin[k] for k in items) > 0.6 * (end[up] - begin[up])
        if held or named and begin[up] > first_prose:
            out.append(up)
            continue
        out += items
        before = [k for k in range(up + 1, items[0]) if parent[k] == up]
        if before and re.fullmatch("h[1-6]", tags[before[-1]]) and begin[before[-1]] > first_prose:
            out.append(before[-1])
    return out


def _cuts(parent: list[int], kind: list[str], near: list[int], prose: set[int], chunks: list[tuple[int, str]], block: list[int], link: list[bool], article: list[bool]) -> list[bool]:
    """Which nodes are cut: all that have a kind or lie in one that has, but for layout that reads as text and a mark that holds the page."""
    own: dict[int, int] = {0: 0}
    linked: dict[int, int] = {}
    longest: dict[int, int] = {}
    blocks: dict[int, int] = {}
    for node, value in chunks:
        size, s = len(value.strip()), near[node]
        own[s] = own.get(s, 0) + size
        if link[node]:
            linked[s] = linked.get(s, 0) + size
        elif size:
            b = block[node]
            blocks[b] = blocks.get(b, 0) + size
            longest[s] = max(longest.get(s, 0), blocks[b])
    spared = set()
    by_name: dict[str, list[int]] = {}
    for s in own:
        if kind[s].startswith("layout:"):
            by_name.setdefault(kind[s], []).append(s)
    whole = sum(own[s] for s in own if not kind[s] or kind[s].startswith("layout:"))
    for same in by_name.values():
        text, links = sum(own[s] for s in same), sum(linked.get(s, 0) for s in same)
        holds = text >= whole / 3 and links < 0.3 * text and max(longest.get(s, 0) for s in same) >= LONG
        for s in same:
            dense = linked.get(s, 0) >= 0.3 * own[s]
            if own[s] and not dense and (holds or article[s] and longest.get(s, 0) >= LONG):
                spared.add(s)
    if spared:
        for s in list(own):
            to = s
            while to in spared:
                to = near[parent[to]]
            if to != s:
                own[to] = own.get(to, 0) + own[s]
    most = max((s for s in own if kind[s] == "mark" and s in prose), key=lambda s: (own[s], -s), default=0)
    if most and own[most] > 2 * own[0]:
        way, s = {most}, near[parent[most]]
        while s and (kind[s] == "mark" or s in spared):
            way.add(s)
            s = near[parent[s]]
        spared |= way if not s else set()
    cut = [False]
    for k in range(1, len(parent)):
        cut.append(cut[parent[k]] or bool(kind[k]) and k not in spared)
    return cut


def _inside(spans: list[tuple[int, int]], node: int) -> bool:
    k = bisect_right(spans, (node, 1 << 60)) - 1
    return k >= 0 and node <= spans[k][1]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, "html"):
                texts = [main_text(h) for h in p.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
