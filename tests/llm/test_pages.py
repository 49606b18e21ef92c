"""Main text of hand-made pages, by words."""

import re
from collections import Counter

import pytest

from corpuslens.llm import html

from pages import A, PAGES, B, P, split


def words(t):
    return re.findall(r"\w+", t)


def measured():
    found = wanted = right = 0
    for page in PAGES.values():
        source, article = split(page)
        got, want = Counter(words(html.main_text(source))), Counter(words(article))
        found, wanted, right = found + got.total(), wanted + want.total(), right + (got & want).total()
    return right / found, right / wanted


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    source, article = split(PAGES[name])
    got, want = Counter(words(html.main_text(source))), Counter(words(article))
    right = (got & want).total()
    assert right / got.total() >= 0.95 and right / want.total() >= 0.95, html.main_text(source)


def test_precision_and_recall_of_all_pages():
    assert len(PAGES) >= 30
    precision, recall = measured()
    assert precision >= 0.99 and recall >= 0.99


def test_nothing_else_is_dropped_and_white_space_is_one_space():
    source, article = split("<article><p>[[a\n b\tc]]</p><div>[[d<b>e</b>]]</div><p class='related-work'>[[f]]</p></article>".replace("<b>", "").replace("</b>", ""))
    assert html.main_text(source) == article == "a b c de f"


def test_awkward_pages(spark):
    source, _ = split(f"<article>{P}</article>")
    long = "<article>" + f"<p>{A}</p>" * 20_000 + "</article>"
    rows = [(1, "u", source, 5), (1, "u", source, 5), (2, None, None, 1), (3, "v", "", 1), (4, "w", long, 1), (None, "x", "<p>", 1), (5, "y", "<div " * 3000, 1), (6, "z", "<p>a<p>a</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = [(r.page_id, r.url, r.n_chars, len(r.text)) for r in html.extract(df).collect()]
    assert len(got) == len(rows) and all(a == b for *_, a, b in got)
    sizes = {i: n for i, _, n, _ in got}
    assert sizes[1] > len(A + B) and sizes[2] == sizes[3] == 0 and sizes[4] == 20_000 * (len(A) + 1) - 1 and sizes[6] == 3
    assert html.extract(df.limit(0)).count() == 0
