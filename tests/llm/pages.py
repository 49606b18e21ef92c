"""Hand-made pages of varied templates; what stands in [[ ]] is the article."""

A = "The council met on Tuesday, and after four hours of debate it voted, narrowly, to keep the bridge open through the winter."
B = "Engineers had warned that the old cables, laid in 1931, would need constant watching, but a full closure would cut the valley off."
C = "Residents said they were relieved, though several asked who would pay for the inspections, and when the repairs would begin."
D = "Short remark."
E = "In a letter, the county promised a first report by spring; the mayor, who had argued for closure, said she would publish it."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/sport>Sport</a></li><li><a href=/about>About us</a></li></ul>"
P = f"<p>[[{A}]]</p><p>[[{B}]]</p><p>[[{C}]]</p>"
SIDE = "<h3>Most read</h3><ul><li><a href=/1>Storm closes the harbour road</a></li><li><a href=/2>School wins the cup</a></li></ul>"
COMMENTS = "<p>I drive over it every day, and frankly, it shakes, it rattles, and nobody listens to us.</p><p>Well said, they never listen, and they never will, will they?</p>"
FORM = "<form action=/s><label>Search this site</label><input name=q><button>Go</button></form>"

PAGES = {
    "article": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article><h1>[[Bridge stays open]]</h1>{P}</article><footer>Imprint, privacy, terms.</footer></body></html>",
    "form_around_page": f"<body><form id=aspnetForm method=post><div class=menu>{MENU}</div><div id=content><h1>[[Bridge stays open]]</h1>{P}</div><div class=footer>Imprint, privacy, terms.</div></form></body>",
    "form_around_article": f"<body><form><article>{P}</article><input type=submit></form></body>",
    "search_form": f"<body>{FORM}<div id=main>{P}</div>{FORM}</body>",
    "login_in_article": f"<article>{P}<form><p>Log in to read on, or register for free, it only takes a minute.</p><input></form></article>",
    "table_layout": f"<table><tr><td width=150>{MENU}</td><td><h1>[[Bridge stays open]]</h1><p>[[{A}]]<p>[[{B}]]<p>[[{C}]]</td><td class=sidebar>{SIDE}</td></tr></table>",
    "has_sidebar": f'<body class="page has-sidebar comments-open"><div class="container overflow-hidden"><div class=entry-content>{P}</div></div><div id=sidebar>{SIDE}</div></body>',
    "no_sidebar": f'<div class="layout no-sidebar"><div class=story>{P}</div></div><div class="site-footer">Imprint</div>',
    "content_sidebar_wrap": f'<div class="content-sidebar-wrap"><main class=content>{P}</main><aside class="sidebar widget-area">{SIDE}</aside></div>',
    "related_work": f'<article><h1>[[A study of bridges]]</h1><p>[[{A}]]</p><section class="related-work"><h2>[[Related work]]</h2><p>[[{B}]]</p></section><p class="related-work">[[{C}]]</p></article>',
    "related_posts": f'<article>{P}<div class="related-posts"><h3>Related</h3><p>Storm closes the harbour road, and the ferry, for the third time, stays in port.</p></div></article>',
    "related_alone": f"<div><div class=post>{P}</div><div class=related><a href=/1>Storm closes road</a><a href=/2>Cup won</a></div></div>",
    "comments": f"<article>{P}</article><section id=comments><h2>2 comments</h2>{COMMENTS}</section>",
    "comment_articles": f'<main><article class=post>{P}</article><ol class="comment-list"><li><article class=comment>{COMMENTS}</article></li></ol></main>',
    "many_comments": f"<div class=post><p>[[{A}]]</p></div><div class=comments-area>{COMMENTS * 5}</div>",
    "cookie_notice": f'<div class="cookie-notice"><p>We use cookies, ours and others, to measure, improve, and tailor what you see.</p></div><div class=text>{P}</div>',
    "role_dialog": f'<div role=dialog aria-modal=true><p>Subscribe now, pay later, cancel at any time, and read everything.</p></div><main>{P}</main>',
    "adverts": f'<article><p>[[{A}]]</p><div class="ad-slot">Buy a car, cheap, fast, today, at Miller and Sons.</div><p>[[{B}]]</p><p class="advert">Buy two cars, cheaper, faster.</p><p>[[{C}]]</p></article>',
    "adsbygoogle": f'<div id=body-text>{P}<ins class="adsbygoogle">ad text here, buy, buy, buy</ins></div>',
    "share_bar": f'<article><div class="share-buttons"><a href=#>Share</a><a href=#>Post</a></div>{P}<div class="social-links">Follow us</div></article>',
    "breadcrumbs": f'<div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/n>News</a></div><div class=article-body><h1>[[Bridge stays open]]</h1>{P}</div>',
    "article_header": f'<article><header class="article-header"><h1>[[Bridge stays open]]</h1></header>{P}<footer>Filed under: bridges</footer></article>',
    "site_header": f'<header><h2>The Valley Post</h2><p>News from the valley, every day, since 1931.</p></header><div>{P}</div>',
    "h1_apart": f'<div class=page><div class=title-wrap><h1>[[Bridge stays open]]</h1></div><div class=columns><div class=story>{P}</div></div></div>',
    "br_paragraphs": f"<body><div class=nav>{MENU}</div><div class=story>[[{A}]]<br><br>[[{B}]]<br><br>[[{C}]]</div></body>",
    "unclosed": f"<body><ul class=menu><li><a href=/>Home<li><a href=/n>News</ul><div><p>[[{A}]]<p>[[{B}]]<p>[[{C}]]",
    "blockquote_list": f"<article>{P}<blockquote><p>[[{E}]]</p></blockquote><ul><li>[[First, the cables.]]</li><li>[[Second, the deck.]]</li></ul><pre>[[x = 1]]</pre></article>",
    "links_in_text": f'<div class=menu>{MENU}</div><div class=body><p>[[The council, as]] <a href=/r>[[reported before]]</a>[[, met on Tuesday, and voted, narrowly, to keep the bridge open.]]</p>{P}</div>',
    "short_paragraphs": f"<article><p>[[{A}]]</p><p>[[{D}]]</p><p>[[{B}]]</p><p>[[{D}]]</p></article>",
    "sections": f"<main><section><h2>[[What was decided]]</h2><p>[[{A}]]</p></section><section><h2>[[What comes next]]</h2><p>[[{C}]]</p><p>[[{E}]]</p></section></main>",
    "entities": "<article><p>[[Fish &amp; chips cost &lt;5&gt; &euro;, &quot;they&quot; said, caf&#233;&nbsp;owners&#x2019; prices, and so on.]]</p></article>",
    "noscript_iframe": f"<body><noscript><p>Turn on scripts, please, it works better.</p></noscript><iframe src=x>frame text</iframe><div>{P}</div><template><p>hidden, unused, text.</p></template></body>",
    "hidden": f'<div style="display: none"><p>Hidden, secret, unseen text, which is long.</p></div><div hidden><p>Hidden too, quite long, with commas.</p></div><div>{P}</div>',
    "newsletter": f'<article><p>[[{A}]]</p><div class="newsletter-signup"><p>Sign up, stay informed, every morning, for free.</p></div><p>[[{B}]]</p></article>',
    "aside_teasers": f"<main><article>{P}</article></main><aside><article><p>Storm closes the harbour road, and the ferry stays in port, again.</p></article></aside>",
    "nested_divs": f"<div><div><div><div><div><p>[[{A}]]</p></div><div><p>[[{B}]]</p></div><div><p>[[{C}]]</p></div></div></div></div><div class=footer-links>{MENU}</div></div>",
    "definition_list": f"<article><p>[[{A}]]</p><dl><dt>[[Cable]]<dd>[[What holds the deck, mostly.]]<dt>[[Deck]]<dd>[[What you drive on.]]</dl></article>",
    "data_table": f"<article><p>[[{A}]]</p><table><tr><th>[[Year]]</th><th>[[Cost]]</th></tr><tr><td>[[1931]]</td><td>[[12]]</td></tr></table><p>[[{B}]]</p></article>",
    "page_builder": f"<body><div class=menu>{MENU}</div><div class='elementor-element elementor-widget'><h2>[[What was decided]]</h2></div><div class='elementor-element elementor-widget'><p>[[{A}]] [[{B}]]</p></div><div class='elementor-element elementor-widget'><p>[[{C}]] [[{E}]]</p></div></body>",
    "widget_in_main": f"<main><div class='text-widget'><p>[[{A}]]</p></div><p>[[{B}]]</p><div class=widget><ul><li><a href=/1>Storm closes the harbour road</a></li></ul></div></main>",
    "widgets_beside": f"<div class=post>{P}<p>[[{E}]]</p></div><div class=widget><p>This paper has told the valley's news, good and bad, since 1931.</p></div>",
    "hidden_on_phones": f"<article><p>[[{A}]]</p><div class=hidden-xs><p>[[{B}]]</p></div><div class=hidden><p>An unused text, long enough, it seems, to be read as one by a machine.</p></div></article>",
    "share_price": f"<article><p>[[{A}]]</p><div class=share-price><p>[[{B}]]</p></div><div class=share-links><a href=/s>Share this</a></div></article>",
    "topic_names": f"<main><section class=navigation-systems><p>[[{A}]]</p></section><section id=banner-year><p>[[{B}]]</p></section></main>",
    "table_rows": f"<table class=layout><tr><td><p>[[{A}]] [[{B}]]</p></td></tr><tr><td><p>[[{C}]] [[{E}]]</p></td></tr></table>",
    "grid_rows": f"<div class=grid><div class=row><div class=col><p>[[{A}]] [[{B}]]</p></div></div><div class=row><div class=col><p>[[{C}]] [[{E}]]</p></div></div></div>",
    "two_articles": f"<div class=posts><article><p>[[{A}]] [[{B}]]</p></article><article><p>[[{C}]] [[{E}]]</p></article></div>",
    "article_and_teasers": f"<div><article>{P}<p>[[{E}]]</p></article><article><h3><a href=/1>Storm</a></h3><p>The ferry stays in port.</p></article></div>",
    "discussion": f"<div class=post>{P}</div><div class=discussion><h3>8 thoughts</h3>" + "".join(f"<div><b>{n}</b> <span>3 May 2021</span>{COMMENTS}</div>" for n in ("Ann", "Bo", "Cy", "Di")) + "</div>",
    "thread": f"<article>{P}</article><ol class=thread>" + "".join(f"<li><strong>{n}</strong><p>I drive over it every day, and frankly, it shakes, it rattles, and nobody listens.</p></li>" for n in ("Ann", "Bo", "Cy")) + "</ol>",
    "unnamed_comments": f"<div id=c><div class=t>{P}</div><div class=x>" + "".join(f"<div class=y><a href=/u>{n}</a><time>2 hours ago</time><p>I drive over it every day, and frankly, it shakes, it rattles, and nobody listens.</p></div>" for n in ("Ann", "Bo", "Cy")) + "</div></div>",
    "reply_links": f"<main><p>[[{A}]]</p><p>[[{B}]]</p><h4>Readers</h4>" + "".join(f"<div class=y><p>{n}: I drive over it every day, and frankly, it shakes, it rattles.</p><a href=#>Reply</a></div>" for n in ("Ann", "Bo")) + "</main>",
    "running_report": f"<article><p>[[{A}]]</p><div class=e><b>[[Vote]]</b> <time>[[10:31]]</time><p>[[{B}]]</p></div><div class=e><b>[[Debate]]</b> <time>[[09:12]]</time><p>[[{C}]]</p></div></article>",
    "interview": f"<div class=story><p>[[{A}]]</p><div><b>[[Mayor]]</b><p>[[{B}]]</p></div><div><b>[[Post]]</b><p>[[{C}]]</p></div></div>",
    "timeline": f"<div class=story><p>[[{A}]]</p><ul><li><b>[[March]]</b> [[3 March 1931, the cables are laid.]]</li><li><b>[[May]]</b> [[1 May 1990, the deck is renewed, at last.]]</li></ul><p>[[{B}]]</p></div>",
    "cjk": "<div class=menu><a href=/>首页</a></div><div class=content><p>[[议会周二开会，经过四个小时的辩论，以微弱多数投票决定冬季保持大桥开放。]]</p><p>[[工程师警告说，旧缆绳需要经常检查，但是完全关闭会使山谷与外界隔绝。]]</p></div>",
}


def split(page: str) -> tuple[str, str]:
    """(html, the article's text)."""
    import html
    import re

    marked = [" ".join(html.unescape(x).split()) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S)]
    return page.replace("[[", "").replace("]]", ""), " ".join(marked)
