from __future__ import annotations

import pytest

from newsloom.llm import html_text, url_rules
from newsloom.llm.queries import URL_RULES

PAGE = """<!doctype html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header class="site-header"><a href=x>Home</a> The Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this long page better for every single reader.</div><main><article>
<header><h1>Real &amp; title</h1><p class="byline">By X</p></header><p>First &eacute; paragraph which is  quite long, and has
<a href=x>a link</a> inside, and more.<p><b>Short.<br>Two</b></p><aside>Side</aside><div class="ad">Buy now</div><span class="ad">Buy</span>
<ul><li>one item<li>two item</ul><form><label>Mail</label><input></form><p hidden>gone</p><p>Last &#8217; one<script>x<y</script></p><!-- no --></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>A long reader comment that is no part of the article at all.</p></article></section>
</main><div class="sidebar"><p>Other stuff that is long enough to look like text</p></div><footer>&copy; 2024</footer></body></html>"""
WANT = "Real & title\nFirst é paragraph which is quite long, and has a link inside, and more.\nShort. Two\none item\ntwo item\nLast ’ one"


def test_article_without_what_is_around_it():
    assert html_text.main_text(PAGE) == WANT


def test_page_without_an_article_element():
    page = PAGE.replace("<main><article>", '<div><div class="post">').replace("</article>\n<section", "</div>\n<section").replace("</main>", "</div>")
    assert html_text.main_text(page) == WANT.split("\n", 1)[1]


def test_broken_and_empty_pages():
    assert html_text.main_text("") == "" == html_text.main_text("<html><script>x") == html_text.main_text("<nav></nav>")
    assert html_text.main_text("plain") == "plain"
    assert html_text.main_text("<article><p>a<p>b &lt;c&gt;<div>d") == "a\nb <c>\nd"
    assert html_text.main_text("<form><div><p>all inside a form</p></div></form>") == "all inside a form"
    assert html_text.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_smoothing_and_threshold():
    import numpy as np

    flat = html_text.smooth(np.full(9, 4.0))
    assert np.allclose(flat, 4.0)
    assert 2 < html_text.threshold(np.array([1.0, 1.5, 2, 9, 10, 11])) < 9
    assert html_text.threshold(np.array([3.0, 3.0])) == 3.0


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "u", "", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=str)
    assert html_text.extract_text(pages.where("false")).count() == 0


def brute(url, rules, default="allow"):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:cut])
    path = tail[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h) + len(p), len(h), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "://x", "http://EXAMPLE.org/es/a?b#c", "https://www.example.org/en/12", "http://example.org/en/2",
    "http://badexample.org/es/", "http://a.com/fr/", "http://a.com/de/x://y", "http://a.com", "http://com/de/", "http://org/", "http://a.org?x=/",
    "ftp://Ä.com/fr/é", "http://a..com/fr/", "http://a.com:80/fr/", "http://a.com/de/" + "x" * 3000, "http://x://example.org/es/",
]


@pytest.mark.parametrize("rules", [URL_RULES, [], [("", "", "block"), ("com", "", "allow"), ("a.com", "/d", "block"), ("com", "/de/", "allow")]])
def test_url_rules_equal_brute_force(spark, rules):
    rows = [(i % 15, u, "h", "p", "r") for i, u in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string").repartition(3)
    table = spark.createDataFrame(rules, url_rules.RULE_SCHEMA)
    got = sorted(map(tuple, url_rules.judge_urls(pages, table).collect()), key=str)
    assert got == sorted([(i, u, *brute(u, rules)) for i, u, *_ in rows], key=str)
    assert url_rules.judge_urls(pages.where("false"), table).count() == 0


def test_rules_with_nulls_and_contradictions(spark):
    rules = [("COM", "/x", "allow"), ("com", "/x", "block"), (None, "/", "block"), ("com", None, "allow"), ("com", "/", None), ("com", "/", "odd")]
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/y")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULE_SCHEMA), "block").collect()}
    assert got == {1: ("com/x", "block"), 2: ("com", "allow")}


def test_only_built_in_functions(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = url_rules.judge_urls(pages, spark.createDataFrame(URL_RULES, url_rules.RULE_SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
