import re
from html import unescape

import pyarrow.parquet as pq
import pytest

from vellum.llm.html import extract, main_text, op8_html

SF = "/root/testdata/sf0.01"


def brute(html):
    """What the fixture's pages hold between their article marks."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = op8_html(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == brute(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


LONG = "This sentence of the article is long enough, has commas, and says something useful to its readers. " * 3


def test_furniture_goes_and_article_stays():
    html = f"""<html><head><title>T</title><style>x</style></head><body class=page>
    <header id=top><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, {LONG}</p></div>
    <div id=main><div class=post><header><h2>Title &amp; more</h2></header>
    <p>First&nbsp;one. {LONG}<p>Second <b>bold<br>line</b> <a href=x>link</a>. {LONG}
    <div class="share">Share this</div><ul><li>One item<li>Two items</ul>
    <table><tr><td>a<td>b<tr><td>c</table><blockquote>Quote &lt;here&gt; {LONG}</blockquote></div>
    <div class="comments"><p>{LONG} reader</p></div></div>
    <aside><p>{LONG} aside</p></aside><form><p>{LONG}</p></form><script>if (a < b) "</p>"</script>
    <footer>&copy; me</footer></body></html>"""
    long = " ".join(LONG.split())
    assert main_text(html).split("\n\n") == ["Title & more", f"First one. {long}", f"Second bold line link. {long}", "One item", "Two items",
                                             "a", "b", "c", f"Quote <here> {long}"]


def test_siblings_and_link_lists():
    html = f"<body><div><a href=1>one, two, three, four</a> <a href=2>five, six, seven, eight</a></div><div><p>{LONG}</p></div><p>Plain tail.</p></body>"
    assert main_text(html).split("\n\n") == [" ".join(LONG.split()), "Plain tail."]


def test_broken_markup():
    assert main_text("") == main_text("<") .replace("<", "") == ""
    assert main_text("<p>a &am") == "a &am" and main_text("<p>a < b & c</p>") == "a < b & c"
    assert main_text("<!-- <p>no</p> --><p>yes") == "yes" and main_text("<script><p>no") == ""
    assert main_text("<nav><p>only menus</p></nav>") == ""
    assert main_text("<div><p>x</div></p></span>y") .startswith("x")
    assert main_text("<p>" + "word " * 300_000).count("word") == 300_000
    assert main_text("<div>" * 20_000 + "deep") == "deep"


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (None, None, "<p>hi</p>", "t"), (1, "u", None, "t"), (2, "v", "", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(frame).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, "v", "", 0), (None, None, "hi", 2)], key=str)
    assert extract(frame.limit(0)).count() == 0


def test_deep_nesting_keeps_order_and_time_in_proportion():
    words = [f"word{i}, and more of it" for i in range(20_000)]
    html = "".join(f"<div><p>{w}" for w in words)
    assert main_text(html).split("\n\n") == words[-len(main_text(html).split("\n\n")):]
    closed = "<div>" * 20_000 + "<p>inner text, here</p>" + "</div>" * 20_000
    assert main_text(closed) == "inner text, here"


@pytest.mark.parametrize("name", ["content no-sidebar", "layout with-sidebar", "container has-banner", "main-wrap nav-fixed", "post tag-news",
                                  "elementor-widget", "widget", "sidebar content"])
def test_an_article_in_a_wrapper_named_like_furniture_stays(name):
    want = [" ".join(LONG.split())] * 3
    inner = f"<p>{LONG}<p>{LONG}<p>{LONG}<div class=share>Share this</div><div class=comments><p>{LONG} reader</p></div>"
    assert main_text(f'<body><div class="{name}">{inner}</div></body>').split("\n\n") == want
    assert main_text(f"<body><form action=x>{inner}<fieldset>Sign here</fieldset></form></body>").split("\n\n") == want


@pytest.mark.parametrize("before", [
    "<p class=notice>We use cookies", "<ul><li class=share>Share<li>x</ul>", "<table><tr><td class=ad>Buy<td>x</table>",
    "<dl><dt class=ad>Buy<dd>x</dl>", "<div class=share>Share", "<p>x <span class=ad>Buy", "<p>x <span class=ad>Buy <span>now</span></span>"])
def test_furniture_left_open_ends_as_other_elements_do(before):
    text = main_text(f"<body><article>{before}<p>{LONG}<p>{LONG}</article></body>")
    assert text.split("\n\n")[-2:] == [" ".join(LONG.split())] * 2 and "Buy" not in text and "cookies" not in text


def test_furniture_of_compound_names_in_the_article():
    body = "".join(f"<p>Sentence number {i} of the article, with commas, and with enough text to count.</p>" for i in range(6))
    names = ["related-posts", "user-comments", "comment-thread", "share-buttons", "ad-slot", "site-footer", "main-nav", "newsletter-form"]
    for name in names:
        page = f"<html><body><div class=content>{body}<div class='{name}'><p>Leave this out, it is, by its name, no part of the text.</p></div></div></body></html>"
        text = main_text(page)
        assert "Leave this out" not in text and text.count("Sentence number") == 6, name
    for name in ("related-work", "social-history", "post tag-news", "no-sidebar", "content has-banner", "comment-on-kant"):
        page = f"<html><body><div class=content>{body}<div class='{name}'><p>Keep this in, as it is, by its name, a part of the text.</p></div></div></body></html>"
        assert "Keep this in" in main_text(page), name
    assert main_text(f"<body><div class='main-nav user-comments'>{body}</div></body>").count("Sentence") == 6  # holds most of the page


def test_menus_without_names():
    body = "".join(f"<p>Sentence number {i} of the article, with commas, and with enough text to count.</p>" for i in range(6))
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    text = main_text(f"<body><div>{menu}{body}</div></body>")
    assert "Home" not in text and text.count("Sentence number") == 6
    assert "Home" in main_text(f"<body><div>{body}{menu}{body}</div></body>")  # after text a list is the article's
    plain = "<ul><li>First point</li><li>Second point</li></ul>"
    assert "First point" in main_text(f"<body><div>{plain}{body}</div></body>")
