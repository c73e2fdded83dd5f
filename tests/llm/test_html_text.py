import html
import re

from textquarry.llm import html_text as H

LAYOUT = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header id="site-header"><a href="/">Home</a></header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, a very long notice about cookies and nothing else at all.</p></div>
<div id="wrap"><div class="content c12"><h1>The &eacute;tude &amp; more</h1><!-- <p>no</p> -->
<p>First  paragraph<br>with <b>bold</b> and <a href="#">a link</a>.<p class="advert">Buy now!</p><p>Second &lt;one&gt; &#8212; done &amp nbsp;
<script>document.write("<p>x</p>")</script><ul><li>item one</li><li>item two</li></ul>
<form><p>Your name</p><input></form><blockquote>Quoted words here.</blockquote></div>
<aside><p>Side text that is fairly long but belongs to the side.</p></aside>
<section class="comments"><article class="comment"><p>A reader comment that goes on and on and on and on and on.</p></article></section></div>
<footer>&copy; nobody</footer></body></html>"""
WANT = "The étude & more\n\nFirst paragraph with bold and a link.\n\nSecond <one> — done & nbsp;\n\nitem one\n\nitem two\n\nQuoted words here."


def test_general_layout():
    assert H.text_of(LAYOUT, None) == WANT
    assert H.text_of(LAYOUT.replace('<div class="content c12">', "<article>").replace("</blockquote></div>", "</blockquote></article>"), None) == WANT


def test_consensus_path_and_edges(spark):
    thin = LAYOUT.replace("First  paragraph", "")
    rows = [(k, f"https://www.Host.example/{k}", LAYOUT.replace("c12", f"c{k}")) for k in range(5)]
    rows += [(9, "http://host.example/x", thin), (10, None, LAYOUT), (11, "http://host.example", None), (12, "x", ""), (13, "//a.b", "just < text & more"), (13, "//a.b", "just < text & more"), (14, "http://c.d", "<p>" + "long words " * 90_000 + "<!-- open")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in H.extract(frame).collect()}
    assert H.extract(frame).count() == len(rows)
    for k in range(5):
        assert found[k].text == WANT and found[k].path == ">html>body.page>div>div.c.content" and found[k].n_chars == len(WANT)
    assert found[10].text == WANT and found[10].path is None
    assert found[11].text == "" and found[12].text == "" and found[13].text == "just < text & more"
    assert found[14].n_chars == 989_999
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_table_against_plain_rule(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r for r in H.op10_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(pages)
    for p in pages:
        body = re.search("<article>(.*?)</article>", p.html, re.DOTALL)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", ""))]
        assert found[p.page_id].text == "\n\n".join(x for x in want if x), p.page_id
        assert found[p.page_id].n_chars == len(found[p.page_id].text) and found[p.page_id].url == p.url


INTRO, BODY = "An introduction of some length. " * 10, "The body of the article goes on. " * 30


def test_text_outside_the_widest_child_is_kept(spark):
    whole = f'<html><body><nav><a href="/">Home</a></nav><div class="content"><div class="intro"><p>{INTRO}</p></div><div class="body"><p>{BODY}</p></div></div><div><a href="/x">more</a></div></body></html>'
    assert H.text_of(whole, None) == f"{INTRO.strip()}\n\n{BODY.strip()}"
    assert H.vote(whole)[0] == ">html>body>div.content"
    # The winning path of the host is a teaser box on pages of another template.
    usual = f'<html><body><div class="box"><p>{BODY}</p></div></body></html>'
    other = f'<html><body><div class="box"><p>{INTRO}</p></div><div class="story"><p>{BODY}</p></div></body></html>'
    rows = [(k, f"http://h.example/{k}", usual if k < 4 else other) for k in range(5)]
    found = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[4].path == ">html>body>div.box" and found[4].text == f"{INTRO.strip()}\n\n{BODY.strip()}"
    assert {found[k].text for k in range(4)} == {BODY.strip()}


def test_unclosed_cdata_and_class_words_within_an_article():
    assert H.text_of("<p>first</p><![CDATA[last words", None).endswith("last words")
    assert H.text_of("<p>a <![CDATA[b < c]]> d</p>", None) == "a b < c d"
    page = f'<article><p>{BODY}</p><div class="search results"><p>{INTRO}</p></div><div class="share widget"><a href="#">Share this</a> <a href="#">Send</a></div><div class="advert"><p>{INTRO}</p></div><p>End.</p></article>'
    assert H.text_of(page, None) == f"{BODY.strip()}\n\n{INTRO.strip()}\n\nEnd."


def test_deep_nesting_takes_time_in_proportion():
    import time

    took = []
    for depth in (4000, 32000):
        page = "<div class='x'>" * depth + "<p>deep words</p>" * 50 + "</section></div>" * depth
        began = time.perf_counter()
        assert H.text_of(page, "".join([">div.x"] * depth)) == "\n\n".join(["deep words"] * 50)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_winners_by_salted_join(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}" if k % 5 else None, f"<html><body><div class='box'><p>{BODY}{k}</p></div></body></html>") for k in range(40)] + [(3, "http://h0.example/3", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, H.extract(frame).collect()))
    monkeypatch.setattr(H, "SENT_HOSTS", 0)
    assert sorted(map(str, H.extract(frame).collect())) == want and len(want) == len(rows)
