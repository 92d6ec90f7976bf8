import random
import time
from itertools import product

from pyspark.sql import functions as F

from briefspark.llm import mincut as m
from tests.llm.cases import CLASHING, prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header><h1>Site</h1><p>Our motto is a long sentence here. It goes on.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to improve. Accept them all please.</p></div><!-- <p>hidden</p> -->
<div class="ad">Buy this now. It is good.</div>
<main><div class="post-content"><header class="post-header"><h1>Title</h1></header>
<p>First &amp; <b>best</b> para with <a href=x>link</a>
 text.<br>Next&nbsp;line.<p>An unclosed one, which is long. And &lt;so&gt; on.
<ul><li>one<li>two</ul><blockquote>Quoted words.</blockquote><table><tr><td>a<td>b</table>
<form><p>Your mail address please. Send it.</p><input><select><option>x</select></form>
<aside class="related"><p>Related things here. More of this.</p></aside></div>
<section id="comments"><h2>Comments</h2><p>Great post! I liked it very much.</p></section></main>
<div class="sidebar"><p>Side words that are many. And more.</p></div>
<footer><p>Copyright 2020 by us.</p></footer></body></html>"""
TEXT = "Title\nFirst & best para with link text. Next line.\nAn unclosed one, which is long. And <so> on.\none\ntwo\nQuoted words.\na\nb"


def test_article_without_what_is_around_it():
    assert m.main_text(PAGE) == TEXT


def test_page_without_article_element():
    paragraphs = [prose(n, 40) + "." for n in range(4)]
    body = "".join(f"<p>{p}</p>" for p in [*paragraphs[:2], "Short one.", *paragraphs[2:]])
    page = f'<div><a href=/>Home</a> <a href=/b>About</a></div><div><h2>Headline</h2>{body}</div><div><a href=x>Privacy</a> | <a href=y>Terms</a></div>'
    assert m.main_text(page) == "\n".join(["Headline", *paragraphs[:2], "Short one.", *paragraphs[2:]])


def test_names_that_only_say_what_a_page_has():
    text = prose(3, 40) + "."
    for wrapper in ('<div class="page has-sidebar no-comments">', '<main class="with-sidebar">', '<article class="post sidebar-left">', '<div title="a hidden gem">'):
        assert m.main_text(f"<body>{wrapper}<p>{text}</p></body>") == text, wrapper
    for wrapper in ('<article class="comment">', '<div class="readerComments">', '<div hidden>', '<div style="display: none">', '<div role="navigation">', '<ul id="main-menu">'):
        assert m.main_text(f"<body><article><p>{text}</p></article>{wrapper}<p>{text}</p></body>") == text, wrapper


def test_names_are_doubts_that_text_outweighs():
    one, two, three = (prose(n, 40) + ". And more of it. The end." for n in (5, 6, 7))
    for inner, heading in [('<h2 id="discussion">', "Discussion"), ('<h2 id="how-to-search">', "How to search")]:
        page = f"<body><nav><a href=/>Home</a></nav><article><p>{one}</p>{inner}{heading}</h2><p>{two}</p></article><footer>end</footer></body>"
        assert m.main_text(page) == "\n".join([one, heading, two]), inner
    for inner in ('<section id="related-work">', '<div class="hidden md:block">'):
        page = f"<body><article><p>{one}</p>{inner}<p>{two}</p></{inner[1:].split()[0]}><p>{three}</p></article></body>"
        assert m.main_text(page) == "\n".join([one, two, three]), inner
    for wrapper in ('<div class="right-sidebar">', '<div class="layout sidebar-right">', '<div class="sidebar">', "<form>"):
        page = f"<body>{wrapper}<nav><a href=/>Home</a></nav><main><article><p>{one}</p><p>{two}</p></article></main><aside>Side.</aside></{wrapper[1:5].rstrip(' >')}></body>"
        assert m.main_text(page) == "\n".join([one, two]), wrapper
    assert m.main_text(f"<body><form><p>{one}</p><p>{two}</p></form></body>") == "\n".join([one, two])
    comments = "".join(f"<p>{prose(n, 30)}.</p>" for n in range(20))
    assert m.main_text(f'<body><article><p>{one}</p></article><div id="comments">{comments}</div></body>') == one


def test_long_page_is_whole():
    paragraphs = [prose(n, 30) for n in range(3000)]
    page = "<article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article><footer>end</footer>"
    assert m.main_text(page) == "\n".join(paragraphs)


def test_broken_markup():
    for page, text in [
        ("", ""), (None, ""), ("   ", ""), ("plain &amp; text\n here", "plain & text here"), ("<p>" * 3000, ""),
        ("<article><p>x < y and a<b>c</b></p>", "x < y and ac"), ("<article><p>a</div></span>b", "ab"), ("<article>a<script>b", "a"),
        ("<article>a<!-- b", "a"), ("<nav>a</nav>", ""), ("<article><p>a</p><![unknown x]><p>b", "a\nb"),
    ]:
        assert m.main_text(page) == text, page


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.randrange(1, 8)
        source, sink = ([rng.randrange(9) for _ in range(size)] for _ in range(2))
        edges = [(a, b, rng.randrange(1, 6)) for a in range(size) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(t if s else f for s, f, t in zip(side, source, sink)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(m.min_cut(source, sink, edges)) == min(cost(side) for side in product((True, False), repeat=size))


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in [*CLASHING, "text", "n_chars"]})
    got = sorted(map(tuple, m.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert m.extract(pages.limit(0)).count() == 0


def test_short_pages_are_kept():
    for page, text in [
        ("<p>a &amp; b &nbsp; c &lt;x&gt; &#8364;</p>", "a & b c <x> €"),
        ("<p>A</p>", "A"),
        ("<p>if a < b then c > d</p>", "if a < b then c > d"),
        ("<div><div><span>one short text</span></div></div>", "one short text"),
        ('<article><p>See</p><ul><li><a href="x">first link</a><li><a href="y">second link</a></ul></article>', "See\nfirst link\nsecond link"),
    ]:
        assert m.main_text(page) == text


def test_adverts_comments_and_notices_go_at_any_length():
    article = "<article>" + "".join(f"<p>Paragraph {n} of the article says something of its own, at length.</p>" for n in range(6)) + "</article>"
    long = "<p>" + "Buy this now, it is cheap and good. " * 125 + "</p>"
    for unwanted in (
        f'<main>{article}<div class="advert">{long}</div></main>',
        f'<main>{article}</main><div class="comment">{long}</div>',
        f'{article}<div id="disqus_thread"><article>{long}</article></div>',
        f'{article}<div class="alert alert-info">{long[:330]}</p></div>',
        f'<div class="cookie-notice">{long[:600]}</p></div><main>{article}</main>',
    ):
        got = m.main_text(f"<html><body>{unwanted}</body></html>")
        assert "Buy" not in got and got.count("Paragraph") == 6
    wrapped = m.main_text(f'<body><div class="comments-enabled"><div class="ad">{article}</div></div></body>')
    assert wrapped.count("Paragraph") == 6


def test_broken_markup_takes_linear_time():
    size = 200_000
    for part in ("<a ", "<a href='", '<a b="', '<a b=">', "<i>", "<i><b></u>", "<div>", "<li>", "<p><i></b>", "<!-", "</a", '<a "\'>'):
        page = "start " + part * (size // len(part)) + " end</b> <p>text</p>"
        begin = time.perf_counter()
        m.main_text(page)
        assert time.perf_counter() - begin < 4, part
    assert m.main_text("<p>text <a ") == "text <a" and m.main_text("<p>x <a b='y>z</a> w") == "x z w"
