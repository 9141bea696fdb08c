import time

import pytest

from driftline.llm.html_extract import html_extract, main_text

LONG = "Words that make a paragraph long enough to be told from a menu, with commas and a full stop at its end."


def test_article_without_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p><p>no</p>";</script></head>
    <body><header><a href="/">Site</a> top line</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
    <div class="ad-slot">Buy now</div><div class="cookie-notice"><p>{LONG}</p></div>
    <article><header><h1>Head &eacute;&#33;</h1><span>by someone</span></header><p><b>One<br>two&nbsp;  three<p>Short.</p>
    <form><input name=q><button>Go</button></form><aside>{LONG}</aside><ul><li>item 1<li>item <i>2</i></ul>
    <div><p>Inner &lt;tag&gt;</div><table><tr><td>a<td>b</tr></table></article>
    <section id="comments"><div class="comment"><p>{LONG}</p></div></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Head é!\n\nOne two three\n\nShort.\n\nitem 1\n\nitem 2\n\nInner <tag>\n\na b"


def test_page_without_an_article_element():
    page = f"<body><div class='menu'>Menu words</div><div><a href=x>Link</a> <a href=y>Other link</a></div><div id=content><h2>Title</h2><p>{LONG}</p><p>x</p><p>{LONG}</p></div><div class=footer>{LONG}</div>"
    assert main_text(page) == f"Title\n\n{LONG}\n\nx\n\n{LONG}"
    assert main_text(f"<div class='site-header'>{LONG}</div><div class='post'><div class='post-body'><p>{LONG}</p></div></div><ol class='commentThread commentlist'><li>{LONG}</li></ol>") == LONG
    assert main_text("just text") == "just text"
    assert main_text("<p>a<p>b") == "a\n\nb"


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<script>x") == ""
    assert main_text("<article><p>a <b>b</article><footer>f</footer>") == "a b"
    assert main_text("<article><p>1 < 2 & 3 > 2</p>") == "1 < 2 & 3 > 2"
    assert main_text("<article><div class='ad'>x</div>tail</article>") == "tail"
    assert len(main_text("<article>" + "<p>word</p>" * 5000)) == 5000 * 6 - 2


CASES = [
    # Names that only hold a word of a role are no role.
    ("<article><p>A.</p><p class='share-price'>Up 3</p><div class='related-work'><p>Prior.</p></div><h2 id='notice-of-results'>Results</h2><p>End.</p></article>", ["A.", "Up 3", "Prior.", "Results", "End."]),
    ("<article><header><h1>T</h1><p>Lead.</p><span>by x</span></header><p>b</p></article>", ["T", "Lead.", "b"]),
    # Quotes only count where a value begins.
    ('<p class=a">Hello</p><p class="b">World</p>', ["Hello", "World"]),
    ("<p title=it's>One's</p><p>two</p>", ["One's", "two"]),
    # Wrappers that are named after what they also hold.
    (f"<div class='content-with-sidebar'><main class='no-sidebar'><p>{LONG}</p></main><div class=sidebar><p>{LONG}</p></div></div>", [LONG]),
    ("<article class='post comments-open'><p>x</p></article>", ["x"]),
    ("<div id='page' class='header-fixed'><article><p>x</p></article></div>", ["x"]),
    (f"<form id=all><div class=menu>a b</div><div id=content><p>{LONG}</p></div></form>", [LONG]),
    (f"<form><nav>n</nav><article><p>{LONG}</p></article></form>", [LONG]),
    # The lengths decide between what is marked and what is not, and between several marked parts.
    (f"<article class=card><p>Teaser one</p></article><article class=card><p>Teaser two</p></article><div id=content><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>", ["T", LONG, LONG]),
    (f"<section class=related><article>{LONG}</article></section><article><p>{LONG}{LONG}</p></article>", [LONG + LONG]),
    (f"<article><p>{LONG * 3}</p></article><article><p>short one</p></article>", [LONG * 3]),
    # Between surge and dive lines of links stay, and an inner advert costs nothing after it.
    (f"<div id=c><p>{LONG}</p><p><a href=x>Only a link</a></p><p>{LONG}</p><aside>{LONG}</aside><p>Short end.</p></div><div>tiny</div>", [LONG, "Only a link", LONG, "Short end."]),
    (f"<section id=comments><p>{LONG}</p></section>", []),
    ("<p>AT&<b>amp;</b> &amp;lt; a</p>", ["AT&amp; &lt; a"]),
    ("<!-->x<p>y", ["x", "y"]),
    ("<head><title>t<p>u</title><p>v", ["v"]),
    ("İ<script>zz</script>ok", ["İok"]),
]


@pytest.mark.parametrize("page, want", CASES)
def test_hard_pages(page, want):
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x", "<div>" * 100_000 + "x", "<nav>" * 100_000, '<p a="x>' * 50_000, '<p class=a">t' * 30_000, "<ul><li>x" * 30_000, "<p x='" + "<b " * 50_000, "<p " + " " * 300_000, "<" * 200_000, "<script>" * 50_000])
def test_time_is_linear(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", 1), (1, "u", "<p>é</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract(pages).collect()) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert html_extract(pages.filter("false")).count() == 0


def test_sample_pages_keep_their_paragraphs(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</h1>", body)]
        got = main_text(r.html)
        # Inline tags may stand inside words: compare without white space.
        assert re.sub(r"\s", "", got) == re.sub(r"\s", "", "".join(want))
        assert got.count("\n\n") == len([w for w in want if w]) - 1
