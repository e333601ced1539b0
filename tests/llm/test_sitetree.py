import html

import pytest
from llm_data import SMALL

from moneytrail.llm import sitetree

SCHEMA = "page_id bigint, url string, html string, host string, text string, blocks int, low string"


def texts(spark, *pages, **options):
    rows = [(i, p[0], p[1], "h", "t", 1, "l") for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def one(page):
    return "\n".join(b[2] for b in sitetree.blocks_of(page) if b[1])


@pytest.mark.parametrize("inner, want", [
    ("<h1>T &amp; t</h1><p>a <b>b</b>\n c<br>d</p>", "T & t\na b c d"),
    ("<p>one<p>two<ul><li>x<li>y</ul>tail", "one\ntwo\nx\ny\ntail"),
    ("<p>a<script>var t='</p><p>no';</script>b<style>p{}</style></p><!-- <p>no</p> -->", "ab"),
    ("<p title='a>b'>ok</p><p>5 < 6 &lt;b&gt; &#8364;&nbsp;&euro;</p>", "ok\n5 < 6 <b> € €"),
    ("<nav>n</nav><aside>s</aside><form><input>f</form><footer>f</footer><div class='cookie-notice'>c</div><p>x</p>", "x"),
    ("<p>x</p><section id='comments'><article class='comment'><p>c</p></article></section><div class='ad'>a</div>", "x"),
    ("<header><h1>Title</h1></header><p>x</p><div class='share-buttons'>s</div><div hidden>h</div>", "Title\nx"),
    ("<table><tr><td>a<td>b<tr><td>c</table><pre>p\n q</pre><blockquote><p>q</blockquote>", "a\nb\nc\np q\nq"),
    ("<div class='read-along adventure'>kept</div><p class=shared-memory>kept too</p>", "kept\nkept too"),
])
def test_articles(inner, want):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><a href='/'>m</a></nav><header>top</header><article>{inner}</article><footer>f</footer></body></html>"
    assert one(page) == want


@pytest.mark.parametrize("page", ["", "<", "<p", "<a href='", "<!--", "</p></p>", "<article>", "text only", "<article><p>a<b><i></article>z", "<script>", "&#xfffffff; &bad;", "<p>" * 3000])
def test_broken_markup_does_not_fail(page):
    sitetree.blocks_of(page)


def test_given_pages(spark):
    """All text between the tags of the article, which the given pages mark."""
    import re
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in sitetree.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_entropy_tells_template_from_content(spark):
    def page(i):
        return (f"https://site.example/{i}", f"<body><div class=box1>Welcome to our site</div><div class=teaser>{'Hot news' if i % 2 else 'Old news'}</div>"
                f"<div class=text><p>Story {i} is about thing {i * i}.</p><p>Always the same last line</p></div></body>")

    got = texts(spark, *[page(i) for i in range(40)], *[page(1)] * 3, ("https://other.example/", page(1)[1]))
    assert all(got[i] == f"Story {i} is about thing {i * i}." for i in range(40))
    assert got[43].startswith("Welcome to our site\n")  # one page tells nothing about its site


def test_copies_of_a_page_are_one_page(spark):
    copies = [("https://site.example/a", "<body><div><p>The same story</p></div></body>")] * 30
    assert set(texts(spark, *copies).values()) == {"The same story"}


def test_menus_by_links(spark):
    page = ("http://x.example/", "<body><div class=top><a href=1>one</a> <a href=2>two</a></div><div>text with a <a href=3>link</a> in it</div></body>")
    assert texts(spark, page)[0] == "text with a link in it"


def test_odd_rows(spark):
    got = texts(spark, (None, None), ("", ""), ("http://[bad", "<article>x</article>"), (None, "plain"), ("u", "<nav>only menu</nav>"))
    assert got == {0: "", 1: "", 2: "x", 3: "plain", 4: ""}
    assert sitetree.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_template_within_articles_goes(spark):
    def page(i):
        return (f"https://site.example/{i}", f"<body><article><p>Read our app in the store</p><p>Story {i} tells of thing {i * i}.</p><p>Written for the weekly</p></article></body>")

    got = texts(spark, *[page(i) for i in range(20)], ("https://other.example/", page(3)[1]))
    assert all(got[i] == f"Story {i} tells of thing {i * i}." for i in range(20))
    assert got[20] == "Read our app in the store\nStory 3 tells of thing 9.\nWritten for the weekly"


def test_a_rare_paragraph_among_recurring_ones_stays(spark):
    same = "".join(f"<p>Always {w}</p>" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))
    got = texts(spark, *[("https://site.example/", f"<article>{same}<p>Only on page {i}</p></article>") for i in range(12)])
    assert all(got[i] == f"Only on page {i}" for i in range(12))


def test_a_story_outside_the_articles_stays(spark):
    def page(i):
        return (f"https://site.example/{i}", f"<body><div class=top>Welcome to the weekly</div><div id=content><p>Story {i} tells of thing {i * i}.</p></div>"
                f"<article><p>Teaser {i} of another story</p></article></body>")

    got = texts(spark, *[page(i) for i in range(20)], ("https://other.example/", page(3)[1]))
    assert all(got[i] == f"Story {i} tells of thing {i * i}.\nTeaser {i} of another story" for i in range(20))
    assert got[20] == "Welcome to the weekly\nStory 3 tells of thing 9.\nTeaser 3 of another story"


def test_blocks_of_links_are_judged_by_their_recurrence(spark):
    def page(i):
        return (f"https://site.example/{i}", f"<body><ul class=top><li><a href=/>home</a><li><a href=/a>all</a></ul><div><p>Story {i}.</p><p><a href=x>Linked sentence {i}</a></p></div></body>")

    got = texts(spark, *[page(i) for i in range(20)])
    assert all(got[i] == f"Story {i}.\nLinked sentence {i}" for i in range(20))
    assert texts(spark, ("u", "<article><p>Text</p><p><a href=x>All linked</a></p></article>"))[0] == "Text\nAll linked"


@pytest.mark.parametrize("page, want", [
    ('<div class="content no-sidebar"><article><p>kept</p></article></div><div class="sidebar">gone</div>', "kept"),
    ('<div id="page" class="has-menu with_footer"><p>kept</p></div><div class="menu">gone</div>', "kept"),
    ('<body class="is-nav hide-cookie"><main><p>kept</p><div class="not-related ad">gone</div></main></body>', "kept"),
])
def test_names_of_layouts_cut_nothing(spark, page, want):
    assert texts(spark, ("https://x.example/", page))[0] == want


def test_repeated_rows_and_long_pages(spark):
    """Repeated rows are rows of their own; a page of any length is read whole, at a cost in proportion."""
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(60_000)) + "</article>"
    got = sitetree.extract(spark.createDataFrame([(i, "u", p, "h", "t", 1, "l") for i, p in ((1, long), (2, "<p>same</p>"), (2, "<p>same</p>"))], SCHEMA)).collect()
    assert [r.text.count("\n") for r in got if r.page_id == 1] == [59_999] and [r.text for r in got if r.page_id == 2] == ["same"] * 2
    assert sitetree.extract(spark.createDataFrame([], SCHEMA)).columns == ["page_id", "url", "text", "n_chars"]
