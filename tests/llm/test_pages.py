import os
import random
import time

import pytest

from fleetlens.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy &amp; buy</div><!-- <p>no</p> -->
<article><h1>Head</h1><p><b>First &lt;line&gt;
 goes   on<br>here<p>Two</p><aside>aside</aside><form><input>Name</form><div class="newsletter-signup">Sign</div><p>&copy; &eacute;</p>
<section class="comments"><article class="comment"><p>Nice!</p></article></section></article><aside>Side</aside><footer>Foot</footer></body>"""


def test_article(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, "v", None, 9), (3, None, "", 9), (1, "u", PAGE, 9)], "page_id long, url string, html string, n_chars int")
    got = htmltext.extract(pages).collect()
    text = "Head\n\nFirst <line> goes on here\n\nTwo\n\n© é"
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "u", text, len(text)), (2, "v", "", 0), (3, None, "", 0), (1, "u", text, len(text))], key=str
    )
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_surge_and_dive_without_article():
    body = "".join(f"<p>{'words of the story ' * 6}{i}</p>" for i in range(5))
    page = f"<div class='menu'>Home</div><p>{'<a href=x>link link</a> ' * 15}</p>{body}<p>Short.</p><div id=comments><p>{'reply ' * 50}</p></div>"
    got = htmltext.blocks(page)
    assert len(got) == 6 and got[-1] == "Short." and got[0].startswith("words of")


def test_without_surge_all_lines_of_the_largest_window():
    assert htmltext.main_text("plain text") == "plain text"
    assert htmltext.main_text("<nav>menu</nav>") == ""


def test_broken_markup_ends():
    for page in ("<article><p>a<div class='ad>b", "<p a='" * 2000, "<" * 5000, "<!-- never", "<script>x", "<article><p>" + "long " * 200000):
        htmltext.main_text(page)
    assert htmltext.main_text("<article><p>" + "long " * 200000).count("long") == 200000


LONG = "<p>" + "a long paragraph of the story " * 9 + "</p>"
NAV = "<nav><a href=x>menu</a></nav>"


@pytest.mark.parametrize("page, first, last, n", [
    ("<p>Short one.</p>" + NAV * 4 + LONG + "<aside>x</aside>" * 3 + "<p>Last bit.</p>", "Short one.", "Last bit.", 3),
    ("Hi." + "<div class=ad>buy</div>" * 3 + "Bye.", "Hi.", "Bye.", 2),
    ("<p>Title</p><p>By me</p><p>Today</p>" + LONG + "<p>End</p>", "Title", "End", 5),
    ("<p>" + "<a href=y>Home</a> " * 9 + "</p>" + LONG + "<p><a href=x>" + "one long link " * 9 + "</a></p>", "a long", "one long", 2),
    ("<div id='search-for-meaning' class='alert-ness'><p>One</p>" + LONG + "</div><p class='market-share'>Two</p>", "One", "Two", 3),
    ("<article><div id='search'><p>Only</p></div><p class=ad>This</p></article>", "Only", "This", 2),
    ("<article><p>Only</p><div class='share-buttons'>Share</div><p class='site-search box'>x</p></article>", "Only", "Only", 1),
    ("<div><nav>menu<p>more menu</div>" + LONG, "a long", "a long", 1),
    (LONG + "<div class=sidebar>side<p>more of it", "a long", "a long", 1),
    ("<p>if a<b then c</p><p>x < y</p>", "if a<b then c", "x < y", 2),
    ("<p title='a > b'>One</p><p title=\"it's\">Two</p>", "One", "Two", 2),
])
def test_blocks_kept_and_left_out(page, first, last, n):
    got = htmltext.blocks(page)
    assert len(got) == n and got[0].startswith(first) and got[-1].startswith(last)


@pytest.mark.parametrize("part", ["<div ", '<p a="', "<p x='\"", "<", "<script ", "<nav>x", '<a "<a"', "<div>", "<!--", "<article><div class=ad>", "</", "&", "<a href=x>"])
def test_a_megabyte_of_broken_markup_takes_little_time(part):
    started = time.process_time()
    htmltext.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - started < 10


def test_random_pages_against_their_making():
    """Pages made of known blocks: all paragraphs stand near a long one, so all of them are main text."""
    r = random.Random(6)
    away = ["<nav><ul><li><a href=x>m</a></ul></nav>", "<div class='ad'>buy</div>", "<aside><p>s</p></aside>", "<script>x<p>y</script>", "<!-- <p>no -->", "<form>f<input></form>", "<section id=comments><p>c</p></section>", "<footer>f</footer>", "<div class='cookie-notice'>ok</div>"]
    for _ in range(300):
        want, page = [], []
        article = r.random() < 0.5
        for _ in range(r.choice([1, 3, 9])):
            page += r.choices(away, k=r.choice([0, 1, 4]))
            text = " ".join(r.choice(["word", "a", "é", "R&amp;D", "x<b>y</b>"]) for _ in range(r.choice([1, 3, 60])))
            page.append(r.choice(["<p>{}</p>", "<h2>{}</h2>", "<div class='text-body'>{}</div>", "<p>{}"]).format(text))
            want.append(text.replace("&amp;", "&").replace("<b>", "").replace("</b>", ""))
        body = "<p>" + "long " * 30 + "</p>"
        page.append(body)
        want.append(" ".join(["long"] * 30))
        inner = "".join(page)
        page = f"<header><p>Site</p></header>{NAV}" + (f"<article>{inner}</article><p>outside</p>" if article else inner)
        assert htmltext.blocks(page) == want


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 9, "t", "r")], "page_id long, url string, html string, n_chars int, text string, rows string")
    assert [tuple(r) for r in htmltext.extract(pages).collect()] == [(1, "u", "x", 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables not there")
def test_given_pages(spark):
    """Every line of the article, by a plain cut of its markup."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
