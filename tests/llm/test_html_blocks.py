import html
import re

import pytest

from recordloom.llm import html_blocks


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.train(spark)


def test_tree_fits_its_table(tree):
    rows = html_blocks.labelled_rows()
    assert sum(html_blocks.is_content(tree, r[:-1]) == (r[-1] == 1) for r in rows) >= 0.97 * len(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="ad-free"><header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work well for you.</div>
<article><header><h1>A &lt;b&gt; heading</h1></header><p>First <b>bo</b>ld&nbsp;word &amp more.<br>Line two.
<p>x<p class="ad">Buy now and get one free today.</p><!-- a > b --><p>A < B and 3 > 2, <a href="a>b">linked</a>.</p>
<aside>Side note with some words in it.</aside><form><label>Your mail</label></form></article>
<section class="comments"><h3>Comments</h3><article class="comment"><p>I liked this text a lot, thank you.</p></article></section>
<div id="sidebar"><p>Popular this week and other things to read.</p></div>
<footer>&copy; Somebody 2020, all rights reserved.</footer></body></html>"""


def test_one_page(tree):
    text, n, kept = html_blocks.main_text(PAGE, tree)
    assert text == "A <b> heading First bold word & more. Line two. x A < B and 3 > 2, linked."
    assert n > kept > 0


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- x", "<script>a", "&", "</p></div>", "<div>" * 5000 + "x"])
def test_malformed(tree, page):
    html_blocks.main_text(page, tree)


def test_page_with_a_named_part(tree):
    page = ("<body><div id=top><a href=/>Site</a></div><div class='page-content'><h1>Heading</h1><p>Short.</p>"
            "<div class='share-buttons'>Share this</div><p hidden>Not shown here at all.</p><p>x</p></div>"
            "<div class=related-posts><a href=/1>Other text</a></div><ol id='comments'><li>Nice one, thanks a lot</ol></body>")
    assert html_blocks.main_text(page, tree)[0] == "Heading Short. x"


@pytest.mark.parametrize("start, end", [
    ("<div class='content-sidebar-wrap'><main><article>", "</article></main></div>"),
    ("<div class='content-sidebar-wrap'><article>", "</article></div>"),
    ("<article class='post category-social tag-banner'>", "</article>"),
    ("<form id=form1><div id=header-wrap><main>", "</main></div></form>"),
    ("<section class='has-sidebar'><article class='type-notice'>", "</article></section>")])
def test_wrappers_do_not_empty_a_page(tree, start, end):
    page = (f"<body><nav><a href=/>Home</a></nav>{start}<h1>Heading</h1><p>Some words here.</p>"
            f"<p>With <math><mi>x</mi></math> in it.</p><div class='share'>Share</div>{end}"
            "<div class=sidebar><p>Other things to read now.</p></div><div class=related><article><p>A teaser text.</p></article></div>"
            "<section id=comments><article><p>I liked this a lot.</p></article></section></body>")
    assert html_blocks.main_text(page, tree)[0] == "Heading Some words here. With x in it."


def test_words_and_neighbours_decide_without_markup(tree):
    used = {html_blocks.FEATURES[node[0]] for node in tree.values() if node[2] >= 0}
    assert {"links"} < used and used & {"words", "words_before", "words_after"} >= {"words_before", "words_after"}
    page = ("<body><p>Town paper</p><p>Monday</p><p>Sports and more</p><p>A heading</p>" + "<p>" + "words that follow it " * 10
            + "</p><p>Short.</p><p>" + "and more of the same " * 8 + "</p><p>Imprint</p><p>All rights</p></body>")
    text, _, _ = html_blocks.main_text(page, tree)
    assert text.startswith("A heading words that") and "Short. and more" in text and "All rights" not in text
    assert "Town" not in text and "Monday" not in text


def test_page_without_article(tree):
    page = ("<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div id=content><h1>Some heading here</h1>"
            + "<p>" + "many words follow here " * 12 + "</p><p>" + "and still more of them " * 9
            + "</p></div><div class=footer>Imprint and contact</div>")
    text, _, _ = html_blocks.main_text(page, tree)
    assert text.startswith("Some heading here many words") and text.endswith("of them")


def test_given_pages_hold_their_article(spark, tree):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_blocks.extract(pages, tree=tree).select("page_id", "html", "text", "n_chars").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def test_nulls_empty_and_clashing_names(spark, tree):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "<article><p>Hi</p></article>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_blocks.extract(pages, tree=tree).collect())
    assert got == [(0, "Hi", 2), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert html_blocks.extract(pages.where("false"), tree=tree).count() == 0


def test_every_block_of_an_article_stays(tree):
    for words in (1, 2, 5, 9, 40, 700):
        for links in (0.0, 0.1, 0.5, 1.0):
            for before in (0, 1, 30, 900):
                for after in (0, 1, 30, 900):
                    for near in (0.0, 0.4, 1.0):
                        x = (words, links, before, near, after, near, 1.0, 0.0, 1.0)
                        assert html_blocks.is_content(tree, x)
                        assert not html_blocks.is_content(tree, x[:7] + (1.0, 1.0))
