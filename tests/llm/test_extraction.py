import html
import re

import pytest

from caseflow.llm import extraction
from caseflow.llm.common import table
from caseflow.llm.labelled_pages import PAGES

TEXT = "Alpha beta gamma. Delta epsilon zeta eta theta iota."


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_articles_of_the_table(spark, sf_dir):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for page in pages.collect():
        assert found[page.page_id] == article(page.html)


def test_labelled_pages_are_learned():
    right = 0
    for page in PAGES:
        blocks, _ = extraction.blocks(page)
        right += extraction.main_text(page) == " ".join(b.text for b in blocks if b.main and b.text)
    assert right >= 0.9 * len(PAGES)


def test_what_is_not_the_article_goes():
    page = f"""<html><head><title>T</title><script>var a="</p><p>no</p>";</script><style>p {{}}</style></head><body><header><p>Site {TEXT}</p>
    </header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="notice">Cookies {TEXT}</div><article><h1>Head &amp; line</h1><p>One
    <b>bold</b>ly&nbsp;two<br>three</p><div class="advert"><p>Buy {TEXT}</p></div><!-- <p>no</p> --><p>&eacute; {TEXT}</p><form><p>Name {TEXT}</p></form>
    <p>End.</p></article><section class="comments"><p>I {TEXT} {TEXT}</p></section><aside>Side {TEXT}</aside><footer><p>Foot {TEXT}</p></footer>"""
    assert extraction.main_text(page) == f"Head & line One boldly two three é {TEXT} End."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<script>x", ""), ("plain text &amp; more", "plain text & more"), ("< 3 <p>ok", "< 3 ok"),
    (f"<body><div>{TEXT}</div>", TEXT), ("<p>a &lt;b&gt;<p>c<b>d</b>e", "a <b> cde"), ("<p title='>'>q", "q"), ('<p title=">q', "q")])
def test_odd_pages(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("head", [
    "<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=x><template><p>no</p></template><style>p {}</style>\n<body>",
    "<HEAD><link rel=x><noscript><p>no</p></noscript><!-- no --><body></head>", "<head>", "<head><title>T</title></head><body>"])
def test_the_end_of_a_head_can_be_left_out(head):
    assert extraction.main_text(f"<!DOCTYPE html><html>{head}<p>{TEXT}</p><p>{TEXT}</p></html>") == f"{TEXT} {TEXT}"
    assert extraction.main_text(f"<html>{head}{TEXT}") == TEXT


@pytest.mark.parametrize("names", ["nav-fixed comments-open", "search-enabled has-sidebar", "ad menu footer cookie-banner"])
def test_classes_of_the_whole_page_say_nothing(names):
    page = f"<nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>{TEXT}</p></article><footer>Ours.</footer>"
    assert extraction.main_text(f'<html class="{names}"><body class="{names}" id="page">{page}') == f"Head {TEXT}"


def test_the_region_has_the_largest_sum():
    page = "<div class=ad><p>x y</p></div><article><p>a b c</p></article><div class=ad><p>many bad words stand here between</p></div><article><p>d</p></article>"
    assert extraction.main_text(page) in ("a b c", "a b c d")


def test_awkward_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    long = "<article>" + "<p>word word</p>" * 50_000
    rows = [(1, None, None, "a", "b"), (None, "u", "<p>one two</p>", "a", "b"), (2, "u", "", "a", "b"), (3, "u", long, "a", "b"), (3, "u", long, "a", "b")]
    found = extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), len(r.text)) for r in found) == sorted([("1", 0), ("None", 7), ("2", 0), ("3", 499_999), ("3", 499_999)])
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0
