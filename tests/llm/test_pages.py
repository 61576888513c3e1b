"""op3 against plain parsing of the generated pages, and on hosts whose votes and templates decide."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from loomline.llm import html_extract
from loomline.llm.html_extract import Page, extract

SF = "/root/testdata/sf0.001"
LONG = "A sentence of the article that is long enough to matter here. " * 6


def plain(page):
    """The generated pages hold one article of headings and paragraphs; inline tags vanish, br is white space."""
    article = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article|ul|li|div)>", article.group(1)) if article else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_every_generated_page(spark):
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.op3_query(spark, SF).collect()}
    assert got == {r["page_id"]: (r["url"], plain(r["html"]), len(plain(r["html"]))) for r in rows}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<p alt="x>two</p>', "two"),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
        (f'<body><p>one</p><svg><path d="1"><p>{LONG}</p></body>', f"one\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><div class="side-effects"><p>effects</p></div><p class="form-of-life">life</p></article>', f"{LONG.strip()}\neffects\nlife"),
        (f'<article><p>{LONG}</p><div class="ad-box">buy</div><div id="siteFooter">foot</div></article>', LONG.strip()),
        ("<div>" * 45 + f"<section><p>{LONG}</p></section><section><ul><li><a href=x>other block</a></li></ul></section>", LONG.strip()),
        ("a < b &amp; c <3 <!-- no --><![CDATA[no]]>d", "a < b & c <3 d"),
        ("<p>kept <title>unclosed<p>also", "kept unclosed\nalso"),
        ("<p title=it's>one</p><p data-class='ad'>two</p>", "one\ntwo"),
        ("<script>if (a < b) '</p>'</script ><p>x</p><style>p{}", "x"),
        ("", ""),
        (None, ""),
    ],
)
def test_odd_markup(page, expected):
    assert extract(page, []) == expected


def test_scanning_is_linear():
    for piece in ('<a "', '<a ="', "<div>", "<title>", "<a ='x>", "<svg><p>x", "<p><b>", "<div>x"):
        began = time.perf_counter()
        page = Page(piece * 20_000)
        page.boxes(page.best())
        assert time.perf_counter() - began < 10, piece


def page(article, more="", before=""):
    return f"<html><body>{before}<div class='post'><p>{article}</p></div>{more}</body></html>"


def extracted(spark, pages):
    rows = [(i, url, text, "x") for i, (url, text) in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, winners string")).collect()}


def test_the_host_s_vote_overrules_a_page_s_own_best(spark):
    """Reader talk under an unmarked name outweighs a short article; the other pages of the host know better."""
    talk = "".join(f"<div class='t{i}x'><a href='/u'>name of a reader</a> and more</div>" for i in range(3))
    usual = [("https://a.example/1", page(LONG + str(i), talk)) for i in range(6)]
    outweighed = ("https://a.example/9", page(LONG + "short", f"<div class='talk'><p>{LONG * 2}</p><a href='/u'>{'reader ' * 400}</a></div>"))
    alone = ("https://b.example/9", outweighed[1])
    got = extracted(spark, [*usual, outweighed, alone])
    assert got[6] == LONG + "short"
    assert got[7] != got[6]


def test_two_layouts_on_a_host_keep_their_articles(spark):
    teaser = "<div class='post'><p>A teaser at the other path, long enough to be taken for text.</p></div>"
    first = [("https://a.example/1", page(LONG + str(i))) for i in range(6)]
    second = [("https://a.example/2", f"<html><body><div class='story'><p>{LONG}{i}</p></div><ul><li><a href='/'>{'more ' * 20}</a></li></ul>{teaser}</body></html>") for i in range(3)]
    got = extracted(spark, [*first, *second])
    assert all(LONG.strip() in text for text in got.values())


def test_boxes_of_the_template_go_and_single_ones_stay(spark):
    box = "<div class='hint'><p>Read this on every page of the site.</p></div>"
    pages = [("https://a.example/1", f"<html><body><div class='post'><p>{LONG}{i}</p>{box}<div class='hint'><p>Only on page {i}.</p></div></div></body></html>") for i in range(4)]
    got = extracted(spark, [*pages, ("https://b.example/1", pages[0][1]), (None, None)])
    assert all("every page" not in got[i] and f"Only on page {i}." in got[i] for i in range(4))
    assert "every page" in got[4] and got[5] == ""


def test_copies_of_one_page_are_no_template(spark):
    text = f"<html><body><div class='all'><div class='post'><p>{LONG}</p></div></div></body></html>"
    assert set(extracted(spark, [("https://a.example/1", text)] * 4).values()) == {LONG.strip()}


def test_parts_of_an_article_stay_in_its_copies(spark):
    """Three copies, one of them nearly so, beside another page: nothing that only copies share is a template."""
    def two_parts(end):
        return f"<html><body><div class='post'><p>{LONG}</p><div class='part'><p>{'The second part of it. ' * 10}</p></div><p>{end}</p></div></body></html>"

    got = extracted(spark, [("https://a.example/1", two_parts("end")), ("https://a.example/2", two_parts("end")), ("https://a.example/3", two_parts("END")), ("https://a.example/4", page(LONG + "other"))])
    assert all("The second part of it." in got[i] for i in range(3))


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<body><article><p>Short news.</p></article><div class='comments'>" + "<p>A reader says something.</p>" * 40 + "</div></body>", "Short news."),
        ("<body><div><p>Short news.</p></div><div id='sidebar'>" + "<p>Other things.</p>" * 40 + "</div></body>", "Short news."),
        ("<body><article><p>Short news.</p></article><div class='comments'>" + "<article class='comment-body'><p>A reader.</p></article>" * 40 + "</div></body>", "Short news."),
        (f"<body><div class='content-sidebar-wrap'><main><p>{LONG}</p></main><div class='sidebar'><p>Side.</p></div></div><p>Legal.</p></body>", LONG.strip()),
        ("<body><form id='aspnetForm'><p>News.</p><div class='comments'><p>A reader.</p></div></form></body>", "News."),
        ("<body><div class='header'><p>Site</p></div><div class='post-comments'><p>All the text of the page.</p><div class='ad'>buy</div></div></body>", "All the text of the page."),
        ("<body><div class='comments'><a href='/x'>only a link</a></div></body>", ""),
    ],
)
def test_marks_give_way_only_around_the_article(html, expected):
    assert extract(html, []) == expected


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(empty).collect() == []
