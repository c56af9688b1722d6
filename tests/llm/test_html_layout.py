"""HTML: time in proportion to length, the cascade, spanning cells, and every visible word of the pages."""

import html.parser
import re
import time

import pyarrow.parquet as pq
import pytest

from tensorfold.llm import html_text


@pytest.mark.parametrize(
    "piece, tail",
    [
        ("<a ", ""),
        ("<a x='", ""),
        ('<a x="', ""),
        ("<a '", ""),
        ("<a \"'", ">"),
        ("<a = \"", ">"),
        ("<div>", ""),
        ("<p>", ""),
        ("<b>", ""),
        ("</b>", ""),
        ("<b></i>", ""),
        ("<div><p>", ""),
        ("<!--", ""),
        ("<!-- x --!", ""),
        ("<!", ""),
        ("</", ""),
        ("<", ""),
        ("<td>", ""),
        ("<table><td>", ""),
        ("<ul><li>", ""),
        ("<script>", ""),
        ("<title></x", ""),
        ("<a =" + " " * 50, ""),
        ("&amp", ""),
        ("<style>a{", ""),
        ("<style>@media print{", ""),
        ("<a                    '>", ""),
    ],
)
def test_linear_time(piece, tail):
    took = []
    for size in (50_000, 400_000):
        page = piece * (size // len(piece)) + tail
        start = time.process_time()
        html_text.render(page)
        took.append(time.process_time() - start)
    # 8 times the length: well under the 64 times of quadratic work.
    assert took[1] < 24 * took[0] + 0.3 and took[1] < 4


def style(sheet, body="<p class=a id=i>x</p>y"):
    return html_text.render(f"<style>{sheet}</style>{body}")


@pytest.mark.parametrize(
    "sheet, seen",
    [
        (".a{display:none}", False),
        ("@media print{.a{display:none}}", True),
        ("@media screen{.a{display:none}}", False),
        ("@media screen and (max-width:9px){.a{display:none}}", True),
        ("@media print{.b{color:red} .a{display:none}} #i{color:red}", True),
        ("@media print{@media screen{.a{display:none}}}", True),
        ("@media all, print{.a{display:none}}", False),
        ("@layer x{.a{display:none}}", False),
        ("@import 'x'; .a{display:none}", False),
        ("@font-face{src:x} .a{display:none}", False),
        (".a{display:none} .a{display:block}", True),
        ("p{display:block} .a{display:none} p{display:block}", False),
        (".a{display:none} #i{display:block}", True),
        ("#i{display:block} .a{display:none}", True),
        (".a{display:none !important} #i{display:block}", False),
        ("p.a{display:none}", False),
        ("div.a{display:none}", True),
        ("p.a.b{display:none}", True),
        ("*{visibility:hidden} p{visibility:visible}", True),
        (".b, .a {visibility:hidden}", False),
        ("/* .a{display:none} */", True),
        (".a{display:none} /* unclosed", False),
        (".x .a{display:none}", True),
        (".a{display:none", False),
    ],
)
def test_cascade(sheet, seen):
    assert ("x" in style(sheet).split()) == seen


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>.a{display:none}</style><p class=a style='display:block'>x", "x"),
        ("<style>.a{display:none!important}</style><p class=a style='display:block'>x", ""),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"),
        ("<style>p{display:block}</style><p hidden>x", "x"),
        ("<p hidden>x", ""),
        ("<style media=print>p{display:none}</style><p>x", "x"),
        ("<style media='screen'>p{display:none}</style><p>x", ""),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=2>long<td>c<tr><td>d<td>f</table>", "a  long  c\nd        f"),
        ("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c</table>", "a   b\n    c"),
        ("a <a title='x > y'>b</a> <i class=\"p>q\">c</i> <a b'c>d", "a b c d"),
        ("x <!--> y <!-- z --!> w", "x y w"),
        ("<title>a</b></title>x<textarea> q</textarea>", "x q"),
        ("<script>'</scriptx>'</SCRIPT >y", "y"),
        ("1 < 2 <3 <a", "1 < 2 <3 <a"),
    ],
)
def test_rendering(page, text):
    assert html_text.render(page) == text


class Plain(html.parser.HTMLParser):
    """The words that aren't in what is never shown, by the standard library's own parser."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "title", "noscript", "head"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "title", "noscript", "head") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_every_visible_word_of_the_pages(tiny):
    """Pages without anything that hides: the same words in the same order as the standard library's parser sees."""
    compared = 0
    for page in pq.read_table(f"{tiny}/pages.parquet")["html"].to_pylist():
        if not page or re.search(r"(?i)hidden|display|<details|<dialog|<input|<ol|<select|<svg|<object|<canvas|<iframe|<video|<audio", page):
            continue
        plain = Plain()
        plain.feed(page)
        plain.close()
        # Without the markers of list items.
        got = "".join(re.sub(r"(?m)^ *- ", "", html_text.render(page)).split())
        want = "".join(plain.words).replace("\xa0", "")
        if "<table" in page.lower():
            got, want = sorted(got), sorted(want)
        assert got == want
        compared += 1
    assert compared >= 20


def test_pages_without_rows_and_repeated(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None), (2, "")], "page_id bigint, html string").withColumnRenamed("html", "html")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(pages.limit(0)).count() == 0
