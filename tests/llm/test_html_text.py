import random
import re
import time
from html.parser import HTMLParser

import pytest

from trackscan.llm import html_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a <b>b</b>c\n  d<br>e<br><br>f", "a bc d\ne\n\nf"),
    ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "- x\n- y\n  3. q\n  4. r\n\nz"),
    ("<ul><li>a<p>b</ul>", "- a\n\n  b"),
    (
        "<table><caption>C</caption><tr><th>Name<th>N<tr><td>long cell<td>1<tr><td>é<td>22</table>",
        "C\nName       N\nlong cell  1\né          22",
    ),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td>1<td><table><tr><td>in<td>ner</table><td>3</table>", "1  in  ner  3"),
    ("<table><tbody><tr><td></td></tr></table>x", "x"),
    ("x<div hidden>no</div><span style='color:red; DISPLAY : none'>no</span>y", "xy"),
    ("<div style=visibility:hidden>no</div><p aria-hidden=true>shown</p>yes", "shown\n\nyes"),
    ("<script>if (a<b) '</p>'</script>t<style>p{}</style><noscript>n</noscript>", "t"),
    ("<pre>a  b\n   c\n\nd</pre>", "a  b\n   c\n\nd"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"),
    ("<a title=it's href=x>q</a><img src='x'> don't <b>z</b>", "q don't z"),
    ('<a href="x>q</a> y', ""),
    ("a<!-- x --!>b<!-->c<!---->d<!-- e", "abcd"),
    ("1 < 2 &amp; 3 &gt; 2 &copy; &#233;", "1 < 2 & 3 > 2 © é"),
    ("<head><title>T</title></head><body>b", "b"),
    ("</p></div></x>a</b>", "a"),
    ("<select><option>no</select><textarea>a < b</textarea>", "a < b"),
    ("<body hidden>no", ""),
    ("<div>" * 3000 + "deep", "deep"),
    ("<table><tr><td>" * 300 + "deep", "deep"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_text(page, text):
    assert html_text.text_of(page) == text


HEADS = [
    ("<html><head><title>T</title><h1>Hello</h1><p>text", "Hello\n\ntext"),
    ("<head><title>T</title>\n <meta charset=x><style>p{}</style>text<b>b", "textb"),
    ("<head><noscript>n</noscript><template><p>no</p></template><p>yes", "yes"),
    ("<head><head><link rel=x><script>s</script> \n<!-- c -->last", "last"),
    ("<head><title>T</title><body hidden><p>no", ""),
    ("<head><title>T</title> \n", ""),
]


@pytest.mark.parametrize("page, text", HEADS)
def test_a_head_without_its_end_tag(page, text):
    assert html_text.text_of(page) == text


FOREIGN = [
    ("a <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math> b", "a x+1 b"),
    ("<math><mtable><mtr><mtd>1<mtd></mtd></mtd></mtr><mtr><mtd>2</mtd></mtr></mtable></math>", "1\n2"),
    ("<p>a<svg>no<title>no</title><defs><text>no</text></defs><g><text>A<tspan>b</tspan></text></g></svg>c", "a Ab c"),
    ("<svg><defs/><path d=a/></path><text>one</text><text>two</text></svg>", "one two"),
    ("<svg><style>p{}</style><desc>no</desc><foreignObject><p>yes</p></foreignObject></svg>z", "yes\n\nz"),
    ("<svg><text>t</text><p>out<b>b</b>", "t\n\noutb"),
    ("<object><p>fallback</p></object>", "fallback"),
    ("<object data='x.pdf'><p>no</p></object>y", "y"),
    ("<select><option>no</select><div/>text", "text"),
]


@pytest.mark.parametrize("page, text", FOREIGN)
def test_math_svg_and_objects(page, text):
    assert html_text.text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<div>" * 256 + "<div hidden>x", ""),
    ("<div>" * 20_000 + "<div hidden>x</div>y", "y"),
    ("<i>" * 300 + "<div hidden><div>a</div>b</div>c", "c"),
    ("<b>" * 300 + "<ul><li>p<li>q</ul><table><tr><td>long<td>1<tr><td>s<td>2</table>", "- p\n- q\n\nlong  1\ns     2"),
])
def test_any_depth(page, text):
    assert html_text.text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<br></div>d", "b\nd"),
    ("<p style='display:none;display:block'>a<p style='display:block;DISPLAY:none'>b", "a"),
    ("<p style='display:none !important;display:block'>a<p style='display:block!important;display:none'>b", "b"),
    ("<p hidden style='display:block'>a<i style=visibility:collapse>b<u style=visibility:inherit>c", "a"),
    ("<body style=visibility:hidden>a<p style=visibility:visible>b", "b"),
    ("<ul style=visibility:hidden><li>a<li style=visibility:visible>b</ul>", "- b"),
    ("<table style=visibility:hidden><tr><td>a<tr style=visibility:visible><td>b</table>", "b"),
    ("<details>no<summary>s</summary>no<p>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<details>no</details>a<dialog>no</dialog><dialog open>b</dialog>", "a\nb"),
    ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
    ("<ol reversed><li>a<li>b</ol><ol reversed start=9><li>a<li>b</ol>", "2. a\n1. b\n\n9. a\n8. b"),
])
def test_what_is_visible(page, text):
    assert html_text.text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td colspan=2>wide heading<td>c<tr><td>a<td>b<td>c</table>", "wide heading  c\na  b          c"),
    ("<table><tr><td rowspan=2>x<td>1<td>2<tr><td>3<td>4<tr><td>y<td>5<td>6</table>", "x  1  2\n   3  4\ny  5  6"),
    ("<table><thead><tr><td rowspan=0>x<td>1<tr><td>2<tbody><tr><td>z<td>3</table>", "x  1\n   2\nz  3"),
    ("<table><tr><td colspan=99999>t<tr><td colspan=-1>a<td rowspan=x>b</table>", "t\na  b"),
    ("<table><tr><td>" + "w" * 90 + "<td>b<tr><td>a<td>b</table>", "w" * 90 + "  b\na  b"),
    ("<table><tr><td>a<td>b<br>c<td>d<td><br>e</table>", "a  b  d\n   c     e"),
])
def test_cells(page, text):
    if "<br>e" in page:  # an empty first line of a cell is not one
        text = "a  b  d  e\n   c"
    assert html_text.text_of(page) == text


def test_columns_without_a_place_keep_their_text():
    cells = [f"c{i}" for i in range(500)]
    row = "<tr>" + "".join(f"<td>{c}" for c in cells)
    lines = html_text.text_of(f"<table>{row}{row}</table>").split("\n")
    assert len(lines) == 2 and all(line.split() == cells for line in lines)


GROWING = [
    lambda n: "<table><tr><td>" + "long " * n + "<td>x" + "<tr><td>a<td>b" * (n // 4) + "</table>",
    lambda n: "<table>" + "<tr><td rowspan=9999 colspan=9999>a" * (n // 8) + "</table>",
    lambda n: "<table><tr>" + "<td>a" * n + "<td>" + "b<br>" * n + "</table>",
    lambda n: "<table><tr><td>a" * (n // 4),
    lambda n: "<ul><li>a" * (n // 3) + "<ol><li>b" * (n // 3),
    lambda n: "<blockquote>a" * (n // 4) + "<dl><dd>b" * (n // 3),
    lambda n: "<details><summary>a" * (n // 8) + "<p style='visibility:hidden'>b" * (n // 8),
]


@pytest.mark.parametrize("page", GROWING)
def test_layout_grows_with_the_page(page):
    """Pages of 1 and 4 MB: neither time nor text grows faster than the page."""

    def of(n):
        text, began = page(n), time.process_time()
        out = html_text.text_of(text)
        return time.process_time() - began, len(out) / len(text)

    small, large = of(200_000), of(800_000)
    assert large[0] <= 8 * max(small[0], 0.1)
    assert large[1] <= 30 and large[1] <= 1.5 * small[1]


class Visible(HTMLParser):
    """Words that a page shows, by the library's own parser, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words, self.stack = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img"):
            style = dict(attrs).get("style") or ""
            off = "hidden" in dict(attrs) or "display:none" in style or tag in ("script", "style", "template")
            self.stack.append(off)
            self.hidden += off

    def handle_endtag(self, tag):
        if tag not in ("br", "hr", "img"):
            self.hidden -= self.stack.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def drawn(r, depth=0):
    """A random page with all tags closed; cells hold a line, so words keep their order."""
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["p", "div", "b", "text", "ul", "table", "hidden", "br", "script", "section"])
        word = "".join(r.choices("abcdefgh", k=4)) + r.choice(["", "&amp;", "&#233;", "&lt;"])
        off = r.choice([" hidden", " style='display:none'", ""])
        if kind == "text" or depth > 4:
            out.append(f" {word} {word[::2].replace('&', '')} ")
        elif kind == "br":
            out.append("<br>")
        elif kind == "script":
            out.append(f"<script>{word}('<p>')</script>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li{off}> w{i}" + drawn(r, depth + 1) + "</li>" for i in range(3)) + "</ul>")
        elif kind == "table":
            rows = ("".join(f"<td> {word}{i}{j} <i>k</i></td>" for j in range(r.randint(1, 4))) for i in range(3))
            out.append("<table>" + "".join(f"<tr{off if i else ''}>{x}</tr>" for i, x in enumerate(rows)) + "</table>")
        elif kind == "hidden":
            out.append(f"<div{off}> " + drawn(r, depth + 1) + " </div>")
        elif kind == "p":
            out.append(f"<p> {word} <i> {word} </i></p>")
        else:
            out.append(f"<{kind}> " + drawn(r, depth + 1) + f" </{kind}>")
    return "".join(out)


def test_words_are_those_of_another_parser():
    for seed in range(400):
        page = drawn(random.Random(seed))
        other = Visible()
        other.feed(page)
        other.close()
        got = [w for w in html_text.text_of(page).split() if w != "-"]
        assert got == other.words, page


def test_words_of_the_pages_are_those_of_another_parser(spark):
    for (page,) in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        other = Visible()
        other.feed(re.sub("(?s)<head.*?</head>|<meta[^>]*>", "", page or ""))
        other.close()
        assert [w for w in html_text.text_of(page).split() if w != "-"] == other.words


def test_all_visible_words_stay():
    words = [f"w{i}" for i in range(500)]
    tags = ["p", "b", "li", "td", "tr", "div", "ul", "table", "a", "h2", "dd", "span"]
    page = "".join(f"<{tags[i * 7 % 12]}>{w} </{tags[i * 5 % 12]}>" for i, w in enumerate(words))
    assert sorted(html_text.text_of(page).replace("- ", "").split()) == sorted(words)


@pytest.mark.parametrize("part", ["<!-- ", '<a "', "<a x='", "<noscript>", "<script>", "<li>", "<a =", "<p><b>", "<table><tr><td>"])
def test_broken_pages_take_linear_time(part):
    def took(n):
        began = time.process_time()
        html_text.text_of(part * (n // len(part)))
        return time.process_time() - began

    assert took(800_000) <= 40 * max(took(80_000), 0.02)


def test_rows(spark):
    rows = [(1, "<title> A &amp;\n b</title>x", "t"), (None, None, None), (1, "<p>y", "u"), (2, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_text.extracted(pages)
    assert found.columns == ["page_id", "html", "title", "text"]
    got = sorted(found.collect(), key=str)
    assert sorted(((r.page_id, r.title, r.text) for r in got), key=str) == sorted([(1, "A & b", "x"), (None, None, ""), (1, None, "y"), (2, None, "")], key=str)
    assert html_text.extracted(pages.limit(0)).count() == 0
    odd = pages.selectExpr("*", "1 AS `a``b`", "2 AS c0", "3 AS r1")
    assert html_text.extracted(odd).columns == ["page_id", "html", "a`b", "c0", "r1", "title", "text"]
    assert [tuple(r)[2:5] for r in html_text.extracted(odd).collect()] == [(1, 2, 3)] * 4
