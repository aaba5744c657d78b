"""The lexer against the tokenizer of the standard library, and its safety on large input."""

from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackscan.functions import lex


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        # Of repeated attributes the last counts.
        self.seen.append((tag, {k: v or "" for k, v in attrs}))


def parsed(html):
    parser = Tags()
    parser.feed(html)
    parser.close()
    return parser.seen


def lexed(pages, *htmls):
    rows = (
        pages(*htmls)
        .select("page_id", F.inline(lex.all_elements(F.col("html"))))
        .orderBy("page_id", "pos")
        .collect()
    )
    found = [[] for _ in htmls]
    for row in rows:
        found[row.page_id].append((row.tag, {a.name: a.value for a in row.attrs}))
    return found


def test_attribute_cases(pages):
    html = (
        '<img data-src="a" src=/b.png ALT="x > y src=c"><IMG SRC=\'d\' src="e">'
        '<a href="?a=1&amp;b=&lt;2&gt;" disabled><br/><script src=x />'
        "<p title=''>"
    )
    assert lexed(pages, html)[0] == parsed(html)


def test_raw_text_and_comments(pages):
    html = (
        '<!-- <img src="no"> --><script>if (a</p>) "<img src=1>";</script>'
        "<style>p > a {}</style ><SCRIPT >x</ScRiPt\n><b>end</b>"
    )
    assert [t for t, _ in lexed(pages, html)[0]] == [t for t, _ in parsed(html)]


def test_unclosed_script_takes_the_rest(pages):
    rows = pages("<script>var a = '<img src=1>'").select(F.inline(lex.all_elements(F.col("html"))))
    assert [(r.tag, r.body) for r in rows.collect()] == [("script", "var a = '<img src=1>'")]


def test_sample_pages_match_tokenizer(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(path).select("page_id", "html")
    ours = Counter(
        (r.page_id, r.tag)
        for r in pages.select("page_id", F.inline(lex.all_elements(F.col("html")))).collect()
    )
    theirs = Counter((r.page_id, tag) for r in pages.collect() for tag, _ in parsed(r.html))
    assert ours == theirs


NAMES = st.sampled_from(["img", "iframe", "div", "a", "meta", "p"])
VALUES = st.text(alphabet="abc01 ></='.-&;", max_size=12)
ATTRS = st.lists(
    st.tuples(st.sampled_from(["src", "data-src", "Width", "style", "alt"]), VALUES), max_size=4
)
PIECES = st.one_of(
    st.text(alphabet="ab c.", max_size=8),
    st.builds(lambda c: f"<!--{c}-->", st.text(alphabet="ab <>img=", max_size=8)),
    st.builds(lambda b: f"<script>{b}</script>", st.text(alphabet="ab<>p/(\" ", max_size=8)),
    st.builds(
        lambda n, attrs: f"<{n}" + "".join(f' {k}="{v}"' for k, v in attrs) + ">", NAMES, ATTRS
    ),
    st.builds(lambda n: f"</{n}>", NAMES),
)


@pytest.mark.filterwarnings("ignore")
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=40, max_size=60))
def test_generated_pages(pages, htmls):
    # One Spark job per example set; the values hold no entity the lexer does not decode.
    assert lexed(pages, *htmls) == [parsed(h) for h in htmls]


def test_large_tags_do_not_overflow_the_stack(pages):
    size = 300_000
    htmls = [
        f'<img src="{"a" * size}">',
        "<img " + "a='b' " * (size // 6) + ">",
        "<img " + '"' * (size + 1) + ">",
        "<script>" + "x>'\"" * (size // 4) + "</script>",
        "<style>" + "a{background-image:url(x)}" * (size // 26) + "</style>",
        "<noscript>" + '<img src="https://criteo.com/">' * 5000 + "</noscript>",
        "<!--" + "-" * size,
    ]
    from trackscan import scan

    rows = scan(pages(*htmls)).select("page_id", "pixel_count").orderBy("page_id").collect()
    assert [r.pixel_count for r in rows] == [0, 0, 0, 0, 0, 10000, 0]


BROKEN = [
    """<a title=it's href=x>q</a><img src="https://criteo.com/x.gif"> don't <b>z</b>""",
    '<a href="x>q</a><img src="https://criteo.com/x.gif"><i class="c">',
    "<p a='1\"2' b=\"3'4\" c=5'6 d>x<b e = 'f>g' h==i>y",
    "<noscript><i>n</i><img src=1><!-- end",
    "a < b <c d=e>f <1> <g/>",
    "<a x=1 'y z' \"w>v<i>",
]


def test_broken_tags_match_tokenizer(pages):
    found = lexed(pages, *BROKEN)
    assert [[t for t, _ in x] for x in found] == [[t for t, _ in parsed(h)] for h in BROKEN]
    assert found[0] == parsed(BROKEN[0])


def test_left_open_at_the_end(pages):
    htmls = ['<b>x</b><img src="https://criteo.com/x.gif>', "<b><img src=1 ", "<b><!-- <img src=1>"]
    assert [[t for t, _ in x] for x in lexed(pages, *htmls)] == [["b"]] * 3


@pytest.mark.parametrize("part", ["<!-- ", '<a "', "<noscript>", "<a b='", "<script ", "<style>", "</script", "<a =="])
def test_broken_pages_take_linear_time(spark, part):
    import time

    def took(size):
        html = F.repeat(F.lit(part), size // len(part))
        rows = spark.range(1).select(html.alias("html"))
        began = time.perf_counter()
        rows.select(F.size(lex.tokens(F.col("html"))), F.size(lex.noscript_tokens(F.col("html")))).collect()
        return time.perf_counter() - began

    took(40_000)
    small, large = took(400_000), took(4_000_000)
    assert large < 30 * max(small, 0.3)


def test_character_references_are_the_parsers(spark):
    from html import unescape

    texts = [
        "https:&#x2F;&#47;criteo.com&sol;x.gif", "&amp;lt; &amp;amp;", "&notit; &notin; &not", "a=1&copy=2&reg",
        "&#128;&#129;&#159;&#x80;", "&#0;&#xD800;&#xDFFF;&#x110000;&#99999999999999999999;", "&#1;&#8;&#9;&#11;&#13;&#31;&#127;",
        "&#xFDD0;&#xFFFE;&#x1FFFF;&#x1F600;&#0000065;&#x0041", "&bogus; &;& &# &#x &#xg; &x", "&nbsp;&hearts;&Aacute&aacute",
        "&CounterClockwiseContourIntegral;", "&ampx;&AMP;&AMPamp;", "&" * 40 + "lt;", "&" + "a" * 50 + ";", "&acE;&NotEqualTilde;",
        "plain", "", "é&eacute;日&#26085;",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", lex.unescape(F.col("t")).alias("d")).collect()}
    assert got == {i: unescape(t) for i, t in enumerate(texts)}
