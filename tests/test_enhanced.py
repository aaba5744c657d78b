"""The enhanced scan, requests and addresses."""

from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from trackscan import enhanced_scan
from trackscan.functions import urls
from trackscan.operators import requests
from trackscan.sources.requests import requests_of_pages


def test_hosts_match_exactly(pages):
    row = enhanced_scan(
        pages(
            '<script src="https://doubleclick.net/x"></script><script src="//criteo.com/a"></script>'
            '<script src="https://www.mixpanel.com/m"></script><script src="//sentry.io:80/"></script>'
            '<script src="//segment.com"></script>'
        )
    ).collect()[0]
    assert [t.domain for t in row.trackers] == ["doubleclick.net", "criteo.com", "segment.com"]
    assert row.privacy_score == 100 - 25 - 25 - 8
    assert row.risk_assessment.overall_risk == "medium"
    assert row.risk_assessment.data_collection == ["behavioral_profiling", "usage_analytics"]
    assert row.trackers[0].details["element"].startswith("<script src=")


def test_fingerprint_rules_and_failed_page(pages):
    rows = (
        enhanced_scan(
            pages(
                ("https://u@h.example:8080/x", "a.getContext('2d'); webkitRTCPeerConnection MEASURETEXT"),
                ("https://b.example/", ""),
            )
        )
        .orderBy("page_id")
        .collect()
    )
    assert [t.source for t in rows[0].trackers] == [
        "canvas_fingerprinting",
        "webrtc_detection",
        "font_fingerprinting",
    ]
    assert {t.domain for t in rows[0].trackers} == {"u@h.example:8080"}
    assert rows[0].privacy_score == 100 - 35 - 35 - 28
    assert rows[0].risk_assessment.overall_risk == "high"
    assert (rows[1].tracker_count, rows[1].privacy_score) == (0, 100)


URLS = [
    "https://a.b/c/d.gif?x=1&y=&z&x=2#f?g=1",
    "//host_name.com/p;q?utm_source=a+b&%75tm=1&bad%zz=3",
    "/only/path?_ga=1",
    "https://user:pw@h:8/?",
    "mailto:x@y.z",
    "https://h|x y/p",
    "",
    "HTTP://UP.example/?a=b=c",
]


def test_url_parts_equal_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    u = F.col("u")
    rows = df.select(u, urls.netloc(u), urls.path(u), urls.query(u), urls.query_keys(u)).collect()
    for url, netloc, path, query, keys in rows:
        want = urlparse(url)
        # `;` parameters are a part of their own there, and part of the path here.
        want_path = want.path + (f";{want.params}" if want.params else "")
        assert (netloc, path, query) == (want.netloc, want_path, want.query), url
        assert sorted(keys) == sorted(parse_qs(want.query)), url


def test_scheme(spark):
    df = spark.createDataFrame([("a.b",), ("http://a",), ("https://a",), ("ftp://a",)], "u string")
    assert [r[0] for r in df.select(urls.with_scheme(F.col("u"))).collect()] == [
        "https://a.b",
        "http://a",
        "https://a",
        "https://ftp://a",
    ]


def test_request_rules(spark, pages):
    log = spark.createDataFrame(
        [
            (1, "https://t.example/Pixel.gif?UTM_x=1&fbclid=2&q=3"),
            (2, "https://t.example/a.GIF?pixel=1"),
            (3, "https://t.example/pixel/b.png#x"),
            (4, "https://t.example/pixel.js?gclid="),
        ],
        "page_id bigint, url string",
    )
    found = requests.tracking_parameters(log).collect()
    assert {(r.page_id, r.parameter) for r in found} == {(1, "UTM_x"), (1, "fbclid")}
    assert sorted(r.page_id for r in requests.pixel_requests(log).collect()) == [1, 3]
    own = requests_of_pages(pages("<img src='/a'><img><iframe src='/b'>")).collect()
    assert [r.resource_type for r in own] == ["document", "img", "iframe"]
