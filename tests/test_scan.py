"""The basic scan on pages rebuilt to give recorded counts and scores."""

import pytest
from pyspark.sql import functions as F

from trackscan import ScoringParams, scan
from trackscan.plans.basic_scan import detections


def one(pages, html, **options):
    return scan(pages(html), **options).collect()[0]


GTM = "https://www.googletagmanager.com/ns.html?id=G"


def test_noscript_counts_twice_and_repeated_domain_costs_twice(pages):
    row = one(
        pages,
        f'<noscript><iframe src="{GTM}" width="0" height="0"></iframe></noscript>'
        "<script>var o = optimizely;</script><script>x('gtm.start')</script>"
        '<script src="https://cdn.optimizely.com/js/1.js"></script>',
    )
    assert [p.in_noscript for p in row.tracking_pixels] == [False, True]
    assert (row.pixel_count, row.js_tracker_count, row.summary.total_trackers) == (2, 3, 5)
    assert row.privacy_analysis.privacy_score == 56
    assert row.privacy_analysis.risk_level == "Medium"
    assert row.privacy_analysis.detected_categories == ["advertising", "user_experience"]
    assert row.privacy_analysis.high_risk_domains == ["googletagmanager.com"] * 2
    assert row.summary.domains_found == ["googletagmanager.com", "optimizely.com"]
    assert row.privacy_analysis.recommendations == [
        "Consider using ad blockers or privacy-focused browsers",
        "Review and adjust ad personalization settings",
        "High-risk tracking domains detected - consider VPN usage",
    ]


def test_external_script_six_patterns_and_six_metas(pages):
    row = one(
        pages,
        '<meta property="og:a" content="1">' * 6
        + '<script src="https://www.googletagmanager.com/gtag/js"></script>'
        + "<script>gtag('x'); dataLayer.push(1)</script><script>twitter</script>"
        + "<script>event(1)</script>" * 2
        + "<script>pageview</script>",
    )
    assert row.summary.total_trackers == 13
    assert row.privacy_analysis.privacy_score == 64


def test_meta_only(pages):
    row = one(pages, '<meta property="og:a" content="1">' * 9)
    assert (row.summary.total_trackers, row.privacy_analysis.privacy_score) == (9, 100)
    assert row.privacy_analysis.risk_level == "Low"
    assert row.privacy_analysis.recommendations == [
        "Minimal tracking detected - privacy impact is low"
    ]


def test_empty_and_failed_page(pages):
    clean, bad = scan(pages("<p>hi</p>", ("https://x.example/", ""))).orderBy("page_id").collect()
    assert (clean.summary.total_trackers, clean.privacy_analysis.privacy_score) == (0, 100)
    assert clean.summary.domains_found == []
    assert bad.error == "Failed to fetch page content"
    assert bad.url == "https://x.example/" and bad.summary is None


def test_pixel_by_domain_without_size(pages):
    row = one(pages, '<img hidden="" src="https://id.rlcdn.com/472486.gif"/>')
    (pixel,) = row.tracking_pixels
    assert (pixel.is_1x1_pixel, pixel.tracking_domain) == (False, "rlcdn.com")
    assert (pixel.width, pixel.height) == ("", "")


def test_two_patterns_in_one_script(pages):
    row = one(pages, "<script>Sentry.init({})</script>")
    assert [s.pattern for s in row.javascript_trackers] == [r"Sentry\.", "sentry"]


def test_score_floor(pages):
    row = one(pages, '<img src="https://x.quantserve.com/p.gif" width="1" height="1">' * 40)
    assert (row.privacy_analysis.privacy_score, row.privacy_analysis.risk_level) == (0, "High")


def test_base64_pixel_counts_on_top(pages):
    row = one(pages, '<img src="data:image/gif;base64,R0lGOD" width="1" height="1">')
    assert row.pixel_count == 2
    assert [p.tracking_type for p in row.tracking_pixels] == [None, "base64_pixel"]
    long = one(pages, f'<img src="data:image/gif;base64,{"A" * 300}" width="1" height="1">')
    assert long.tracking_pixels[1].src == "data:image/gif;base64," + "A" * 78 + "..."


def test_style_spacing_is_exact(pages):
    row = one(
        pages,
        '<img src="/a" style="max-width: 1px"><img src="/b" style="width:1px">'
        '<img src="/c" style="height: 1px">',
    )
    assert [p.src for p in row.tracking_pixels] == ["/a", "/c"]


def test_first_domain_in_list_order(pages):
    row = one(
        pages,
        '<script src="https://connect.facebook.net/x?u=https://criteo.com"></script>'
        '<script src="https://saturn.com/a.js"></script><script src="https://CRITEO.com/"></script>',
    )
    assert [s.domain for s in row.javascript_trackers] == ["connect.facebook.net", "turn.com"]


def test_meta_rules(pages):
    row = one(
        pages,
        '<meta name="Google-Site-Verification" property="og:x" content="v">'
        '<meta name="" property="msvalidate.01" content="m">'
        '<meta property="FB:app" content="f"><meta name="twitter:card" content="t">',
    )
    found = [(m.type, m.name, m.property, m.content) for m in row.meta_trackers]
    assert found == [
        ("verification_meta", "google-site-verification", None, "v"),
        ("verification_meta", "msvalidate.01", None, "m"),
        ("social_meta", None, "fb:app", "f"),
    ]


def test_css_rules(pages):
    row = one(
        pages,
        "<style>a{BACKGROUND-IMAGE: url('https://x.criteo.com/1')}b{background-image:url(/own)}</style>"
        '<p style="BACKGROUND-IMAGE:url(https://criteo.com/2)">'
        '<p style="background-image:url(https://criteo.com/3)">',
    )
    # The inline test is case-sensitive, the one for style elements is not.
    assert [(c.type, c.url) for c in row.css_trackers] == [
        ("css_background", "https://x.criteo.com/1"),
        ("inline_css_background", "https://criteo.com/3"),
    ]
    assert row.privacy_analysis.privacy_score == 80


def test_snippet_and_source(pages):
    body = "track(" + "x" * 300
    row = one(pages, f"<script>{body}</script><img src='/track.gif'>")
    assert row.javascript_trackers[0].content_snippet == body[:200] + "..."
    assert row.tracking_pixels[0].full_element == "<img src='/track.gif'>"
    assert one(pages, "<img src='/track'>", with_source=False).tracking_pixels[0].full_element is None


def test_parameters_are_checked_and_used(pages):
    with pytest.raises(ValueError):
        ScoringParams(tracking_pixel=-1)
    with pytest.raises(ValueError):
        ScoringParams(low=10, medium=50)
    with pytest.raises(ValueError):
        ScoringParams(external_script="8")
    row = one(pages, "<img src='/track'>", params=ScoringParams(tracking_pixel=60))
    assert (row.privacy_analysis.privacy_score, row.privacy_analysis.risk_level) == (40, "High")


def test_user_lists(pages):
    row = one(
        pages,
        '<script src="https://my.tracker.test/a.js"></script><script>zz1 = 7</script>',
        domains=["tracker.test"],
        custom_patterns=[r"zz\d", "a|b"],
    )
    assert [(s.domain, s.pattern) for s in row.javascript_trackers] == [
        ("tracker.test", None),
        (None, r"zz\d"),
    ]


def test_scan_plan_has_no_exchange_and_one_lexer(pages, capsys):
    df = scan(pages("<p>")).filter(F.col("privacy_analysis.risk_level") == "High")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("Generate explode(array(CASE") == 1
    # The filter is above the detection, not below it with a copy of the lexer.
    assert plan.count("regexp_extract_all(html") <= 3


def test_detections_drop_nothing(pages):
    scanned = scan(pages('<img src="/track">' * 3, "<p>", ""))
    assert detections(scanned, "tracking_pixels").count() == 3


def test_in_row_score_equals_exploded_score(spark):
    from checks.query_set import pages_of

    scanned = scan(pages_of(spark, "/root/testdata/sf0.001"), with_source=False).cache()
    lost = (
        detections(scanned, "tracking_pixels").select("page_id", F.lit(5).alias("w"))
        .unionByName(
            detections(scanned, "javascript_trackers").select(
                "page_id", F.when(F.col("type") == "external_script", 8).otherwise(3).alias("w")
            )
        )
        .unionByName(
            scanned.select(
                "page_id", F.explode("privacy_analysis.high_risk_domains")
            ).select("page_id", F.lit(10).alias("w"))
        )
        .groupBy("page_id")
        .agg(F.sum("w").alias("lost"))
    )
    both = scanned.filter("error IS NULL").join(lost, "page_id", "left").select(
        F.col("privacy_analysis.privacy_score").alias("score"),
        F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).alias("expected"),
    )
    assert both.filter("score <> expected").count() == 0
    assert both.filter("score < 0").count() == 0
    scanned.unpersist()
