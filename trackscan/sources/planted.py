"""Test view over the crawl pages: each page gets one known finding appended.

The crawl sample holds hardly any trackers, so this view plants one kind of finding per page.
It is a single expression that means the same in every SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The planted markup, by remainder of the page number.
PLANTED_HTML = """
CASE WHEN page_id % 16 = 14 THEN '' ELSE concat(html,
  CASE page_id % 16
    WHEN 0 THEN '<img src="https://www.google-analytics.com/collect?v=1" width="1" height="1">'
    WHEN 1 THEN '<noscript><img height="1" width="1" src="https://www.facebook.com/tr?id=1" alt="a>b"></noscript>'
    WHEN 2 THEN '<script src="https://www.googletagmanager.com/gtag/js?id=G"></script><script>fbq("init","1");gtag("config","G");</script>'
    WHEN 3 THEN '<!-- <img src="https://criteo.com/x.gif"> --><iframe src="https://ads.example/x" width=0 height=0></iframe><img data-src="https://criteo.com/y.gif" src="/logo.png">'
    WHEN 4 THEN '<div style="background-image: url(https://b.doubleclick.net/p.gif)">x</div>'
    WHEN 5 THEN '<style>.x{background-image: url("https://ads.criteo.com/b.gif")}</style>'
    WHEN 6 THEN '<img src="data:image/gif;base64,R0lGODlhAQABAAAAACw=" width="1" height="1">'
    WHEN 7 THEN '<meta name="google-site-verification" content="k"><meta property="og:title" content="t"><meta name="twitter:card" content="s">'
    WHEN 8 THEN '<script>Sentry.init({});navigator.sendBeacon("/b");</script>'
    WHEN 9 THEN '<script>var c=canvas.getContext("2d");canvas.toDataURL();new RTCPeerConnection();c.measureText("x");</script>'
    WHEN 10 THEN '<script src="https://doubleclick.net/x.js"></script><script src="//criteo.com/a.js"></script><script src="https://www.mixpanel.com/m.js"></script>'
    WHEN 11 THEN '<img src="/a.png" style="width: 1px"><img src="/b.png" style="width:1px">'
    WHEN 12 THEN '<IMG SRC="/img/Track.gif"><img src="http://cdn.example/p.jpg"><img src="https:&#x2F;&#47;criteo.com&sol;x&period;gif" alt="&notit; a&copy=1 &#128;&#xD800;&#0;&#1;&#x1F600;&#0000065 &#99999999999; &bogus; & &nbsp;&hearts;&CounterClockwiseContourIntegral;&ampx">'
    WHEN 13 THEN repeat('<img src="https://pixel.quantserve.com/p.gif" width="1" height="1">', 25)
    WHEN 15 THEN '<a title=it''s href=x>q</a><img src="https://criteo.com/q.gif"> don''t <b a = "x>y">z</b><noscript><i>n</i><img src="https://pixel.quantserve.com/n.gif"><!-- end'
    ELSE '' END) END
"""

SCAN_TS = "timestampadd(HOUR, page_id, TIMESTAMP '2024-01-01 00:00:00')"


def web_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) with the planted markup, over the whole page table."""
    return pages.select("page_id", "url", F.expr(PLANTED_HTML).alias("html"))
