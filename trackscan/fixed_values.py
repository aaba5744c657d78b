"""Fixed values.

Every list in this module is data that detection results depend on: host names, regular
expressions, categories and catalogue rows. They are stated as they are and in the order in
which they apply, because first-match rules depend on that order. No logic lives here.
"""

# Hosts searched for in element sources; the first one in this order wins.
TRACKER_DOMAINS = [
    "google-analytics.com",
    "googletagmanager.com",
    "googlesyndication.com",
    "doubleclick.net",
    "googleadservices.com",
    "google.com/analytics",
    "gstatic.com",
    "youtube.com/api",
    "facebook.com",
    "connect.facebook.net",
    "facebook.net",
    "instagram.com",
    "fbcdn.net",
    "amazon-adsystem.com",
    "adsystem.amazon.com",
    "amazonaws.com",
    "cloudfront.net",
    "bing.com",
    "bing.net",
    "bingads.com",
    "msn.com",
    "live.com",
    "microsoft.com",
    "linkedin.com",
    "twitter.com",
    "pinterest.com",
    "snapchat.com",
    "tiktok.com",
    "reddit.com",
    "tumblr.com",
    "hotjar.com",
    "fullstory.com",
    "mixpanel.com",
    "segment.com",
    "amplitude.com",
    "kissmetrics.com",
    "heap.io",
    "logrocket.com",
    "quantserve.com",
    "scorecardresearch.com",
    "chartbeat.com",
    "newrelic.com",
    "bugsnag.com",
    "sentry.io",
    "rollbar.com",
    "raygun.io",
    "optimizely.com",
    "vwo.com",
    "unbounce.com",
    "convertkit.com",
    "launchrock.com",
    "crazyegg.com",
    "mouseflow.com",
    "inspectlet.com",
    "usabilla.com",
    "userreport.com",
    "userzoom.com",
    "uservoice.com",
    "zendesk.com",
    "intercom.io",
    "drift.com",
    "olark.com",
    "zopim.com",
    "livechatinc.com",
    "freshworks.com",
    "helpscout.com",
    "hubspot.com",
    "marketo.com",
    "pardot.com",
    "salesforce.com",
    "mailchimp.com",
    "constantcontact.com",
    "aweber.com",
    "getresponse.com",
    "activecampaign.com",
    "drip.com",
    "klaviyo.com",
    "adobe.com",
    "omniture.com",
    "demdex.net",
    "everesttech.net",
    "outbrain.com",
    "taboola.com",
    "revcontent.com",
    "mgid.com",
    "gravity.com",
    "zemanta.com",
    "bluekai.com",
    "adroll.com",
    "criteo.com",
    "openx.net",
    "rubiconproject.com",
    "smartadserver.com",
    "adform.net",
    "adzerk.net",
    "quantcast.com",
    "smaato.net",
    "yieldbot.com",
    "contextweb.com",
    "casalemedia.com",
    "turn.com",
    "rlcdn.com",
    "serving-sys.com",
    "eyeota.net",
    "exelator.com",
    "addthis.com",
    "sharethis.com",
    "doubleverify.com",
    "ias.net",
    "moat.com",
    "whiteops.com",
    "pixalate.com",
    "crwdcntrl.net",
    "mathtag.com",
    "adsymptotic.com",
    "adnxs.com",
    "amazonaws.com",
    "cloudflare.com",
    "akamai.com",
    "fastly.com",
    "maxcdn.com",
    "mailgun.com",
    "sendgrid.com",
    "mandrill.com",
    "postmark.com",
    "yahoo.com",
    "yandex.com",
    "baidu.com",
    "naver.com",
    "branch.io",
    "appsflyer.com",
    "adjust.com",
    "kochava.com",
    "singular.net",
    "tenjin.io",
]

# Regular expressions searched for in script bodies, ignoring case.
SCRIPT_PATTERNS = [
    r"ga\(.*?\)",
    r"gtag\(.*?\)",
    r"_gaq\.push",
    r"dataLayer\.push",
    "GoogleAnalyticsObject",
    r"gtm\.",
    r"fbq\(.*?\)",
    r"_fbq\.",
    r"facebook\.com/tr",
    r"s\.t\(",
    r"s\.tl\(",
    "adobe_mc",
    r"omtrdc\.net",
    r"demdex\.net",
    r"mixpanel\.",
    "mp_track",
    r"amplitude\.",
    "logEvent",
    r"analytics\.track",
    r"analytics\.page",
    r"analytics\.identify",
    r"hj\(",
    "hotjar",
    r"FS\.",
    "fullstory",
    r"_hsq\.push",
    "hubspot",
    r"Intercom\(",
    "intercom_settings",
    r"drift\.load",
    r"drift\.track",
    "optimizely",
    "optly",
    "crazyegg",
    "CE_API",
    r"heap\.track",
    r"heap\.identify",
    r"_kmq\.push",
    "kissmetrics",
    "LogRocket",
    "logrocket",
    "NREUM",
    "newrelic",
    r"Sentry\.",
    "sentry",
    "Rollbar",
    "rollbar",
    "Bugsnag",
    "bugsnag",
    r"pintrk\(",
    "pinterest",
    r"twq\(",
    "twitter",
    "_linkedin_partner_id",
    "linkedin",
    r"snaptr\(",
    "snapchat",
    r"ttq\.",
    "tiktok",
    "_qevents",
    "quantcast",
    "_sf_async_config",
    "chartbeat",
    "COMSCORE",
    "scorecardresearch",
    r"uetq\.push",
    "bing",
    "_vwo_code",
    "vwo",
    r"branch\.",
    "appsflyer",
    "Adjust",
    r"track\(",
    "pageview",
    r"event\(",
    r"identify\(",
    "utm_",
    "pixel",
    "beacon",
]

# Hosts per category; a found domain belongs to every category whose host it contains.
CATEGORY_DOMAINS = {
    "advertising": [
        "google-analytics.com",
        "googletagmanager.com",
        "doubleclick.net",
        "facebook.com",
        "connect.facebook.net",
        "criteo.com",
        "outbrain.com",
        "taboola.com",
        "adroll.com",
    ],
    "analytics": [
        "mixpanel.com",
        "amplitude.com",
        "segment.com",
        "chartbeat.com",
        "quantcast.com",
    ],
    "social_media": [
        "twitter.com",
        "linkedin.com",
        "pinterest.com",
        "snapchat.com",
        "tiktok.com",
    ],
    "performance": [
        "newrelic.com",
        "sentry.io",
        "rollbar.com",
        "bugsnag.com",
    ],
    "user_experience": [
        "hotjar.com",
        "fullstory.com",
        "crazyegg.com",
        "mouseflow.com",
        "optimizely.com",
    ],
    "marketing": [
        "hubspot.com",
        "marketo.com",
        "mailchimp.com",
        "salesforce.com",
    ],
}

# Names of site-verification meta tags.
VERIFICATION_META = [
    "google-site-verification",
    "facebook-domain-verification",
    "msvalidate.01",
    "pinterest-site-verification",
    "yandex-verification",
    "baidu-site-verification",
]

# Fixed values: (host, category, risk, purpose), matched by equality.
HOST_INTELLIGENCE = [
    ("doubleclick.net", "advertising", "high", "behavioral_advertising"),
    ("facebook.com", "social_advertising", "high", "cross_site_tracking"),
    ("google-analytics.com", "analytics", "medium", "web_analytics"),
    ("criteo.com", "advertising", "high", "retargeting"),
    ("mixpanel.com", "analytics", "medium", "user_analytics"),
    ("amplitude.com", "analytics", "medium", "product_analytics"),
    ("segment.com", "analytics", "medium", "data_collection"),
    ("newrelic.com", "performance", "low", "application_monitoring"),
    ("sentry.io", "performance", "low", "error_tracking"),
]

# Optional pattern families.
PATTERN_FAMILIES = {
    "fingerprinting": [
        r"canvas\.toDataURL",
        "AudioContext",
        "webkitAudioContext",
        r"navigator\.hardwareConcurrency",
        r"screen\.colorDepth",
        r"navigator\.deviceMemory",
    ],
    "webrtc_leaks": [
        "RTCPeerConnection",
        "webkitRTCPeerConnection",
        "mozRTCPeerConnection",
    ],
    "storage_tracking": [
        r"localStorage\.setItem",
        r"sessionStorage\.setItem",
        "indexedDB",
        r"document\.cookie",
    ],
    "timing_attacks": [
        r"performance\.now",
        r"performance\.timing",
        r"Date\.now",
    ],
}

# Field names of a catalogue row.
CATALOGUE_FIELDS = (
    "tracker_id",
    "name",
    "category",
    "risk_level",
    "patterns",
    "domains",
    "description",
    "data_types",
    "gdpr_relevant",
    "ccpa_relevant",
    "detection_method",
    "evasion_techniques",
    "first_seen",
)

# The tracker catalogue, one tuple per tracker in lookup order.
CATALOGUE = [
    (
        "google_analytics",
        "Google Analytics",
        "analytics",
        "medium",
        [
            r"""ga\s*\(\s*["\']send["\']""",
            r"""gtag\s*\(\s*["\']config["\']""",
            r"""gtag\s*\(\s*["\']event["\']""",
            r"_gaq\.push",
            "GoogleAnalyticsObject",
            r"google-analytics\.com/analytics\.js",
            r"google-analytics\.com/ga\.js",
            r"google-analytics\.com/collect",
            r"gtm\.start",
            r"dataLayer\.push",
        ],
        ["google-analytics.com", "googletagmanager.com", "googlesyndication.com"],
        "Google's web analytics service",
        ["page_views", "user_behavior", "demographics", "interests"],
        True,
        True,
        "javascript",
        ["server_side_proxy", "custom_domain"],
        "2005-11-14",
    ),
    (
        "google_ads",
        "Google Ads / DoubleClick",
        "advertising",
        "high",
        [
            r"googletag\.cmd\.push",
            r"googletag\.display",
            r"doubleclick\.net",
            r"googleadservices\.com",
            r"gpt\.js",
            r"conversion\.js",
            r"""gtag\s*\(\s*["\']conversion["\']""",
        ],
        ["doubleclick.net", "googleadservices.com", "googlesyndication.com"],
        "Google's advertising and remarketing platform",
        ["ad_targeting", "conversion_tracking", "remarketing", "audience_segmentation"],
        True,
        True,
        "javascript",
        ["first_party_data", "cookieless_tracking"],
        "2007-04-13",
    ),
    (
        "facebook_pixel",
        "Facebook Pixel",
        "social_advertising",
        "high",
        [
            r"""fbq\s*\(\s*["\']init["\']""",
            r"""fbq\s*\(\s*["\']track["\']""",
            r"""fbq\s*\(\s*["\']trackCustom["\']""",
            r"facebook\.com/tr",
            r"connect\.facebook\.net",
            "_fbp",
            "_fbc",
        ],
        ["facebook.com", "connect.facebook.net", "facebook.net"],
        "Facebook's conversion tracking and advertising pixel",
        ["conversion_tracking", "custom_audiences", "lookalike_audiences", "cross_device_tracking"],
        True,
        True,
        "javascript",
        ["conversions_api", "server_side_events"],
        "2013-10-01",
    ),
    (
        "adobe_analytics",
        "Adobe Analytics",
        "analytics",
        "medium",
        [
            r"s\.t\s*\(",
            r"s\.tl\s*\(",
            r"omtrdc\.net",
            r"demdex\.net",
            "adobe_mc",
            "AppMeasurement",
            "sitecatalyst",
            r"everesttech\.net",
        ],
        ["omtrdc.net", "demdex.net", "everesttech.net", "2o7.net"],
        "Adobe's enterprise analytics platform",
        ["user_analytics", "attribution", "audience_management", "real_time_data"],
        True,
        True,
        "javascript",
        ["first_party_cookies", "device_cooperative"],
        "1996-11-01",
    ),
    (
        "twitter_ads",
        "Twitter Ads",
        "social_advertising",
        "high",
        [
            r"""twq\s*\(\s*["\']init["\']""",
            r"""twq\s*\(\s*["\']track["\']""",
            r"analytics\.twitter\.com",
            r"static\.ads-twitter\.com",
        ],
        ["analytics.twitter.com", "ads-twitter.com", "t.co"],
        "Twitter's advertising and conversion tracking",
        ["conversion_tracking", "audience_insights", "engagement_metrics"],
        True,
        True,
        "javascript",
        ["mobile_app_events"],
        "2013-04-01",
    ),
    (
        "linkedin_insight",
        "LinkedIn Insight Tag",
        "social_advertising",
        "medium",
        [
            "_linkedin_partner_id",
            r"snap\.licdn\.com",
            r"linkedin\.com/li\.lms-analytics",
        ],
        ["snap.licdn.com", "linkedin.com"],
        "LinkedIn's conversion tracking for B2B advertising",
        ["b2b_targeting", "professional_demographics", "conversion_tracking"],
        True,
        True,
        "javascript",
        ["first_party_data_matching"],
        "2016-05-01",
    ),
    (
        "pinterest_tag",
        "Pinterest Tag",
        "social_advertising",
        "medium",
        [
            r"""pintrk\s*\(\s*["\']load["\']""",
            r"""pintrk\s*\(\s*["\']track["\']""",
            r"ct\.pinterest\.com",
        ],
        ["ct.pinterest.com", "pinterest.com"],
        "Pinterest's conversion tracking pixel",
        ["shopping_behavior", "interest_targeting", "conversion_tracking"],
        True,
        True,
        "javascript",
        ["enhanced_match"],
        "2016-02-01",
    ),
    (
        "snapchat_pixel",
        "Snapchat Pixel",
        "social_advertising",
        "medium",
        [
            r"""snaptr\s*\(\s*["\']init["\']""",
            r"""snaptr\s*\(\s*["\']track["\']""",
            r"tr\.snapchat\.com",
        ],
        ["tr.snapchat.com", "sc-static.net"],
        "Snapchat's advertising pixel for mobile-first audience",
        ["mobile_behavior", "demographic_targeting", "app_events"],
        True,
        True,
        "javascript",
        ["snap_pixel_advanced_matching"],
        "2016-10-01",
    ),
    (
        "tiktok_pixel",
        "TikTok Pixel",
        "social_advertising",
        "high",
        [
            r"ttq\.load",
            r"ttq\.page",
            r"ttq\.track",
            r"analytics\.tiktok\.com",
        ],
        ["analytics.tiktok.com", "tiktok.com"],
        "TikTok's advertising pixel for Gen Z targeting",
        ["video_engagement", "mobile_behavior", "trend_analytics"],
        True,
        True,
        "javascript",
        ["events_api"],
        "2019-03-01",
    ),
    (
        "mixpanel",
        "Mixpanel",
        "analytics",
        "medium",
        [
            r"mixpanel\.init",
            r"mixpanel\.track",
            r"mixpanel\.identify",
            "mp_track",
            r"api\.mixpanel\.com",
        ],
        ["api.mixpanel.com", "cdn.mxpnl.com"],
        "Product analytics and user behavior tracking",
        ["event_tracking", "user_journeys", "funnel_analysis", "cohort_analysis"],
        True,
        True,
        "javascript",
        ["identity_resolution"],
        "2009-04-01",
    ),
    (
        "amplitude",
        "Amplitude",
        "analytics",
        "medium",
        [
            r"amplitude\.getInstance",
            r"amplitude\.logEvent",
            r"amplitude\.setUserId",
            r"api\.amplitude\.com",
        ],
        ["api.amplitude.com", "cdn.amplitude.com"],
        "Product intelligence and behavioral analytics",
        ["user_behavior", "retention_analysis", "behavioral_cohorts"],
        True,
        True,
        "javascript",
        ["cross_platform_identification"],
        "2012-01-01",
    ),
    (
        "segment",
        "Segment",
        "analytics",
        "medium",
        [
            r"analytics\.track",
            r"analytics\.page",
            r"analytics\.identify",
            r"analytics\.alias",
            r"api\.segment\.io",
            r"cdn\.segment\.com",
        ],
        ["api.segment.io", "cdn.segment.com"],
        "Customer data platform and analytics infrastructure",
        ["unified_customer_profiles", "event_streaming", "audience_management"],
        True,
        True,
        "javascript",
        ["server_side_libraries"],
        "2011-10-01",
    ),
    (
        "hotjar",
        "Hotjar",
        "user_experience",
        "high",
        [
            r"hj\s*\(",
            "hotjar",
            r"static\.hotjar\.com",
            r"insights\.hotjar\.com",
        ],
        ["static.hotjar.com", "insights.hotjar.com", "vars.hotjar.com"],
        "Heatmaps, session recordings, and user feedback",
        ["session_recordings", "heatmaps", "form_analytics", "feedback"],
        True,
        True,
        "javascript",
        ["ip_anonymization"],
        "2014-11-01",
    ),
    (
        "fullstory",
        "FullStory",
        "user_experience",
        "high",
        [
            r"FS\.",
            "fullstory",
            r"\.fullstory\.com",
        ],
        ["fullstory.com", "edge.fullstory.com"],
        "Digital experience analytics with session replay",
        ["session_recordings", "user_interactions", "error_tracking"],
        True,
        True,
        "javascript",
        ["privacy_controls"],
        "2014-01-01",
    ),
    (
        "crazyegg",
        "Crazy Egg",
        "user_experience",
        "medium",
        [
            "crazyegg",
            "CE_API",
            r"dnn506yrbagrg\.cloudfront\.net",
        ],
        ["crazyegg.com", "dnn506yrbagrg.cloudfront.net"],
        "Heatmap and A/B testing platform",
        ["click_tracking", "heatmaps", "scroll_maps"],
        True,
        True,
        "javascript",
        ["cookieless_tracking"],
        "2006-01-01",
    ),
    (
        "optimizely",
        "Optimizely",
        "optimization",
        "medium",
        [
            "optimizely",
            "optly",
            r"cdn\.optimizely\.com",
            r"logx\.optimizely\.com",
        ],
        ["cdn.optimizely.com", "logx.optimizely.com", "optimizely.com"],
        "A/B testing and experimentation platform",
        ["experiment_data", "conversion_tracking", "user_segmentation"],
        True,
        True,
        "javascript",
        ["edge_side_experiments"],
        "2010-01-01",
    ),
    (
        "hubspot",
        "HubSpot",
        "marketing_automation",
        "medium",
        [
            r"_hsq\.push",
            "hubspot",
            r"js\.hs-scripts\.com",
            r"forms\.hubspot\.com",
        ],
        ["js.hs-scripts.com", "forms.hubspot.com", "hubspot.com"],
        "Inbound marketing and CRM platform",
        ["lead_tracking", "email_engagement", "form_submissions"],
        True,
        True,
        "javascript",
        ["progressive_profiling"],
        "2006-06-01",
    ),
    (
        "newrelic",
        "New Relic",
        "performance",
        "low",
        [
            "NREUM",
            "newrelic",
            r"js-agent\.newrelic\.com",
        ],
        ["js-agent.newrelic.com", "bam.nr-data.net"],
        "Application performance monitoring",
        ["performance_metrics", "error_tracking", "user_timing"],
        False,
        False,
        "javascript",
        ["custom_attributes"],
        "2008-01-01",
    ),
    (
        "canvas_fingerprinting",
        "Canvas Fingerprinting",
        "privacy_invasion",
        "critical",
        [
            r"canvas\.toDataURL",
            r"""getContext\s*\(\s*["\']2d["\']""",
            r"canvas\.getImageData",
            "measureText",
        ],
        [],
        "Browser fingerprinting via canvas element",
        ["device_fingerprint", "browser_fingerprint"],
        True,
        True,
        "javascript",
        ["noise_injection", "permission_prompts"],
        "2012-01-01",
    ),
    (
        "webrtc_leak",
        "WebRTC IP Leak",
        "privacy_invasion",
        "critical",
        [
            "RTCPeerConnection",
            "webkitRTCPeerConnection",
            "mozRTCPeerConnection",
        ],
        [],
        "IP address detection via WebRTC STUN servers",
        ["real_ip_address", "network_information"],
        True,
        True,
        "javascript",
        ["webrtc_blocking"],
        "2013-01-01",
    ),
    (
        "criteo",
        "Criteo",
        "advertising",
        "high",
        [
            "criteo",
            r"cas\.criteo\.com",
            r"static\.criteo\.net",
        ],
        ["cas.criteo.com", "static.criteo.net", "dis.criteo.com"],
        "Personalized retargeting platform",
        ["shopping_behavior", "product_affinity", "purchase_intent"],
        True,
        True,
        "javascript",
        ["first_party_data"],
        "2005-01-01",
    ),
    (
        "tiktok_shop_pixel",
        "TikTok Shop Pixel",
        "e_commerce",
        "high",
        [
            r"""ttq\.track\s*\(\s*["\']CompletePayment["\']""",
            r"""ttq\.track\s*\(\s*["\']AddToCart["\']""",
            r"shop\.tiktok\.com",
        ],
        ["shop.tiktok.com", "analytics.tiktok.com"],
        "TikTok's e-commerce tracking pixel",
        ["purchase_behavior", "shopping_cart", "product_views"],
        True,
        True,
        "javascript",
        ["server_side_api"],
        "2021-01-01",
    ),
]
