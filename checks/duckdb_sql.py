"""The registered queries in SQL for DuckDB.

Written relationally, with one row per element, attribute and match, where the Spark plans
work on arrays inside the page row; the two share only the fixed values and the planted view.
"""

from __future__ import annotations

from html.entities import html5

from trackscan import fixed_values as fixed
from trackscan.sources.planted import PLANTED_HTML


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rows(values) -> str:
    """VALUES rows of python tuples."""

    def cell(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else text(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in values)


# Without possessive groups: the alternatives of a tag's text exclude each other instead.
AT = r"""(?:[^>=]|=+\s*"[^"]*"|=+\s*'[^']*'|=+\s*[^"'\s>=])*(?:=+\s*)?"""
OPEN_END = r"""(?:=+\s*(?:"[^"]*|'[^']*))?\z"""
OPEN = {name: rf"<{name}(?:[\s/]{AT})?>" for name in ("script", "style", "noscript")}
RAW = "|".join(rf"{OPEN[n]}.*?(?:</{n}\s*>|\z)" for n in ("script", "style"))
TAG = rf"</?[a-z][a-z0-9]*{AT}"
TOKEN = rf"(?is)(<!--.*?(?:-->|\z)|{RAW}|{TAG}>)|{TAG}{OPEN_END}"
NOSCRIPT = rf"(?is)<!--.*?(?:-->|\z)|{RAW}|{OPEN['noscript']}.*?(?:</noscript\s*>|\z)|{TAG}(?:>|{OPEN_END})"
HEAD = rf"(?s)^<[a-zA-Z][^\s/>]*({AT})>"
BODY = rf"(?is)^<(?:script|style)(?:[\s/]{AT})?>(.*?)(?:</(?:script|style)\s*>)?\z"
ATTRIBUTE = r"""([^\s>/=]+)(?:\s*=+\s*("[^"]*"|'[^']*'|[^\s>]+))?"""
# A character reference with all that its name could be, or what is between references.
PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
# The characters of numbers 128 to 159; five are control characters.
WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
BACKGROUND = r"""(?i)background-image:\s*url\(["']?([^"')]+)["']?\)"""
NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
TS = "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id))"


def host(column: str) -> str:
    return f"regexp_extract({column}, {text(NETLOC)}, 1)"


def cut(column: str, size: int) -> str:
    return (
        f"CASE WHEN length({column}) > {size} THEN substr({column}, 1, {size}) || '...'"
        f" ELSE {column} END"
    )


def first_domain(column: str) -> str:
    return f"(SELECT arg_min(d.domain, d.ord) FROM dom d WHERE contains({column}, d.domain))"


CTES = {
    "dom": f"SELECT * FROM (VALUES {rows(enumerate(fixed.TRACKER_DOMAINS))}) t(ord, domain)",
    "pat": f"SELECT * FROM (VALUES {rows(enumerate(fixed.SCRIPT_PATTERNS))}) t(ord, pattern)",
    "fam": "SELECT * FROM (VALUES "
    + rows((f, p) for f, ps in fixed.PATTERN_FAMILIES.items() for p in ps)
    + ") t(family, pattern)",
    "cdom": "SELECT * FROM (VALUES "
    + rows((c, d) for c, ds in fixed.CATEGORY_DOMAINS.items() for d in ds)
    + ") t(category, cdomain)",
    "intel": f"SELECT * FROM (VALUES {rows(fixed.HOST_INTELLIGENCE)})"
    " t(domain, category, risk, purpose)",
    "cat": "SELECT * FROM (VALUES "
    + rows(
        (i, t[0], t[1], t[2], t[3], t[6], ";".join(t[7]), t[8], t[9], t[10], ";".join(t[11]), t[12])
        for i, t in enumerate(fixed.CATALOGUE)
    )
    + ") t(ord, tracker_id, name, category, risk_level, description, data_types,"
    " gdpr_relevant, ccpa_relevant, detection_method, evasion_techniques, first_seen)",
    "cpat": "SELECT * FROM (VALUES "
    + rows((t[0], i, p) for t in fixed.CATALOGUE for i, p in enumerate(t[4]))
    + ") t(tracker_id, pos, pattern)",
    "chost": "SELECT * FROM (VALUES "
    + rows((t[0], i, d) for t in fixed.CATALOGUE for i, d in enumerate(t[5]))
    + ") t(tracker_id, pos, domain)",
    "web": f"SELECT page_id, url, {PLANTED_HTML} AS html FROM pages",
    # All elements of a page in order.
    "toks": "SELECT page_id, url, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM"
    f" (SELECT page_id, url, regexp_extract_all(html, {text(TOKEN)}, 1) AS l FROM web)",
    "els": "SELECT page_id, url, false AS ns, row_number() OVER (PARTITION BY page_id ORDER BY i)"
    " - 1 AS pos, tok FROM toks WHERE regexp_matches(tok, '^<[a-zA-Z]')",
    # Elements inside noscript blocks.
    "nsblocks": "SELECT page_id, url, b, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM"
    f" (SELECT page_id, url, b, regexp_extract_all(block, {text(TOKEN)}, 1) AS l FROM"
    " (SELECT page_id, url, unnest(l) AS block, generate_subscripts(l, 1) AS b FROM"
    f" (SELECT page_id, url, regexp_extract_all(html, {text(NOSCRIPT)}) AS l FROM web))"
    " WHERE regexp_matches(block, '(?i)^<noscript[\\s/>]'))",
    "nsels": "SELECT page_id, url, true AS ns, row_number() OVER (PARTITION BY page_id ORDER BY b, i)"
    " - 1 AS pos, tok FROM nsblocks WHERE regexp_matches(tok, '^<[a-zA-Z]')",
    "every": "SELECT *, lower(regexp_extract(tok, '^<([a-zA-Z][^\\s/>]*)', 1)) AS tag,"
    f" regexp_extract(tok, {text(HEAD)}, 1) AS head,"
    " CASE WHEN regexp_matches(tok, '(?i)^<s(?:cript|tyle)[\\s/>]')"
    f" THEN regexp_extract(tok, {text(BODY)}, 1) ELSE '' END AS body"
    " FROM (SELECT * FROM els UNION ALL SELECT * FROM nsels)",
    "rawattrs": "SELECT page_id, ns, pos, unnest(n) AS name, unnest(v) AS value,"
    " generate_subscripts(n, 1) AS i FROM (SELECT page_id, ns, pos,"
    f" regexp_extract_all(head, {text(ATTRIBUTE)}, 1) AS n,"
    f" regexp_extract_all(head, {text(ATTRIBUTE)}, 2) AS v FROM every)",
    "bare": "SELECT page_id, ns, pos, i, lower(name) AS name, CASE WHEN regexp_matches(value, '^[\"'']')"
    " THEN substr(value, 2, length(value) - 2) ELSE value END AS value FROM rawattrs",
    # Character references: a row for each piece of a value that has an ampersand.
    "refs": f"SELECT * FROM (VALUES {rows(html5.items())}) t(name, char)",
    "pieces": "SELECT page_id, ns, pos, i, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM"
    f" (SELECT *, regexp_extract_all(value, {text(PIECES)}) AS l FROM bare WHERE contains(value, '&'))",
    "numbers": "SELECT page_id, ns, pos, i, k, CASE WHEN regexp_matches(p, '^&#[xX]')"
    " THEN try_cast('0x' || regexp_extract(p, '^&#[xX]0*([0-9a-fA-F]+)', 1) AS BIGINT)"
    " ELSE try_cast(regexp_extract(p, '[0-9]+') AS BIGINT) END AS n"
    " FROM pieces WHERE regexp_matches(p, '^&#([0-9]|[xX][0-9a-fA-F])')",
    "points": "SELECT page_id, ns, pos, i, k, CASE WHEN n IS NULL OR n = 0 OR n > 1114111"
    " OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 128 AND 159"
    f" THEN substr({text(WINDOWS)}, (n - 127)::INT, 1)"
    " WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007"
    " OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END AS c FROM numbers",
    "words": "SELECT DISTINCT p, substr(p, 2) AS name FROM pieces WHERE regexp_matches(p, '^&[^#]')",
    "known": "SELECT w.p, coalesce(any_value(e.char), max_by(o.char || substr(w.name, length(o.name) + 1),"
    " length(o.name)), w.p) AS c FROM words w LEFT JOIN refs e ON e.name = w.name"
    " LEFT JOIN (SELECT * FROM refs WHERE name NOT LIKE '%;') o ON starts_with(w.name, o.name) GROUP BY w.p",
    "joined": "SELECT page_id, ns, pos, i, string_agg(coalesce(q.c, w.c, p), '' ORDER BY k) AS value"
    " FROM pieces LEFT JOIN points q USING (page_id, ns, pos, i, k) LEFT JOIN known w USING (p)"
    " GROUP BY page_id, ns, pos, i",
    "attrs": "SELECT b.page_id, b.ns, b.pos, b.i, b.name, coalesce(j.value, b.value) AS value FROM bare b"
    " LEFT JOIN joined j ON b.page_id = j.page_id AND b.ns = j.ns AND b.pos = j.pos AND b.i = j.i",
    "wide": "SELECT page_id, ns, pos, "
    + ", ".join(
        f"arg_max(value, i) FILTER (WHERE name = '{n}') AS {n}_"
        for n in ("src", "width", "height", "style", "name", "property", "content")
    )
    + " FROM attrs GROUP BY page_id, ns, pos",
    "ev": "SELECT e.*, "
    + ", ".join(
        f"coalesce(w.{n}_, '') AS a_{n}"
        for n in ("src", "width", "height", "style", "name", "property", "content")
    )
    + " FROM every e LEFT JOIN wide w ON e.page_id = w.page_id AND e.ns = w.ns AND e.pos = w.pos",
    "px": "SELECT * FROM (SELECT page_id, tag AS element_type, a_src AS src, a_width AS width,"
    " a_height AS height, (a_width = '1' AND a_height = '1') OR (a_width = '0' AND a_height = '0')"
    " OR contains(a_style, 'width: 1px') OR contains(a_style, 'height: 1px') AS is_1x1_pixel,"
    f" {first_domain('a_src')} AS tracking_domain, regexp_matches(lower(a_src),"
    " 'utm_|track|pixel|beacon|analytics|event|campaign') AS has_tracking_params,"
    " ns AS in_noscript FROM ev WHERE tag IN ('img', 'iframe'))"
    " WHERE is_1x1_pixel OR tracking_domain IS NOT NULL OR has_tracking_params OR in_noscript",
    "b64": f"SELECT page_id, {cut('a_src', 100)} AS src, a_width AS width, a_height AS height"
    " FROM ev WHERE NOT ns AND tag = 'img' AND contains(a_src, 'data:image')"
    " AND contains(a_src, 'base64')"
    " AND ((a_width = '1' AND a_height = '1') OR length(a_src) < 200)",
    "ext": "SELECT * FROM (SELECT page_id, a_src AS src, tok,"
    f" {first_domain('a_src')} AS domain FROM ev WHERE NOT ns AND tag = 'script')"
    " WHERE domain IS NOT NULL",
    "inl": f"SELECT e.page_id, e.pos, p.ord, p.pattern, {cut('e.body', 200)} AS content_snippet"
    " FROM ev e JOIN pat p ON regexp_matches(e.body, '(?i)' || p.pattern)"
    " WHERE NOT e.ns AND e.tag = 'script' AND e.body <> ''",
    "meta": "SELECT page_id, CASE WHEN ver THEN 'verification_meta' ELSE 'social_meta' END AS type,"
    " CASE WHEN ver THEN coalesce(nullif(n, ''), p) END AS name,"
    " CASE WHEN NOT ver THEN p END AS property, a_content AS content FROM"
    " (SELECT *, n IN (SELECT name FROM vm) OR p IN (SELECT name FROM vm) AS ver FROM"
    " (SELECT page_id, lower(a_name) AS n, lower(a_property) AS p, a_content FROM ev"
    " WHERE NOT ns AND tag = 'meta')) WHERE ver OR regexp_matches(p, '^(og|twitter|fb):')",
    "vm": f"SELECT * FROM (VALUES {rows((n,) for n in fixed.VERIFICATION_META)}) t(name)",
    "css": "SELECT * FROM (SELECT page_id, type, url,"
    f" {first_domain('url')} AS domain FROM (SELECT page_id, 'css_background' AS type,"
    f" unnest(regexp_extract_all(body, {text(BACKGROUND)}, 1)) AS url FROM ev"
    " WHERE NOT ns AND tag = 'style' UNION ALL SELECT page_id, 'inline_css_background',"
    f" unnest(regexp_extract_all(a_style, {text(BACKGROUND)}, 1)) FROM ev"
    " WHERE NOT ns AND contains(a_style, 'background-image'))) WHERE domain IS NOT NULL",
    "bag": "SELECT page_id, tracking_domain AS domain FROM px WHERE tracking_domain IS NOT NULL"
    " UNION ALL SELECT page_id, domain FROM ext UNION ALL SELECT page_id, domain FROM css",
    "risky": "SELECT b.page_id, b.domain, c.category FROM bag b JOIN (SELECT DISTINCT d.domain,"
    " c.category FROM (SELECT DISTINCT domain FROM bag) d JOIN cdom c"
    " ON contains(d.domain, c.cdomain)) c ON b.domain = c.domain",
    "counts": "SELECT page_id, "
    + ", ".join(
        f"(SELECT count(*) FROM {t} x WHERE x.page_id = w.page_id) AS {n}"
        for t, n in (
            ("px", "n_px"),
            ("b64", "n_b64"),
            ("ext", "n_ext"),
            ("inl", "n_inl"),
            ("meta", "n_meta"),
            ("css", "n_css"),
        )
    )
    + ", (SELECT count(*) FROM risky r WHERE r.page_id = w.page_id AND r.category IN"
    " ('advertising', 'social_media')) AS n_risky FROM web w WHERE html <> ''",
    "res": f"SELECT w.page_id, w.url, {TS.replace('page_id', 'w.page_id')} AS scan_ts,"
    " CASE WHEN w.html = '' THEN 'Failed to fetch page content' END AS error,"
    " n_px + n_b64 AS pixels, n_ext + n_inl AS js, n_meta AS metas, n_css AS css,"
    " n_px + n_b64 + n_ext + n_inl + n_meta + n_css AS total,"
    " CAST(greatest(0, 100 - 5 * (n_px + n_b64) - 8 * n_ext - 3 * n_inl - 10 * n_risky) AS BIGINT)"
    " AS score, n_ext, n_inl, n_risky, n_px + n_b64 AS n_pixels"
    " FROM web w LEFT JOIN counts c ON w.page_id = c.page_id",
    "scored": "SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN score > 80 THEN 'Low'"
    " WHEN score > 50 THEN 'Medium' ELSE 'High' END AS risk FROM res",
    "pd": "SELECT DISTINCT page_id, domain FROM bag",
    "pcat": "SELECT DISTINCT page_id, category FROM risky",
    "hit": "SELECT w.page_id, p.tracker_id, 0 AS kind, p.pos, p.pattern, 'regex_match' AS type"
    " FROM web w JOIN cpat p ON regexp_matches(w.html, '(?i)' || p.pattern) WHERE w.html <> ''"
    " UNION ALL SELECT w.page_id, h.tracker_id, 1, h.pos, h.domain, 'domain_match' FROM web w"
    " JOIN chost h ON contains(w.html, h.domain) OR contains(w.url, h.domain) WHERE w.html <> ''",
    "det": "SELECT page_id, tracker_id,"
    " string_agg(pattern || ':' || type, '|' ORDER BY kind, pos) AS matches,"
    " CAST(count(*) AS BIGINT) AS n_matches FROM hit GROUP BY page_id, tracker_id",
    "seen": "SELECT * FROM cat WHERE tracker_id IN (SELECT tracker_id FROM det)",
    # Enhanced trackers: exact script hosts, then the fingerprinting rules.
    "finger": "SELECT page_id, tracker_type, domain, source, 'privacy_invasion' AS category, risk_level,"
    f" purpose FROM (SELECT page_id, html, {host('url')} AS domain FROM web) w JOIN (VALUES"
    " ('fingerprinting', 'canvas_fingerprinting', 'high', 'device_fingerprinting',"
    " '(?i)canvas\\.toDataURL|getContext\\([\"'']2d[\"'']\\)'),"
    " ('webrtc_leak', 'webrtc_detection', 'high', 'ip_leak',"
    " '(?i)RTCPeerConnection|webkitRTCPeerConnection'),"
    " ('fingerprinting', 'font_fingerprinting', 'medium', 'font_fingerprinting',"
    " '(?i)@font-face|fontface|measureText')) r(tracker_type, source, risk_level, purpose, rule)"
    " ON regexp_matches(w.html, r.rule)",
    "hosts": "SELECT s.page_id, 'javascript' AS tracker_type, s.domain, s.src AS source, i.category,"
    f" i.risk AS risk_level, i.purpose FROM (SELECT page_id, a_src AS src, {host('a_src')} AS domain"
    " FROM ev WHERE NOT ns AND tag = 'script' AND a_src <> '') s JOIN intel i ON s.domain = i.domain",
    "enh": "SELECT * FROM hosts UNION ALL SELECT * FROM finger",
    "escore": "SELECT w.page_id, w.url, CAST(count(e.page_id) AS BIGINT) AS trackers,"
    " CAST(greatest(0, 100 - coalesce(sum(CASE risk_level WHEN 'high' THEN 15 WHEN 'medium' THEN 8"
    " WHEN 'low' THEN 3 ELSE 0 END + CASE WHEN category IN ('advertising', 'social_advertising')"
    " THEN 10 WHEN category = 'privacy_invasion' THEN 20 ELSE 0 END), 0)) AS BIGINT) AS score,"
    " CASE WHEN count(*) FILTER (risk_level = 'high') > 3"
    " OR coalesce(bool_or(category = 'privacy_invasion'), false) THEN 'high'"
    " WHEN count(*) FILTER (risk_level = 'high') > 0 OR count(*) FILTER (risk_level = 'medium') > 5"
    " THEN 'medium' ELSE 'low' END AS overall_risk"
    " FROM web w LEFT JOIN enh e ON w.page_id = e.page_id GROUP BY w.page_id, w.url",
    "req": "SELECT page_id, url, 'document' AS resource_type FROM web WHERE url <> ''"
    " UNION ALL SELECT page_id, a_src, tag FROM ev WHERE NOT ns AND a_src <> ''",
    # Scan history from the event table.
    "hist": "SELECT 'https://site-' || user_id || '.example/' AS url, ts AS scan_ts,"
    " CAST(json_extract_string(props, '$.k') AS BIGINT) AS tracker_count,"
    " CAST(greatest(0, 100 - CAST(floor(value) AS BIGINT)) AS BIGINT) AS privacy_score,"
    " event_id, event_type FROM events",
}

# What each part reads, found by its names once and kept in definition order.
ORDER = [
    "dom", "pat", "fam", "cdom", "intel", "cat", "cpat", "chost", "vm", "web", "toks", "els",
    "nsblocks", "nsels", "every", "rawattrs", "bare", "refs", "pieces", "numbers", "points",
    "words", "known", "joined", "attrs", "wide", "ev", "px", "b64", "ext", "inl",
    "meta", "css", "bag", "risky", "counts", "res", "scored", "pd", "pcat", "hit", "det", "seen",
    "finger", "hosts", "enh", "escore", "req", "hist",
]
NEEDS = {
    "toks": ["web"], "els": ["toks"], "nsblocks": ["web"], "nsels": ["nsblocks"],
    "every": ["els", "nsels"], "rawattrs": ["every"], "bare": ["rawattrs"],
    "pieces": ["bare"], "numbers": ["pieces"], "points": ["numbers"], "words": ["pieces"],
    "known": ["words", "refs"], "joined": ["pieces", "points", "known"], "attrs": ["bare", "joined"], "wide": ["attrs"],
    "ev": ["every", "wide"], "px": ["ev", "dom"], "b64": ["ev"], "ext": ["ev", "dom"],
    "inl": ["ev", "pat"], "meta": ["ev", "vm"], "css": ["ev", "dom"], "bag": ["px", "ext", "css"],
    "risky": ["bag", "cdom"], "counts": ["web", "px", "b64", "ext", "inl", "meta", "css", "risky"],
    "res": ["web", "counts"], "scored": ["res"], "pd": ["bag"], "pcat": ["risky"],
    "hit": ["web", "cpat", "chost"], "det": ["hit"], "seen": ["cat", "det"], "finger": ["web"],
    "hosts": ["ev", "intel"], "enh": ["hosts", "finger"], "escore": ["web", "enh"],
    "req": ["web", "ev"],
}


def with_parts(select: str, *parts: str) -> str:
    """The select with every named part, and what those read, as common table expressions."""
    wanted, queue = set(), list(parts)
    while queue:
        part = queue.pop()
        if part not in wanted:
            wanted.add(part)
            queue += NEEDS.get(part, [])
    ctes = ", ".join(f"{p} AS ({CTES[p]})" for p in ORDER if p in wanted)
    return f"WITH {ctes} {select}"
