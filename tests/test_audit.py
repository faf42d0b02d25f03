"""Robots rules, page signals, checks and scores on literal files."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sightline.operators.audit import checks as K
from sightline.operators.audit import pages as P
from sightline.operators.audit import robots as R
from sightline.operators.audit import verdict as V
from sightline.schemas import CHECK, SITE_FETCH
from sightline.sources.dims import CRAWLERS


def policies(column, *bodies, status=200):
    got = column([(b, status) for b in bodies], "t STRING, s INT", R.robots_of(F.col("t"), F.col("s")))
    return [({p["ua"] for p in g["policies"] if not p["allowed"]}, g) for g in got]


EVERYONE = {c[0] for c in CRAWLERS}


def test_robots_policies(column):
    bodies = {
        "User-agent: *\nAllow: /": set(), "User-agent: *\nDisallow: /": EVERYONE,
        "User-agent: GPTBot\nDisallow: /": {"GPTBot"},
        "User-agent: GPTBot\nUser-agent: ClaudeBot\n\nDisallow: /": {"GPTBot", "ClaudeBot"},
        "User-agent: *\nDisallow: /\nUser-agent: googlebot\nAllow: /": EVERYONE - {"Googlebot"},
        "User-agent: *\r\nDisallow: /private": set(), "Disallow: /\nUser-agent: CCBot\nDisallow:": set(),
        "User-agent: Bingbot\nDisallow: /\nAllow: /": set(), "User-agent: Bingbot\nDisallow: /*\nAllow: /": {"Bingbot"},
        "User-agent: Bingbot # note\nDisallow: / # all": {"Bingbot"},
        "User-agent: Bingbot\nDisallow: /x\nUser-agent: Bingbot\nDisallow: /": {"Bingbot"},
        ">>> not robots \x00\x01 %%% random": set(), "\ufeffUser-agent: Bingbot\nDisallow: /": {"Bingbot"},
        "User-agent: Bingbot\nCrawl-delay: 1\nUser-agent: CCBot\nDisallow: /": {"Bingbot", "CCBot"},
        "User-agent: Googlebot-News\nDisallow: /": set(),
    }
    got = policies(column, *bodies)
    assert {b: g[0] for b, g in zip(bodies, got)} == bodies
    assert all(g[1]["present"] and not g[1]["malformed"] for g in got)
    assert [p["ua"] for p in got[0][1]["policies"]] == [c[0] for c in CRAWLERS]


@pytest.mark.parametrize("status, unreadable", [(429, True), (500, True), (503, True), (None, True), (200, False), (403, False), (404, False)])
def test_robots_unreadable(column, status, unreadable):
    blocked, state = policies(column, "User-agent: *\nDisallow: /" if status != 200 else "", status=status)[0]
    assert state["unreadable"] is unreadable and not state["present"] and blocked == set()


def test_robots_sitemaps(column):
    text = "User-agent: *\nSitemap: https://a.com/1.xml\nsitemap:   https://a.com/2.xml\n Sitemap: https://a.com/1.xml\nDisallow: /nope"
    assert column([(text,), (None,)], "t STRING", R.robots_sitemaps(F.col("t"))) == [["https://a.com/1.xml", "https://a.com/2.xml"], []]


def signals(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i INT, html STRING")
    return [r["signals"] for r in P.page_signals(df).orderBy("i").collect()]


HOME = (
    '<!doctype html><html lang="en"><head><title>A &amp; B</title><meta content="What we do" name=description>'
    "<link href='https://a.com/' rel='canonical'><meta property='og:title' content='x'>"
    '<meta name="ROBOTS" content="index"><LINK rel="feed alternate" type="application/atom+xml" href="/f">'
    '<script type="application/ld+json">{"@type":"Organization","logo":{"url":"l"},"sameAs":["a","b"],"datePublished":"2026"}</script>'
    "<!-- <h1>not here</h1> --></head><body><main><h1>One</h1><h2>Two</h2><p>" + "word " * 250
    + '</p><a href="/company"><b>About Us</b></a><a class="x" href="/Contact">c</a></main></body></html>'
)


def test_rich_page(spark):
    s = signals(spark, HOME)[0]
    assert s["raw_word_count"] == 250 + 2 + 3 and (s["heading_count"], s["h1_count"], s["heading_order_ok"]) == (2, 1, True)
    assert (s["title"], s["meta_description"], s["canonical"], s["lang"]) == ("A & B", "What we do", "https://a.com/", "en")
    assert s["has_main_or_article"] and s["og_present"] and s["has_feed"] and not s["noindex"] and not s["js_dependent"]
    assert s["jsonld_types"] == ["Organization"] and s["org_logo"] and s["org_sameas"] == 2 and s["has_dates"]
    assert s["has_about_link"] and s["has_contact_link"] and s["empty_root_markers"] == [] and s["framework"] is None


def test_blank_and_missing_pages(spark):
    blank, missing = signals(spark, "  \n ", None)
    assert missing is None
    assert blank["js_dependent"] and blank["raw_word_count"] == 0 and blank["title"] is None and blank["heading_order_ok"]
    assert blank["jsonld_types"] == [] and not blank["has_dates"] and blank["empty_root_markers"] == []


@pytest.mark.parametrize("body, found", [
    ('<main><p>Tea shop</p></main><script id="__NEXT_DATA__" type="text/plain">9</script>', "Next"),
    ('<section id="__nuxt"><p>Opening hours</p></section>', "Nuxt"),
    ('<p>Orders</p><script>/* React */ let shop = createRoot(document.body)</script>', "React"),
    ('<section ng-app="orders"><p>Orders</p></section>', "Angular"),
    ('<ul data-v-5e1c><li>green tea</li></ul>', "Vue"),
    ('<img class="gatsby-image" alt="a tea pot">', "Gatsby"),
    ('<astro-island>white tea</astro-island>', "Astro"),
    ('<h2>How people react to tea</h2>', None),
])
def test_framework(spark, body, found):
    assert signals(spark, f"<html><body><header>Leaf and Cup</header>{body}</body></html>")[0]["framework"] == found


def test_framework_is_looked_for_near_the_start(spark):
    late = "<html><body><p>" + "leaf " * 2_000 + "</p><astro-island>white tea</astro-island></body></html>"
    assert signals(spark, late)[0]["framework"] is None


def test_empty_roots(spark):
    menu = "".join(f"<div>tea number {i}, ten grams</div>" for i in range(9))
    filled, two, short, beside = signals(
        spark, f'<body><div id="root">{menu}</div></body>',
        '<body><div id="root">\n</div><div id="__next"><i>wait</i></div></body>',
        '<body><div id="root">tea</div><h1>Leaf and Cup</h1><ol>' + "<li>one more tea</li>" * 20 + "</ol></body>",
        f"<body><div class=shell id=app><div>.</div></div><footer>{menu}</footer></body>")
    assert filled["empty_root_markers"] == [] and two["empty_root_markers"] == ["div#root", "div#__next"]
    assert short["empty_root_markers"] == ["div#root"] and short["js_dependent"] and short["raw_word_count"] == 64
    assert beside["empty_root_markers"] == ["div#app"]


@pytest.mark.parametrize("html, h1, count, order", [
    ("<h1>a</h1><h2>b</h2><h3>c</h3>", 1, 3, True), ("<h1>a</h1><h3>b</h3>", 1, 2, False), ("<h1>a</h1><h1>b</h1>", 2, 2, True),
    ("<h2>a</h2>", 0, 1, True), ("<p>no headings</p>", 0, 0, True), ("<h3>a</h3><h1>b</h1>", 1, 2, True),
    ("<section><h1>a</h1><h2>b</h2></section><h4>c</h4>", 1, 3, False),
])
def test_headings(spark, html, h1, count, order):
    s = signals(spark, html)[0]
    assert (s["h1_count"], s["heading_count"], s["heading_order_ok"]) == (h1, count, order)
    assert s["heading_levels"] == [int(level) for level in re.findall("<h([1-6])", html)]


def ld(*blocks):
    return "<html><body>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</body></html>"


def test_jsonld(spark):
    mixed, two, bare, graph, kinds, text, deep = signals(
        spark,
        ld("{ broken", '{"@graph":[{"name":"n"},{"@type":"WebSite"},{"@type":["Article","BlogPosting"],"dateModified":"2026"}]}',
           '{"@type":"Organization","sameAs":"https://x.example/only"}'),
        ld('[{"@type":"Organization","logo":"a.png","sameAs":["x"]},{"@type":"Organization","sameAs":["y","z"]}]'),
        ld('{"@type":"Organization","logo":""}'), ld('{"@graph":{"@type":"Organization","logo":"g","sameAs":["a"]}}'),
        ld('{"@type":["Thing", 42]}'), ld('"justastring"', ""), ld('[{"@graph":[{"@type":"A","@graph":[{"@type":"B"}]},{"@type":"C"}]}]'))
    assert (mixed["jsonld_blocks"], mixed["jsonld_invalid"]) == (3, 1)
    assert mixed["jsonld_types"] == ["WebSite", "Article", "BlogPosting", "Organization"]
    assert mixed["has_organization"] and not mixed["org_logo"] and mixed["org_sameas"] == 1 and mixed["has_dates"]
    assert two["jsonld_types"] == ["Organization"] and two["org_logo"] and two["org_sameas"] == 1
    assert bare["has_organization"] and not bare["org_logo"] and bare["org_sameas"] == 0
    assert graph["org_logo"] and graph["org_sameas"] == 1
    assert kinds["jsonld_types"] == ["Thing"] and (text["jsonld_blocks"], text["jsonld_invalid"]) == (2, 1)
    assert deep["jsonld_types"] == ["A", "B", "C"]


def test_jsonld_depth_does_not_matter(spark):
    pages = []
    for depth in (1, 3, 11, 40, 200):
        block = r'{"@type":"Organization","logo":"x}]","sameAs":["a\"]["]}'
        for i in range(depth):
            block = f"[{block}]" if i % 2 else f'{{"@graph":[{{"@type":"First"}},{block},{{"@type":"Last"}}]}}'
        pages.append(ld(block))
    for s in signals(spark, *pages):
        assert s["jsonld_types"] == ["First", "Organization", "Last"]
        assert s["org_logo"] and s["org_sameas"] == 1


def test_small_signals(spark):
    pages = {
        '<meta name="robots" content="NOINDEX"><p>x</p>': ("noindex", True), '<meta name="robots" content="index, follow">': ("noindex", False),
        "<noscript>Please enable JavaScript to continue here</noscript>": ("has_noscript", True), "<noscript>hi</noscript>": ("has_noscript", False),
        '<time datetime="2026-02-02">Feb</time>': ("has_dates", True), "<time>Feb</time>": ("has_dates", False),
        "<a href=/x>contact us</a>": ("has_contact_link", True), "<a href=/x>contacts</a>": ("has_contact_link", False),
        "<script>var x='<article>'</script>": ("has_main_or_article", False), "<p>a&nbsp;b c</p><style>x y</style>": ("raw_word_count", 3),
    }
    for (html, (name, value)), s in zip(pages.items(), signals(spark, *pages)):
        assert s[name] == value, html


def test_character_references(column):
    texts = {"A&eacute;B &mdash; C": "A\u00e9B \u2014 C", "&amp;lt;": "&lt;", "&#39;x&#x1F600;": "'x\U0001f600", "&#0;": "\ufffd",
             "a & b &nope; &amp": "a & b &nope; &amp", "": "", None: None}
    assert dict(zip(texts, column([(t,) for t in texts], "t STRING", P.unescape(F.col("t"))))) == texts


def test_sitemap_and_llms(column):
    maps = {"<a><b/></a>": True, '<?xml version="1.0"?>\n<a x="1"><!-- c --></a>\n': True, "<a/>": True, "<a><b></a>": False, "<a></a>junk": False,
            "": False, None: False, "plain": False, "<a>&nbsp;</a>": False, "<a></b>": False,
            "<a></a><a></a>": False, "<a/><b/>": False, "<a x='>'>" + "<u/>" * 9000 + "</a>": True, "<a><![CDATA[<b>]]></a>": True,
            "<a/>" + "<!-- c -->" * 20_000: True, "<!-- c -->" * 20_000 + "<a/>": True}
    assert dict(zip(maps, column([(m,) for m in maps], "t STRING", P.sitemap_wellformed(F.col("t"))))) == maps
    texts = {"# Brand\n": True, "x\n  ## y": True, "no heading": False, "": False, None: False, "a # b": False}
    assert dict(zip(texts, column([(t,) for t in texts], "t STRING", P.llms_has_h1(F.col("t"))))) == texts


AT = dt.datetime(2026, 1, 1)


def site(target="acme.com", **kinds):
    full = {
        "homepage": (200, HOME), "homepage_http": (200, ""), "robots": (200, "User-agent: *\nAllow: /\nSitemap: https://a/s.xml"),
        "sitemap": (200, "<urlset></urlset>"), "llms": (200, "# A"), "security": (200, "Contact: x"), **kinds,
    }
    return [
        (target, "acme.com", k, f"https://acme.com/{k}", None, v[0], v[1], v[2] if len(v) > 2 else 0, v[3] if len(v) > 3 else "https",
         None if v[0] else "boom", {}, AT)
        for k, v in full.items() if v
    ]


def audit(spark, rows, engine="google"):
    return K.audit_sites(spark.createDataFrame(rows, SITE_FETCH), [engine]).collect()[0]


def statuses(row):
    return {c["id"]: c["status"] for c in row["checks"]}


def test_healthy_site_is_ready(spark):
    row = audit(spark, site())
    assert set(statuses(row).values()) == {"pass"} and (row["verdict"], row["score"], row["blockers"]) == ("ready", 100, [])
    assert [c["id"] for c in row["checks"]] == list(K.ALL_CHECKS)


def test_unreachable_site(spark):
    row = audit(spark, site(homepage=(None, None), robots=(503, "")))
    got = statuses(row)
    assert got["A1"] == "fail" and got["A2"] == got["A3"] == got["A5"] == got["B1"] == "skip" and got["A3b"] == "warn"
    assert row["verdict"] == "blocked" and row["blockers"] == ["A1"]
    assert row["checks"][0]["detail"] == "https://acme.com/homepage unreachable: boom."


def test_check_branches(spark):
    blocked = "User-agent: OAI-SearchBot\nDisallow: /\nUser-agent: GPTBot\nDisallow: /"
    rows = site(homepage_http=(200, "", 0, "http"), robots=(200, blocked), llms=(200, "plain"), sitemap=(200, "<a>"), security=None,
                homepage=(200, '<html><body><div id="root"></div></body></html>', 3))
    row = audit(spark, rows, "chatgpt_search")
    got = statuses(row)
    assert {k: got[k] for k in ("A1", "A2", "A3", "A3b", "A4", "A5", "B1", "B2", "B3", "B4", "C1", "C2", "D1", "D2", "D3")} == {
        "A1": "warn", "A2": "warn", "A3": "fail", "A3b": "pass", "A4": "warn", "A5": "fail", "B1": "fail", "B2": "fail", "B3": "warn",
        "B4": "warn", "C1": "fail", "C2": "fail", "D1": "fail", "D2": "fail", "D3": "fail"}
    details = {c["id"]: c["detail"] for c in row["checks"]}
    assert details["A3"] == "robots.txt disallows OAI-SearchBot (the search bot for chatgpt_search) from '/'."
    assert details["A3b"] == "No other search bots blocked. Training bots blocked (a policy choice, not a citation block): GPTBot."
    assert details["A5"].startswith("Primary content is JS-rendered: an SPA shell with 0 words")
    assert details["B3"] == "Missing meta: title, description, canonical."
    other = statuses(audit(spark, rows, "google"))
    assert other["A3"] == "pass" and other["A3b"] == "warn"
    assert statuses(audit(spark, rows, "deepseek"))["A3"] == "skip" and statuses(audit(spark, rows, None))["A3"] == "pass"


def test_target_page_decides_rendering(spark):
    shell = '<div id="root"></div>'
    good = audit(spark, site("acme.com/docs", homepage=(200, shell), target_page=(200, HOME)))
    assert statuses(good)["A5"] == "pass" and good["target"] == "acme.com/docs" and good["domain"] == "acme.com"
    gone = statuses(audit(spark, site("acme.com/docs", target_page=(404, ""))))
    assert gone["A2"] == "fail" and gone["A5"] == "pass"


def test_newest_response_counts(spark):
    old = [(*r[:-1], AT - dt.timedelta(days=1)) for r in site(homepage=(500, "x"))]
    assert statuses(audit(spark, old + site()))["A2"] == "pass"


def test_score_and_verdict(spark):
    def checks(*items):
        return [(i, "A", "t", sev, st, "d", None) for i, sev, st in items]

    rows = [
        (1, checks(("A1", "blocker", "pass"), ("A3", "blocker", "fail"), ("B1", "recommended", "warn"), ("B4", "nice_to_have", "fail"))),
        (2, []), (3, checks(("A1", "blocker", "skip"))), (4, checks(("B1", "recommended", "warn"))),
        (5, checks(("A1", "blocker", "pass"), ("A2", "blocker", "warn"), ("B1", "recommended", "fail"))),
    ]
    df = spark.createDataFrame(rows, f"audit_id INT, checks ARRAY<{CHECK}>")
    got = {r["audit_id"]: r for r in V.with_verdict(df).collect()}
    assert {i: (r["score"], r["verdict"]) for i, r in got.items()} == {
        1: (44, "blocked"), 2: (100, "ready"), 3: (100, "ready"), 4: (50, "ready_with_warnings"), 5: (56, "ready_with_warnings")}
    assert got[1]["blockers"] == ["A3"] and (got[1]["n_pass"], got[1]["n_fail"], got[1]["n_warn"], got[1]["n_skip"]) == (1, 2, 1, 0)
    ordered = df.where("audit_id = 1").select(V.audit_check_order(F.col("checks")).alias("c")).collect()[0]["c"]
    assert [c["id"] for c in ordered] == ["A3", "B4", "B1", "A1"]


def test_audit_of_one_engine_never_stands_in_for_another(spark):
    rows = [(1, "a.com", "google", AT, 10), (2, "a.com", "gemini", AT + dt.timedelta(days=1), 20), (3, "a.com", "google", AT, 30)]
    df = spark.createDataFrame(rows, "audit_id INT, domain STRING, engine STRING, checked_at TIMESTAMP, score INT")
    own = {r["engine"]: r["score"] for r in V.latest_audit(df).collect()}
    assert own == {"google": 30, "gemini": 20}
    assert [r["audit_id"] for r in V.latest_audit(df, strict_engine=False).collect()] == [2]
