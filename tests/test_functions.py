"""Golden values of the scalar rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sightline import functions as X

DOMAINS = {
    "": "", "   ": "", "....": "", "://": "", "https://": "", "//": "", "@": "", "http://@": "", "user@": "",
    ":8080": "", "///": "", None: "",
    "example.com": "example.com", "HTTPS://EXAMPLE.COM": "example.com", "ftp://example.com/x": "example.com",
    "//example.com/path": "example.com", "user:pass@example.com": "example.com",
    "mailto:foo@example.com": "example.com", "a@b@example.com": "example.com",
    "https://medium.com/@ravityuval/how-i-cut-costs": "medium.com",
    "https://example.com/?email=a@b.com": "example.com", "https://example.com/path#frag@thing": "example.com",
    "example.com?a=/b#c": "example.com", "https://user@host.com:8080/x": "host.com",
    "example.com.": "example.com", ".example.com": "example.com", "example.com:443": "example.com",
    "www.www.www.example.com": "example.com", "www.com": "com", "www.": "www", "www.www.": "www",
    "wwwx.com": "wwwx.com", "xwww.example.com": "example.com", "localhost": "localhost",
    "w.x.y.z.example.com": "example.com", "shop.example.co.uk": "example.co.uk", "x.com.au": "x.com.au",
    "news.site.govt.nz": "site.govt.nz", "a.b.c.example.com.br": "example.com.br", "co.uk": "co.uk",
    "a.b.example.gov.fr": "gov.fr", "shop.example.com.pl": "com.pl",
    "   https://www.example.com/x   ": "example.com", "https://shop.café.com/path": "café.com",
    "://x": "x", "a://b": "b", "http://a://b": "a", "example.com.:8080": "com.", "example.co.uk.:443": "uk.",
    "[::1]:8080": "[", "12.5": "12.5",
}


def test_normalize_domain(column):
    got = column([(u,) for u in DOMAINS], "u STRING", X.normalize_domain(F.col("u")))
    assert dict(zip(DOMAINS, got)) == DOMAINS


def test_normalize_and_split_target(column):
    urls = {
        " https://GitHub.com:443//User//Repo/?q#f": "github.com/user/repo", "example.com?x=/y": "example.com",
        "http://@/x": "", "forum.ixbt.com/": "ixbt.com", "//a.b.com/C": "b.com/c",
    }
    got = column([(u,) for u in urls], "u STRING", X.normalize_target(F.col("u")))
    assert dict(zip(urls, got)) == urls
    split = column([("a.com/b/c",), ("a.com",)], "u STRING", X.split_target(F.col("u")))
    assert [(s["domain"], s["segments"]) for s in split] == [("a.com", ["b", "c"]), ("a.com", [])]


def test_matches_target(column):
    cases = [
        ("github.com/user/repo/blob/main/x", "github.com/user/repo", True),
        ("github.com/user-fake/repo", "github.com/user/repo", False),
        ("github.com/user", "github.com/user/repo", False),
        ("http://www.github.com/USER/Repo?x=1", "https://GitHub.com//user/", True),
        ("forum.ixbt.com/a", "ixbt.com", True), ("", "a.com", False), ("a.com", "", False),
        ("a.com?b=/x", "a.com/x", False),
    ]
    got = column([c[:2] for c in cases], "u STRING, t STRING", X.matches_target(F.col("u"), F.col("t")))
    assert got == [c[2] for c in cases]


LINKS = "links ARRAY<STRUCT<rank: INT, url: STRING, domain: STRING>>, t STRING"
WRAPPED = (3, "https://www.google.com/url?q=https%3A%2F%2Fa.com%2Fx", "a.com")


def test_target_ranks(column):
    links = [(4, "https://www.a.com/X/1", "a.com"), WRAPPED, (2, "", "www.A.com"), (1, "https://b.com", "b.com")]
    got = column(
        [(links, "a.com"), (links, "a.com/x"), (links, "c.com"), (links, ""), ([], "a.com")], LINKS,
        X.target_ranks(F.col("links"), F.col("t")),
    )
    assert got == [[2, 3, 4], [4], [], [], []]


def test_domain_best_ranks(column):
    links = [(4, "u", "casper.com"), (2, "u", "www.casper.com"), (1, "https://x.acme.com/", ""), (5, "", "")]
    got = column([(links, ""), ([], "")], LINKS, X.domain_best_ranks(F.col("links")))
    assert [[(p["domain"], p["rank"]) for p in row] for row in got] == [[("acme.com", 1), ("casper.com", 2)], []]


def test_decode(column):
    ranks = ['[1, 2, "x", 3.0]', "oops", None, '{"a": 1}', "[]"]
    assert column([(r,) for r in ranks], "j STRING", X.decode_ranks(F.col("j"))) == [[1, 2, 3], [], [], [], []]
    text = '[{"rank": 1, "url": "https://x.com/a"}, {"rank": "z", "domain": "y.com"}, 5, {"rank": "2", "domain": "www.y.com"}, {"rank": 3}]'
    got = column([(text,), ("{",)], "j STRING", X.decode_links(F.col("j")))
    assert [[(x["rank"], x["domain"]) for x in row] for row in got] == [[(1, "x.com"), (2, "y.com")], []]


def test_unwrap_redirects(column):
    cases = {
        "/url?sa=t&q=https%3A%2F%2Fa.com%2Fx&z=1": "https://a.com/x",
        "https://www.google.com/url?url=https%3A%2F%2Fb.com": "https://b.com",
        "https://yandex.ru/clck/jsredir?from=a&url=https%3A%2F%2Fc.com": "https://c.com",
        "/url?x=1": "/url?x=1", "https://d.com/?q=https%3A%2F%2Fa.com": "https://d.com/?q=https%3A%2F%2Fa.com",
        "/url?q=%zz": "/url?q=%zz",
    }
    got = column([(u,) for u in cases], "u STRING", X.unwrap_redirects(F.col("u")))
    assert dict(zip(cases, got)) == cases


def test_questions(column):
    queries = {
        "  Best  tea for cold mornings? ": "best tea for cold mornings", "Does Tarvel ship abroad!!!": "does tarvel ship abroad",
        "": "", "Milk, Sugar.": "milk, sugar", None: "", "and then… ": "and then",
    }
    got = column([(q,) for q in queries], "q STRING", X.normalize_query(F.col("q")))
    assert dict(zip(queries, got)) == queries
    brands = [
        ("is tarvel or oolmar cheaper", "Tarvel", True), ("a tarvelling salesman", "Tarvel", False),
        ("how old is leaf and cup", "Leaf and Cup", True), ("leaf reviews", "Leaf and Cup", False),
        ("whatever", "", False), ("whatever", "   ", False), ("ВЕЛТА чай", "велта", True),
        ("велтаград карта", "Велта", False), ("где купить велта чай", "Велта Чай", True),
    ]
    got = column([b[:2] for b in brands], "q STRING, b STRING", X.contains_brand(F.col("q"), F.col("b")))
    assert got == [b[2] for b in brands]


def test_calendar(column):
    days = [(dt.datetime(2024, 12, 30),), (dt.datetime(2026, 9, 1),), (dt.datetime(2021, 1, 3, 23, 59),)]
    assert column(days, "t TIMESTAMP", X.iso_week(F.col("t"))) == ["2025-W01", "2026-W36", "2020-W53"]
    assert column(days, "t TIMESTAMP", X.iso_week_monday(F.col("t")))[2] == dt.date(2020, 12, 28)
    times = [("2026-01-01T00:00:00Z",), ("2026-01-01 12:00:00",), ("nonsense",), (None,), ("2025-12-30T23:59:59+00:00",)]
    fresh = X.is_fresh(F.col("t"), F.lit("2026-01-02 00:00:00"), 86_400)
    assert column(times, "t STRING", fresh) == [True, True, False, False, False]


def test_outcome_and_delta(column):
    rows = [
        (False, [1], [1], True, "no_answer"), (None, [], [], True, "no_answer"), (True, [1], [1], True, "cited"),
        (True, [1], [], True, "sources_only"), (True, [], [], True, "mention_only"), (True, None, None, None, "absent"),
    ]
    got = column(
        [r[:4] for r in rows], "o BOOLEAN, s ARRAY<INT>, c ARRAY<INT>, m BOOLEAN",
        X.outcome_of(F.col("o"), F.col("s"), F.col("c"), F.col("m")),
    )
    assert got == [r[4] for r in rows]
    moves = [(0.5, 0.4, "improved"), (0.4, 0.5, "worse"), (0.5, 0.498, "flat"), (None, 0.5, "no_data"), (0.5, None, "new"), (None, None, "none")]
    got = column([m[:2] for m in moves], "a DOUBLE, b DOUBLE", X.delta_direction(F.col("a"), F.col("b"), F.lit(True), F.lit(0.005)))
    assert got == [m[2] for m in moves]
