"""Scalar functions over derived links, pages and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import functions as X
from sightline.functions.links import is_ad_link

from .derived import Derived
from .oracle import nd, nq, nt, toks, under, with_ctes
from .present import present

CASES: dict = {}


def case(key, fn, sql, extra=None):
    CASES[key] = (fn, None if sql is None else with_ctes(sql, extra))


# URLs: those of pages, in several spellings, and those of links
def _urls(d: Derived):
    p = F.col("page_id")
    spelled = (
        F.when(p % 6 == 0, F.upper("url"))
        .when(p % 6 == 1, F.concat(F.lit("  "), F.regexp_replace("url", "^https?:", "")))
        .when(p % 6 == 2, F.regexp_replace("url", "://", "://user:pw@www.www."))
        .when(p % 6 == 3, F.regexp_replace("url", r"example\.(com|net|org)", "shop.co.uk:8080"))
        .when(p % 6 == 4, F.concat("url", F.lit("//X//y/?q=a@b://c#z")))
        .otherwise(F.col("url"))
    )
    return d.given("pages").select(p.alias("page_id"), spelled.alias("url"))


_URLS = {
    "urls": r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN upper(url) WHEN 1 THEN '  ' || regexp_replace(url, '^https?:', '')
        WHEN 2 THEN regexp_replace(url, '://', '://user:pw@www.www.')
        WHEN 3 THEN regexp_replace(url, 'example\.(com|net|org)', 'shop.co.uk:8080')
        WHEN 4 THEN url || '//X//y/?q=a@b://c#z' ELSE url END AS url FROM pages""",
    "normal": f"SELECT page_id, url, {nd('url')} AS domain, {nt('url')} AS target FROM (SELECT * FROM urls)",
}
case("normalize_domain", lambda d: present(_urls(d).select("page_id", X.normalize_domain(F.col("url")).alias("domain"))),
     "SELECT page_id, domain FROM normal", _URLS)
case("normalize_target", lambda d: present(_urls(d).select("page_id", X.normalize_target(F.col("url")).alias("target"))),
     "SELECT page_id, target FROM normal", _URLS)
case("split_target",
     lambda d: present(_urls(d).select("page_id", X.split_target(X.normalize_target(F.col("url"))).alias("s")).select("page_id", "s.domain", "s.segments")),
     "SELECT page_id, split_part(target, '/', 1) AS domain, array_to_string(string_split(target, '/')[2:], ',') AS segments FROM normal", _URLS)
_TARGETS = ("example.com", "https://EXAMPLE.net/en", "example.org/de/7", "shop.co.uk/fr", "")
case("matches_target",
     lambda d: present(_urls(d).select("page_id", *[X.matches_target(F.col("url"), F.lit(t)).alias(f"m{i}") for i, t in enumerate(_TARGETS)])),
     "SELECT page_id, " + ", ".join(
         f"{under('target', repr(t))} AS m{i}"
         for i, t in enumerate(("example.com", "example.net/en", "example.org/de/7", "shop.co.uk/fr", ""))) + " FROM normal", _URLS)


def _links(d: Derived):
    c = d.captures
    return c.select("id", F.inline("sources")), c


case("effective_link",
     lambda d: present(_links(d)[0].select("id", "rank", X.effective_link(F.col("url"), F.col("domain")).alias("link"))),
     "SELECT c.id, rank, CASE WHEN l.url LIKE 'https://www.google%' THEN l.domain ELSE l.url END AS link FROM cap c JOIN links l ON l.id = c.id WHERE channel = 'sources'")
case("target_ranks", lambda d: present(d.captures, "id", "target_source_ranks", "target_citation_ranks"),
     "SELECT id, array_to_string(s_ranks, ',') AS target_source_ranks, array_to_string(c_ranks, ',') AS target_citation_ranks FROM cap")
case("best_rank", lambda d: present(d.captures.select("id", X.best_rank(F.col("target_source_ranks")).alias("best"))),
     "SELECT id, list_min(s_ranks) AS best FROM cap")
case("domain_best_ranks",
     lambda d: present(d.captures.select("id", F.inline(X.domain_best_ranks(F.col("sources"))))),
     "SELECT c.id, l.domain, min(rank) AS rank FROM cap c JOIN links l ON l.id = c.id WHERE channel = 'sources' GROUP BY ALL")


def _link_json(d: Derived):
    """Sources as JSON text, with broken texts and items that are no links."""
    i = F.col("id")
    body = F.to_json(
        F.transform("sources", lambda x: F.struct(
            F.when(i % 5 == 0, F.concat(x["rank"].cast("string"), F.lit("x"))).otherwise(x["rank"].cast("string")).alias("rank"),
            x["url"].alias("url"), F.when(i % 3 == 0, F.lit("")).otherwise(F.upper(x["domain"])).alias("domain"))))
    text = F.when(i % 7 == 0, F.lit("{")).when(i % 11 == 0, F.lit('{"a":1}')).otherwise(body)
    return d.captures.select("id", text.alias("json"))


case("decode_links", lambda d: present(_link_json(d).select("id", F.inline(X.decode_links(F.col("json")))), "id", "rank", "domain"),
     """SELECT c.id, rank, CASE WHEN c.id % 3 = 0 AND l.url LIKE 'https://www.google%' THEN 'google.com' ELSE l.domain END AS domain
     FROM cap c JOIN links l ON l.id = c.id WHERE channel = 'sources' AND c.id % 7 <> 0 AND c.id % 11 <> 0 AND c.id % 5 <> 0""")
case("decode_ranks",
     lambda d: present(d.captures.select("id", X.decode_ranks(
         F.when(F.col("id") % 7 == 0, F.lit("oops")).otherwise(F.to_json("target_source_ranks"))).alias("ranks"))),
     "SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE array_to_string(s_ranks, ',') END AS ranks FROM cap")
case("unwrap_redirects",
     lambda d: present(d.link_rows.select("capture_id", "channel", "position", X.unwrap_redirects(F.col("url")).alias("url"))),
     r"""SELECT a.id AS capture_id, channel, rank AS position, CASE WHEN (rank + shift) % 5 = 3 THEN 'https://yabs.yandex.ru/count/' || domain
     ELSE 'https://www.' || domain || '/' || path END AS url
     FROM (SELECT *, CASE channel WHEN 'sources' THEN 0 ELSE 2 END AS shift, regexp_extract(url, '/([pq])/', 1) AS path FROM links) l
     JOIN answers a ON a.id = l.id""")
case("drop_ad_links",
     lambda d: present(d.link_rows.where(~is_ad_link(F.col("url"))).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))),
     """SELECT channel, count(*) AS n FROM (SELECT *, CASE channel WHEN 'sources' THEN 0 ELSE 2 END AS shift FROM links) l
     JOIN answers a ON a.id = l.id WHERE (rank + shift) % 5 <> 3 GROUP BY channel""")
case("normalize_query", lambda d: present(d.candidates.select("index", X.normalize_query(F.col("query")).alias("q"))),
     f"SELECT index, {nq('query')} AS q FROM cand")
case("contains_brand",
     lambda d: present(d.candidates.select(
         "index", X.contains_brand(F.col("query"), F.lit("acme  App")).alias("two"), X.contains_brand(F.col("query"), F.lit("DE")).alias("one"),
         X.contains_brand(F.col("query"), F.lit(" ")).alias("none"))),
     f"SELECT index, list_has_all({toks(nq('query'))}, ['acme', 'app']) AS two, list_contains({toks(nq('query'))}, 'de') AS one, FALSE AS none FROM cand")
case("normalize_brand_name",
     lambda d: present(d.given("customer").select(
         "c_custkey", X.normalize_brand_name(F.concat(F.lit(" \t"), F.regexp_replace("c_name", "#", " \n # "))).alias("name"))),
     "SELECT c_custkey, replace(c_name, '#', ' # ') AS name FROM customer")
case("iso_week",
     lambda d: present(d.given("orders").select("o_orderkey", X.iso_week(F.col("o_orderdate").cast("timestamp")).alias("week"),
                                               X.iso_week_monday(F.col("o_orderdate").cast("timestamp")).alias("monday"))),
     "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders")
case("is_fresh",
     lambda d: present(d.audits.select("audit_id", X.is_fresh(F.col("checked_at"), F.lit("2026-01-15 10:00:00"), 86400 * 7).alias("fresh"))),
     "SELECT audit_id, TIMESTAMP '2026-01-15 10:00:00' - checked_at <= INTERVAL 7 DAY AS fresh FROM audits")
case("split_phrase_text",
     lambda d: present(d.captures.select("id", X.split_phrase_text(F.when(F.col("id") % 13 == 0, "  ").otherwise(F.col("sentiment"))).alias("phrase"))),
     "SELECT id, CASE WHEN id % 13 <> 0 THEN trim(sentiment) END AS phrase FROM cap")
