"""The library's tables derived from the given ones, lazily and in whole.

The rules are stated once more in SQL in ``oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import target_ranks
from sightline.operators.captures import dedupe_captures
from sightline.operators.leaderboard import domain_leaderboard
from sightline.operators.metrics import run_metrics
from sightline.schemas import LINKS
from sightline.session import tuned

ENGINES = (
    "google", "chatgpt_search", "claude_search", "gemini", "yandex_neuro", "perplexity", "deepseek",
)

ROBOTS = (
    "User-agent: *\nAllow: /\nSitemap: https://x.example/sitemap.xml\n",
    "User-agent: *\nDisallow: /\n",
    "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\n",
    "# none but one\nUser-agent: *\nDisallow: /\n\nUser-agent: googlebot\nAllow: /\nsitemap: https://x.example/a.xml\n",
    "User-agent: OAI-SearchBot\nDisallow: /\nAllow: /\n\nUser-agent: PerplexityBot\nDisallow: /*\n",
    "",
)
SITEMAPS = ("<urlset><url><loc>https://x.example/</loc></url></urlset>", "<urlset><url></urlset>")
LLMS = ("# Brand\n> what it is", "no heading here")
ORG = (
    '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization",'
    '"logo":"l.png","sameAs":["https://s.example/a"]}</script>'
)
GRAPH = (
    '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Recipe","name":"soup"},'
    '{"@type":["Article","Course"],"startDate":"2019-05-02","dateModified":"2019-04-30"}]}</script>'
)
BROKEN = '<script type="application/ld+json">{ broken</script>'
META = (
    '<meta name="description" content="about us"><link rel="canonical" href="https://x.example/">'
    '<meta property="og:title" content="x"><link rel="alternate" type="application/rss+xml" href="/feed">'
)
SHELL = (
    '<html><head><meta charset="utf-8"><link rel="preload" as="fetch" href="/_next/static/home.json"></head>'
    '<body class="shop"><header></header><div id="root"></div><footer></footer></body></html>'
)
THIN = "<html><body><h1>Short</h1><h3>deep</h3><p>few words</p></body></html>"


def pick(values: tuple, index: Column) -> Column:
    """Value of a short fixed list by index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Derived:
    """Derived tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tuned(spark), sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- dimensions -------------------------------------------------------------------------------

    @cached_property
    def brands(self) -> DataFrame:
        k = F.col("r_regionkey").cast("bigint")
        path = F.when(k == 3, "/p").otherwise("")
        return self.given("region").select(
            k.alias("brand_id"),
            F.col("r_name").alias("name"),
            F.concat(F.lit("site"), (k * 7).cast("string"), F.lit(".com"), path).alias("domain"),
            F.lit("2020-01-01").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def answers_all(self) -> DataFrame:
        """One answer per order, before runs that lost theirs are left out and repeats are dropped."""
        oid = F.col("o_orderkey")
        year, month = F.year("o_orderdate"), F.month("o_orderdate")
        rows = self.given("orders").join(
            self.given("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        )
        brand = (F.col("c_nationkey") % 5).cast("bigint")
        first = F.substring("o_orderpriority", 1, 1)
        return rows.select(
            oid.alias("id"),
            brand.alias("brand_id"),
            pick(ENGINES, oid % 7).alias("engine"),
            year.alias("yr"),
            month.alias("mo"),
            ((((year * 12 + month - 1) * 7 + oid % 7) * 5) + brand).cast("bigint").alias("run_id"),
            F.concat(F.lit("q"), (oid % 50).cast("string")).alias("query"),
            F.when(first.isin("1", "2"), "branded").when(first == "3", "comparative").otherwise("general").alias(
                "lens"
            ),
            F.col("o_orderdate").cast("timestamp").alias("captured_at"),
            (F.col("o_orderstatus") != "P").alias("overview_present"),
            (oid * 7 % 10 < 4).alias("brand_in_answer_text"),
            F.when(oid % 5 != 3, F.concat(F.lit(" phrase "), (oid % 9).cast("string"), F.lit(" "))).alias("sentiment"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        quarter = F.floor((F.col("mo") - 1) / 3).cast("int")
        start = F.make_date(F.col("yr"), quarter * 3 + 1, F.lit(1))
        run_at = F.date_add(start, ((F.col("mo") - 1) % 3 * 2).cast("int")).cast("timestamp")
        tag = F.concat(F.lit("g"), F.col("yr").cast("string"), F.lit("q"), (quarter + 1).cast("string"))
        status = F.when(run_at >= F.lit("2001-07-01").cast("timestamp"), "running").when(
            F.col("run_id") % 23 == 0, "failed"
        ).otherwise("done")
        grouped = self.answers_all.groupBy("run_id", "brand_id", "engine", "yr", "mo").agg(
            F.count(F.lit(1)).cast("int").alias("n_ok")
        )
        return grouped.select(
            "run_id", "brand_id", "engine", run_at.alias("run_at"), status.alias("status"),
            F.lit(50).alias("n_queries"), "n_ok", F.lit(None).cast("int").alias("n_failed"),
            F.when((F.col("yr") + F.col("brand_id")) % 2 == 0, tag).alias("group_id"),
        )

    # --- links and captures -----------------------------------------------------------------------

    @cached_property
    def line_arrays(self) -> DataFrame:
        """Links of each order in display order; the order is over all columns, so ties are equal rows."""
        fields = (
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate",
        )
        lines = self.given("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("lines")
        )

        def link(x: Column, i: Column) -> Column:
            domain = F.concat(F.lit("site"), (x["l_suppkey"] % 40).cast("string"), F.lit(".com"))
            part = x["l_partkey"]
            direct = F.concat(
                F.lit("https://www."), domain, F.when(part % 2 == 0, "/p/").otherwise("/q/"), part.cast("string")
            )
            wrapped = F.concat(F.lit("https://www.google.com/url?q=https%3A%2F%2F"), domain)
            return F.struct(
                (i + 1).cast("int").alias("rank"),
                F.when(part % 9 == 0, wrapped).otherwise(direct).alias("url"),
                domain.alias("domain"),
            )

        returned = F.filter("lines", lambda x: x["l_returnflag"] == "R")
        return lines.select(
            "id", F.transform("lines", link).alias("sources"), F.transform(returned, link).alias("citations")
        )

    @cached_property
    def answers(self) -> DataFrame:
        return self.answers_all.where(F.col("run_id") % 37 != 0).drop("yr", "mo")

    def with_links(self, answers: DataFrame) -> DataFrame:
        """Answers with links and target ranks: one join on the order key."""
        none = F.array().cast(LINKS)
        targets = self.brands.select("brand_id", F.col("domain").alias("target"))
        rows = answers.join(self.line_arrays, "id", "left").join(targets, "brand_id")
        return rows.withColumns(
            {c: F.coalesce(F.col(c), none) for c in ("sources", "citations")}
        ).select(
            "id", "run_id", "query", "lens", "engine", "brand_id", "captured_at",
            F.when(F.col("id") % 4 != 0, F.concat(F.lit("answer "), F.col("id").cast("string"))).alias(
                "answer_text_md"
            ),
            F.lit(None).cast("string").alias("screenshot_path"),
            "overview_present", "sources", "citations",
            target_ranks(F.col("sources"), F.col("target"), canonical=True).alias("target_source_ranks"),
            target_ranks(F.col("citations"), F.col("target"), canonical=True).alias("target_citation_ranks"),
            "brand_in_answer_text", "sentiment",
        )

    @cached_property
    def captures_raw(self) -> DataFrame:
        return self.with_links(self.answers)

    @cached_property
    def captures(self) -> DataFrame:
        """Stored captures: repeats of (run, query, lens) are dropped while the rows are still narrow."""
        return self.with_links(dedupe_captures(self.answers))

    @cached_property
    def link_rows(self) -> DataFrame:
        """Landed links before assembly: wrapped in four ways, some of them paid."""
        def landed(channel: str, shift: int) -> Column:
            def row(x: Column) -> Column:
                kind = (x["rank"] + shift) % 5
                path = F.regexp_extract(x["url"], r"/([pq])/", 1)
                plain = F.concat(F.lit("https://www."), x["domain"], F.lit("/"), path)
                coded = F.concat(F.lit("https%3A%2F%2Fwww."), x["domain"], F.lit("%2F"), path)
                url = (
                    F.when(kind == 0, F.concat(F.lit("/url?sa=t&q="), coded, F.lit("&z=1")))
                    .when(kind == 1, F.concat(F.lit("https://www.google.com/url?url="), coded))
                    .when(kind == 2, F.concat(F.lit("https://yandex.ru/clck/jsredir?from=a&url="), coded))
                    .when(kind == 3, F.concat(F.lit("https://yabs.yandex.ru/count/"), x["domain"]))
                    .otherwise(plain)
                )
                return F.struct(F.lit(channel).alias("channel"), x["rank"].alias("position"), url.alias("url"))

            return F.transform(F.col(channel), row)

        rows = self.answers.select("id").join(self.line_arrays, "id")
        return rows.select(
            F.col("id").alias("capture_id"),
            F.inline(F.concat(landed("sources", 0), landed("citations", 2))),
        )

    # --- stored results ---------------------------------------------------------------------------

    @cached_property
    def metrics(self) -> DataFrame:
        """Metric rows; runs of 1995 are from before mentions were counted."""
        old = (F.floor(F.col("run_id") / 420) == 1995)
        fresh = run_metrics(self.captures, self.runs)
        return fresh.withColumns(
            {c: F.when(~old, F.col(c)) for c in ("n_brand_mentions", "brand_mention_rate")}
        )

    @cached_property
    def stats(self) -> DataFrame:
        return domain_leaderboard(self.captures, self.runs, self.brands)

    @cached_property
    def sentiment(self) -> DataFrame:
        """Summaries of some (run, lens); some are stored as NULL."""
        scopes = self.answers.select("run_id", "lens").distinct()
        text = F.concat(F.lit("summary "), F.col("run_id").cast("string"), F.lit(" "), F.col("lens"))
        return scopes.where(F.col("run_id") % 3 != 0).select(
            "run_id", "lens", F.when(F.col("run_id") % 3 == 1, text).alias("summary"),
            F.lit("2002-01-01").cast("timestamp").alias("computed_at"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """Question set of each brand: what was ever asked of it, less every seventh question."""
        asked = self.answers.select("brand_id", "query", "lens").distinct()
        return asked.where(F.substring("query", 2, 9).cast("int") % 7 != 0)

    # --- questions --------------------------------------------------------------------------------

    @cached_property
    def asked(self) -> DataFrame:
        """Questions out of user turns and benchmark passages: (index, query)."""
        turns = self.given("conversations").where(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.col("text").alias("query")
        )
        passages = self.given("benchmark").select(
            (F.col("item_id") + 1_000_000_000).alias("index"), F.col("text").alias("query")
        )
        return turns.unionByName(passages)

    @cached_property
    def candidates(self) -> DataFrame:
        """Typed question candidates with repeats, near repeats and missing fields."""
        i = F.col("index")
        lens = pick(("general", "branded", "comparative"), i % 3)
        query = F.concat("query", F.when(i % 2 == 0, " ?").otherwise(""))
        named = F.when((i % 3 == 1) & (i % 5 != 0), F.concat(query, F.lit(" Acme App"))).otherwise(query)
        rows = self.asked.select(
            i, named.alias("query"), F.when(i % 29 == 0, "promo").otherwise(lens).alias("lens"),
            F.concat(F.lit("s"), (i % 4).cast("string")).alias("segment"),
            F.when(i % 31 != 0, "forum").otherwise("  ").alias("signal"),
            F.when(i % 37 != 0, "https://f.example/t").alias("source_url"),
            F.lit(None).cast("string").alias("note"),
        )
        again = rows.where(i % 6 == 0).withColumns(
            {"index": i + 2_000_000_000, "query": F.lower(F.concat(F.lit("  "), F.col("query"), F.lit(" !")))}
        )
        return rows.unionByName(again)

    @cached_property
    def candidates_raw(self) -> DataFrame:
        body = F.to_json(F.struct("query", "lens", "segment", "signal", "source_url", "note"))
        return self.candidates.select("index", F.try_parse_json(body).alias("raw"))

    # --- raw captures -----------------------------------------------------------------------------

    @cached_property
    def capture_bodies(self) -> DataFrame:
        """Captures as JSON text with faults by id: (run_id, index, body, id)."""
        i = F.col("id")
        src, cit = F.col("sources"), F.col("citations")
        fold = F.struct(
            F.when(i % 41 != 0, F.col("query")).alias("query"),
            F.when(i % 43 == 0, "promo").otherwise(F.col("lens")).alias("lens"),
            "engine",
            F.when(i % 47 == 0, "soon").otherwise(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias(
                "captured_at"
            ),
            "answer_text_md",
            F.when(i % 4 == 1, F.when(F.col("overview_present"), "yes").otherwise("no"))
            .when(i % 53 == 0, "maybe")
            .otherwise(F.col("overview_present").cast("string"))
            .alias("overview_present"),
            F.transform(
                src,
                lambda x: F.struct(
                    F.when(i % 59 == 0, "0").when(i % 4 == 2, F.concat(x["rank"].cast("string"), F.lit(".0")))
                    .otherwise(x["rank"].cast("string")).alias("rank"),
                    x["url"].alias("url"), x["domain"].alias("domain"),
                ),
            ).alias("sources"),
            F.when(i % 61 == 0, F.array(F.struct(F.lit(1).alias("rank"), F.lit("u").alias("url"), F.lit("z.org").alias("domain"))))
            .otherwise(cit).alias("citations"),
            F.when(i % 67 == 0, F.array(F.lit(99))).otherwise(F.col("target_source_ranks")).alias("target_source_ranks"),
            "target_citation_ranks",
            "brand_in_answer_text",
            "sentiment",
        )
        return self.captures_raw.select("run_id", i.alias("index"), F.to_json(fold).alias("body"), "id")

    @cached_property
    def raw_objects(self) -> DataFrame:
        return self.capture_bodies.select("run_id", "index", F.try_parse_json("body").alias("raw"))

    # --- audits -----------------------------------------------------------------------------------

    @cached_property
    def audits(self) -> DataFrame:
        """Audit history: one row per page over forty sites and eight engines, one of them none."""
        p = F.col("page_id")
        score = (p * 13 % 101).cast("int")
        check = F.array(
            *[
                F.struct(
                    F.lit(cid).alias("id"), F.lit(cat).alias("category"), F.lit("t").alias("title"),
                    F.lit(sev).alias("severity"),
                    pick(("pass", "warn", "fail", "skip"), F.floor(p / div) % 4).alias("status"),
                    F.lit("d").alias("detail"), F.lit(None).cast("string").alias("remediation"),
                )
                for cid, cat, sev, div in (
                    ("A1", "A", "blocker", 1), ("A3", "A", "blocker", 4), ("B1", "B", "recommended", 16),
                    ("B4", "B", "nice_to_have", 2), ("C1", "C", "recommended", 8),
                )
            ]
        )
        domain = F.concat(F.lit("site"), (p % 40).cast("string"), F.lit(".com"))
        return self.given("pages").select(
            p.alias("audit_id"), domain.alias("target"), domain.alias("domain"),
            pick((*ENGINES, None), p % 8).alias("engine"),
            F.timestamp_seconds(F.lit(1_767_225_600) + (p * 7 % 1000) * 3600).alias("checked_at"),
            F.lit("ready").alias("verdict"), score.alias("score"), F.lit(False).alias("blocked"),
            check.alias("checks"),
        )

    @cached_property
    def site_fetch(self) -> DataFrame:
        """Seven responses per page, as a crawl would land them; the target is one site per page."""
        p = F.col("page_id")
        site = F.concat(F.lit("shop.site"), p.cast("string"), F.lit(".com"), F.when(p % 3 == 0, "/Docs/").otherwise(""))
        head = F.concat(
            F.when(p % 4 == 0, ORG).when(p % 4 == 1, GRAPH).when(p % 4 == 2, BROKEN).otherwise(""),
            F.when(p % 3 != 1, META).otherwise(""),
            F.when(p % 19 == 0, '<meta name="robots" content="NOINDEX, follow">').otherwise(""),
        )
        foot = F.concat(
            F.when(p % 5 == 0, '<a href="/x">About us</a>').otherwise(""),
            F.when(p % 5 < 2, '<a href="/contact-form">write</a>').otherwise(""),
            F.when(p % 6 == 0, '<time datetime="2026-01-01">now</time>').otherwise(""),
        )
        dressed = F.replace(
            F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>"))),
            F.lit("<footer>"), F.concat(foot, F.lit("<footer>")),
        )
        home = F.when(p % 11 == 0, SHELL).when(p % 13 == 0, THIN).otherwise(dressed)
        down = p % 17 == 0

        def response(kind: str, status: Column, text: Column, redirects: Column, scheme: Column, path: str) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                F.concat(F.lit("https://site"), p.cast("string"), F.lit(".com" + path)).alias("url"),
                status.cast("int").alias("status"), text.alias("text"), redirects.cast("int").alias("redirects"),
                scheme.alias("scheme"),
                F.when(status.isNull(), "timed out").alias("error"),
            )

        def code(test: Column, otherwise: int) -> Column:
            return F.when(test, F.lit(None).cast("int")).otherwise(F.lit(otherwise))

        none, https = F.lit(0), F.lit("https")
        home_status = F.when(down, F.lit(None).cast("int")).when(p % 23 == 0, 503).otherwise(200)
        robots_status = F.when(p % 7 == 6, pick((404, 429, 500), F.floor(p / 7) % 3)).otherwise(200)
        responses = F.array(
            response("homepage", home_status, F.when(~down, home), p % 4, https, "/"),
            response("homepage_http", code(down, 200), F.lit(""), none, F.when(p % 9 == 0, "http").otherwise("https"), "/"),
            response("robots", robots_status, pick(ROBOTS, p % 7 % 6), none, https, "/robots.txt"),
            response("sitemap", F.when(p % 3 == 2, 404).otherwise(200), pick(SITEMAPS, F.floor(p / 3) % 2), none, https, "/sitemap.xml"),
            response("llms", F.when(p % 4 < 2, 200).otherwise(404), pick(LLMS, p % 2), none, https, "/llms.txt"),
            response("security", F.when(p % 10 == 0, 200).otherwise(404), F.lit(""), none, https, "/.well-known/security.txt"),
            response("target_page", F.when(p % 3 == 0, F.when(p % 12 == 0, 404).otherwise(200)), F.when(p % 3 == 0, F.col("html")), none, https, "/docs"),
        )
        rows = self.given("pages").select("page_id", site.alias("target"), F.inline(responses))
        kept = rows.where((F.col("kind") != "target_page") | (F.col("page_id") % 3 == 0))
        return kept.withColumns(
            {
                "domain": F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".com")),
                "final_url": F.col("url"),
                "headers": F.create_map().cast("map<string,string>"),
                "checked_at": F.lit("2026-01-02").cast("timestamp"),
            }
        )
