"""The fifteen checks as columns over one assembled site row, and the audit job.

Site row: ``homepage``, ``homepage_http``, ``target_page``, ``sitemap``, ``llms``, ``security`` (structs of
``facts_of``), ``robots`` (``robots_of``), ``home`` and ``page`` (page signals), ``engine``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import normalize_domain, normalize_target
from ...schemas import FETCH_KINDS
from .pages import llms_has_h1, page_signals, sitemap_wellformed
from .robots import gating, no_robots, robots_of
from .texts import CHECKS, KEY_SCHEMA_TYPES, LLMS_MIN, ORG_JSONLD, ROBOTS_ALLOW, T
from .verdict import with_verdict

Branch = tuple[Column | None, str, Column | str, str | None]


def _say(text: str, *values: Column | str) -> Column:
    """A fixed text with its marks filled in."""
    parts = re.split(r"\{(\d)\}", T[text])
    pieces = [F.lit(p) if i % 2 == 0 else values[int(p)] for i, p in enumerate(parts)]
    return F.concat(*[F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("")) for p in pieces])


def _check(check_id: str, *branches: Branch) -> Column:
    """First branch whose condition holds, as a check struct; the last branch has no condition."""
    category, title, severity = CHECKS[check_id]

    def outcome(status: str, detail: Column | str, fix: str | None) -> Column:
        return F.struct(
            F.lit(check_id).alias("id"), F.lit(category).alias("category"), F.lit(title).alias("title"),
            F.lit(severity).alias("severity"), F.lit(status).alias("status"),
            (F.lit(T[detail]) if isinstance(detail, str) else detail).alias("detail"),
            F.lit(fix).cast("string").alias("remediation"),
        )

    case = None
    for condition, status, detail, fix in branches[:-1]:
        hit = F.coalesce(condition, F.lit(False))
        value = outcome(status, detail, fix)
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return case.otherwise(outcome(*branches[-1][1:]))


c = F.col


def _readable() -> Column:
    return (c("homepage.status") == 200) & c("homepage.has_text")


def check_A1() -> Column:
    downgraded = c("homepage_http.status").isNotNull() & (c("homepage_http.scheme") != "https")
    reason = F.coalesce(F.nullif(c("homepage.error"), F.lit("")), F.lit("no response"))
    return _check(
        "A1",
        (c("homepage.status").isNull(), "fail", _say("A1_down", c("homepage.url"), reason), T["A1_down_fix"]),
        (downgraded, "warn", "A1_http", T["A1_http_fix"]),
        (None, "pass", "A1_ok", None),
    )


def check_A2() -> Column:
    return _check(
        "A2",
        (c("homepage.status").isNull(), "skip", "A2_skip", None),
        (c("homepage.status") != 200, "fail", _say("A2_home", c("homepage.status")), T["A2_home_fix"]),
        (
            c("target_page.status") != 200, "fail",
            _say("A2_page", c("target_page.url"), c("target_page.status")), T["A2_page_fix"],
        ),
        (c("homepage.redirects") > 2, "warn", _say("A2_chain", c("homepage.redirects")), T["A2_chain_fix"]),
        (None, "pass", "A2_ok", None),
    )


def check_A3() -> Column:
    gate = gating(c("robots.policies"), c("engine"))
    label = F.coalesce(F.nullif(c("engine"), F.lit("")), F.lit("generic"))
    return _check(
        "A3",
        (c("robots.unreadable"), "skip", "A3_unread", T["robots_fix"]),
        (~gate["gradable"], "skip", _say("A3_unmapped", label), ROBOTS_ALLOW),
        (~gate["allowed"], "fail", _say("A3_blocked", gate["gating_ua"], label), ROBOTS_ALLOW),
        (None, "pass", _say("A3_ok", gate["gating_ua"], label), None),
    )


def check_A3b() -> Column:
    gate = gating(c("robots.policies"), c("engine"))["gating_ua"]

    def blocked(tier: str) -> Column:
        hits = F.filter(
            c("robots.policies"),
            lambda p: (p["tier"] == tier) & ~p["allowed"] & ~p["ua"].eqNullSafe(gate),
        )
        return F.transform(hits, lambda p: p["ua"])

    training = F.array_join(blocked("training"), ", ")
    note = F.when(training != "", _say("A3b_training", training)).otherwise(F.lit(""))
    others = F.array_join(blocked("search"), ", ")

    def noted(text: str, *values: Column) -> Column:
        return F.concat(_say(text, *values), note)

    return _check(
        "A3b",
        (c("robots.unreadable"), "warn", "A3b_unread", T["robots_fix"]),
        (~c("robots.present"), "skip", noted("A3b_none"), None),
        (c("robots.malformed"), "warn", noted("A3b_malformed"), None),
        (others != "", "warn", noted("A3b_other", others), ROBOTS_ALLOW),
        (None, "pass", noted("A3b_ok"), None),
    )


def check_A4() -> Column:
    served = c("sitemap.status") == 200
    valid = served & c("sitemap.good")
    return _check(
        "A4",
        (valid & (F.size("robots.sitemaps") > 0), "pass", "A4_ok", None),
        (valid, "warn", "A4_unref", T["A4_unref_fix"]),
        (served, "warn", "A4_bad", T["A4_bad_fix"]),
        (None, "fail", "A4_none", T["A4_none_fix"]),
    )


def check_A5() -> Column:
    target_read = F.coalesce((c("target_page.status") == 200) & c("target_page.has_text"), F.lit(False))
    readable = F.coalesce(_readable(), F.lit(False)) | target_read
    words, fw = c("page.raw_word_count"), c("page.framework")
    named = F.coalesce(F.concat(F.lit(" ("), fw, F.lit(")")), F.lit(""))
    spa = (F.size("page.empty_root_markers") > 0) | fw.isNotNull()
    return _check(
        "A5",
        (~readable, "skip", "A5_skip", None),
        (~c("page.js_dependent"), "pass", _say("A5_ok", words), None),
        (spa, "fail", _say("A5_spa", named, words), T["A5_spa_fix"]),
        (None, "warn", _say("A5_thin", words, c("page.heading_count")), T["A5_thin_fix"]),
    )


def _unreadable() -> Branch:
    return (~F.coalesce(_readable(), F.lit(False)), "skip", "no_html", None)


def check_B1() -> Column:
    types = c("home.jsonld_types")
    keys = F.filter(types, lambda t: t.isin(*KEY_SCHEMA_TYPES))
    found = F.coalesce(F.nullif(F.array_join(types, ", "), F.lit("")), F.lit("none"))
    return _check(
        "B1",
        _unreadable(),
        (c("home.jsonld_blocks") == 0, "fail", "B1_none", ORG_JSONLD),
        (
            c("home.jsonld_invalid") > 0, "warn",
            _say("B1_invalid", c("home.jsonld_invalid"), c("home.jsonld_blocks")), ORG_JSONLD,
        ),
        (F.size(keys) == 0, "warn", _say("B1_no_key", found), ORG_JSONLD),
        (None, "pass", _say("B1_ok", F.array_join(keys, ", ")), None),
    )


def check_B2() -> Column:
    single, body, order = c("home.h1_count") == 1, c("home.has_main_or_article"), c("home.heading_order_ok")
    issues = F.array_join(
        F.array_compact(
            F.array(
                F.when(~single, _say("B2_h1", c("home.h1_count"))),
                F.when(~body, F.lit(T["B2_main"])),
                F.when(~order, F.lit(T["B2_order"])),
            )
        ),
        "; ",
    )
    return _check(
        "B2",
        _unreadable(),
        (single & body & order, "pass", "B2_ok", None),
        (c("home.heading_count") == 0, "fail", "B2_none", T["B2_none_fix"]),
        (None, "warn", F.concat(issues, F.lit(".")), T["B2_fix"]),
    )


def check_B3() -> Column:
    absent = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(F.coalesce(c(f"home.{field}"), F.lit("")) == "", F.lit(name))
                    for name, field in (
                        ("title", "title"), ("description", "meta_description"), ("canonical", "canonical")
                    )
                ]
            )
        ),
        ", ",
    )
    return _check(
        "B3",
        _unreadable(),
        (c("home.noindex"), "fail", "B3_noindex", T["B3_noindex_fix"]),
        (absent == "", "pass", "B3_ok", None),
        (None, "warn", _say("B3_missing", absent), T["B3_fix"]),
    )


def check_B4() -> Column:
    served = c("llms.status") == 200
    return _check(
        "B4",
        (served & c("llms.good"), "pass", "B4_ok", None),
        (served, "warn", "B4_no_h1", LLMS_MIN),
        (None, "fail", "B4_none", LLMS_MIN),
    )


def check_C1() -> Column:
    about, contact = c("home.has_about_link"), c("home.has_contact_link")
    return _check(
        "C1",
        _unreadable(),
        (about & contact, "pass", "C1_ok", None),
        (about | contact, "warn", "C1_one", T["C1_one_fix"]),
        (None, "fail", "C1_none", T["C1_none_fix"]),
    )


def check_C2() -> Column:
    org = c("home.has_organization")
    return _check(
        "C2",
        _unreadable(),
        (org & c("home.org_logo") & (c("home.org_sameas") > 0), "pass", "C2_ok", None),
        (org, "warn", "C2_part", ORG_JSONLD),
        (None, "fail", "C2_none", ORG_JSONLD),
    )


def check_D1() -> Column:
    return _check(
        "D1", _unreadable(), (c("home.has_dates"), "pass", "D1_ok", None), (None, "fail", "D1_none", T["D1_fix"])
    )


def check_D2() -> Column:
    return _check(
        "D2", _unreadable(), (c("home.has_feed"), "pass", "D2_ok", None), (None, "fail", "D2_none", T["D2_fix"])
    )


def check_D3() -> Column:
    return _check(
        "D3", (c("security.status") == 200, "pass", "D3_ok", None), (None, "fail", "D3_none", T["D3_fix"])
    )


ALL_CHECKS: dict[str, Callable[[], Column]] = {
    "A1": check_A1, "A2": check_A2, "A3": check_A3, "A3b": check_A3b, "A4": check_A4, "A5": check_A5,
    "B1": check_B1, "B2": check_B2, "B3": check_B3, "B4": check_B4, "C1": check_C1, "C2": check_C2,
    "D1": check_D1, "D2": check_D2, "D3": check_D3,
}


def assemble_sites(site_fetch: DataFrame) -> DataFrame:
    """One small row per target out of its newest responses.

    Pages are read before the shuffle: signals, policies and flags travel, page text does not.
    """
    kind, text = c("kind"), c("text")
    is_page = kind.isin("homepage", "target_page") & (c("status") == 200)
    read = page_signals(site_fetch.withColumn("_page", F.when(is_page, text)), "_page")
    facts = F.struct(
        "url", "status", "redirects", "scheme", "error",
        text.isNotNull().alias("has_text"),
        F.when(kind == "sitemap", sitemap_wellformed(text)).when(kind == "llms", llms_has_h1(text)).alias("good"),
        c("signals"),
        F.when(kind == "robots", robots_of(text, c("status"))).alias("robots"),
    )
    small = read.select("target", "kind", "checked_at", facts.alias("facts"))
    newest = small.groupBy("target").agg(
        F.max("checked_at").alias("checked_at"),
        *[
            F.max_by(F.when(kind == k, c("facts")), F.when(kind == k, c("checked_at"))).alias(k)
            for k in FETCH_KINDS
        ],
    )
    sites = newest.withColumn("robots", F.coalesce("robots.robots", no_robots()))
    # a target page that was read decides about rendering, else the homepage does
    return sites.withColumns(
        {
            "home": c("homepage.signals"),
            "page": F.coalesce("target_page.signals", "homepage.signals"),
        }
    )


def audit_checks(site_fetch: DataFrame, engines: Sequence[str | None] | DataFrame) -> DataFrame:
    """All checks of every site for every engine: (target, domain, engine, checked_at, checks).

    ``engines`` is a list for all sites or a table of (target, engine) requests.
    """
    sites = assemble_sites(site_fetch)
    if isinstance(engines, DataFrame):
        rows = sites.join(engines.select("target", "engine"), "target")
    else:
        rows = sites.withColumn("engine", F.explode(F.array(*[F.lit(e).cast("string") for e in engines])))
    return rows.select(
        normalize_target(c("target")).alias("target"),
        normalize_domain(c("target")).alias("domain"),
        "engine", "checked_at",
        F.array(*[check() for check in ALL_CHECKS.values()]).alias("checks"),
    )


def audit_sites(site_fetch: DataFrame, engines: Sequence[str | None] | DataFrame) -> DataFrame:
    """Audits: checks, blockers, verdict, score and status counts per site and engine."""
    return with_verdict(audit_checks(site_fetch, engines))
