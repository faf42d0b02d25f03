"""Robots, page signals, the fifteen checks, verdicts and audit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators.audit import checks as K
from sightline.operators.audit import pages as P
from sightline.operators.audit import robots as R
from sightline.operators.audit import verdict as V
from sightline.operators.audit.texts import CHECKS
from sightline.plans.views import view_audit
from sightline.sources import tables as T
from sightline.sources.dims import CRAWLERS, GATING, bot_registry, engine_gating

from .derived import BROKEN, ENGINES, GRAPH, META, ORG, SHELL, THIN, Derived
from .oracle import ts, with_ctes
from .present import present

CASES: dict = {}
ASKED = (*ENGINES, None)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def attr_sql(tag: str, name: str) -> str:
    return f"""regexp_replace(regexp_extract({tag}, {q(P.attr_pattern(name))}, 1), '^["'']|["'']$', '', 'g')"""


def words_sql(html: str) -> str:
    return f"len(regexp_extract_all(regexp_replace({html}, {q(P.MARKUP)}, ' ', 'g'), {q(P.WORD)}))"


_TARGET = "'site' || p || '.com' || CASE WHEN p % 3 = 0 THEN '/docs' ELSE '' END"
_SITE = "'shop.site' || p || '.com' || CASE WHEN p % 3 = 0 THEN '/Docs/' ELSE '' END"
_UNESC = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"

SITES = {
    "dress": f"""SELECT page_id AS p, html AS raw, page_id % 11 = 0 AS shell, page_id % 11 <> 0 AND page_id % 13 = 0 AS thin,
        CASE WHEN page_id % 11 = 0 THEN {q(SHELL)} WHEN page_id % 13 = 0 THEN {q(THIN)} ELSE
        replace(replace(html, '</head>', (CASE page_id % 4 WHEN 0 THEN {q(ORG)} WHEN 1 THEN {q(GRAPH)} WHEN 2 THEN {q(BROKEN)} ELSE '' END)
            || (CASE WHEN page_id % 3 <> 1 THEN {q(META)} ELSE '' END)
            || (CASE WHEN page_id % 19 = 0 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END) || '</head>'),
          '<footer>', (CASE WHEN page_id % 5 = 0 THEN '<a href="/x">About us</a>' ELSE '' END)
            || (CASE WHEN page_id % 5 < 2 THEN '<a href="/contact-form">write</a>' ELSE '' END)
            || (CASE WHEN page_id % 6 = 0 THEN '<time datetime="2026-01-01">now</time>' ELSE '' END) || '<footer>') END AS html FROM pages""",
    "cleaned": f"""SELECT *, NOT shell AND NOT thin AS full_page, regexp_replace(html, {q(P.UNREAD)}, ' ', 'g') AS clean,
        regexp_replace(raw, {q(P.UNREAD)}, ' ', 'g') AS raw_clean FROM dress""",
    "sig": f"""SELECT *, {words_sql('clean')} AS words, {words_sql('raw_clean')} AS raw_words,
        list_transform(regexp_extract_all(clean, {q(P.HEADING)}, 1), lambda h: h::INT) AS levels,
        list_transform(regexp_extract_all(raw_clean, {q(P.HEADING)}, 1), lambda h: h::INT) AS raw_levels,
        list_transform(regexp_extract_all(clean, {q(P.ANCHOR_TAG)}), lambda t: lower({attr_sql('t', 'href')})) AS hrefs,
        list_transform(regexp_extract_all(clean, {q(P.ANCHOR_TEXT)}, 1), lambda t: lower(trim(regexp_replace(t, '<[^>]*>', '', 'g')))) AS texts
        FROM cleaned""",
    "facts": """SELECT *, p % 17 = 0 AS down, p % 17 <> 0 AND p % 23 <> 0 AS home_read, p % 3 = 0 AND p % 12 <> 0 AS target_read,
        len(levels) AS n_headings, len(list_filter(levels, lambda h: h = 1)) AS h1,
        regexp_matches(clean, '(?i)<(?:main|article)[\\s>/]') AS has_main,
        len(list_filter(list_zip(levels[:-2], levels[2:]), lambda z: z[2] - z[1] > 1)) = 0 AS order_ok,
        regexp_matches(clean, '(?is)<title\\b') AS has_title,
        len(list_filter(hrefs, lambda h: contains(h, 'about'))) > 0 OR list_has_any(texts, ['about', 'about us']) AS about,
        len(list_filter(hrefs, lambda h: contains(h, 'contact'))) > 0 OR list_has_any(texts, ['contact', 'contact us']) AS contact,
        full_page AND p % 3 <> 1 AS meta, words < 200 AND len(levels) = 0 OR (shell AND words < 100) OR words < 50 AS home_js,
        raw_words < 200 AND len(raw_levels) = 0 OR raw_words < 50 AS target_js,
        p % 7 = 6 AND p // 7 % 3 > 0 AS unreadable, p % 7 < 5 AS present FROM sig""",
    "engines": "SELECT unnest(['google','chatgpt_search','claude_search','gemini','yandex_neuro','perplexity','deepseek', NULL]) AS engine",
    "grid": """SELECT *, CASE WHEN engine = 'chatgpt_search' THEN 'OAI-SearchBot' WHEN engine = 'claude_search' THEN 'Claude-SearchBot'
            WHEN engine = 'yandex_neuro' THEN 'YandexBot' WHEN engine = 'perplexity' THEN 'PerplexityBot' WHEN engine = 'deepseek' THEN NULL ELSE 'Googlebot' END AS gate,
        present AND engine IS DISTINCT FROM 'deepseek' AND (p % 7 = 1 OR (p % 7 = 3 AND coalesce(engine, '') IN ('chatgpt_search', 'claude_search', 'yandex_neuro', 'perplexity')) OR (p % 7 = 4 AND engine IS NOT DISTINCT FROM 'perplexity')) AS gate_blocked
        FROM facts, engines""",
    "graded": """SELECT p, engine, unnest([
        {'id': 'A1', 'status': CASE WHEN down THEN 'fail' WHEN p % 9 = 0 THEN 'warn' ELSE 'pass' END},
        {'id': 'A2', 'status': CASE WHEN down THEN 'skip' WHEN p % 23 = 0 THEN 'fail' WHEN p % 12 = 0 THEN 'fail' WHEN p % 4 = 3 THEN 'warn' ELSE 'pass' END},
        {'id': 'A3', 'status': CASE WHEN unreadable THEN 'skip' WHEN gate IS NULL THEN 'skip' WHEN gate_blocked THEN 'fail' ELSE 'pass' END},
        {'id': 'A3b', 'status': CASE WHEN unreadable THEN 'warn' WHEN NOT present THEN 'skip' WHEN p % 7 IN (1, 3) OR (p % 7 = 4 AND engine IS DISTINCT FROM 'perplexity') THEN 'warn' ELSE 'pass' END},
        {'id': 'A4', 'status': CASE WHEN p % 3 = 2 THEN 'fail' WHEN p // 3 % 2 = 0 AND p % 7 IN (0, 3) THEN 'pass' ELSE 'warn' END},
        {'id': 'A5', 'status': CASE WHEN NOT home_read AND NOT target_read THEN 'skip' WHEN NOT CASE WHEN target_read THEN target_js ELSE home_js END THEN 'pass'
            WHEN NOT target_read AND shell THEN 'fail' ELSE 'warn' END},
        {'id': 'B1', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN NOT full_page OR p % 4 = 3 THEN 'fail' WHEN p % 4 = 2 THEN 'warn' ELSE 'pass' END},
        {'id': 'B2', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN h1 = 1 AND has_main AND order_ok THEN 'pass' WHEN n_headings = 0 THEN 'fail' ELSE 'warn' END},
        {'id': 'B3', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN full_page AND p % 19 = 0 THEN 'fail' WHEN meta AND has_title THEN 'pass' ELSE 'warn' END},
        {'id': 'B4', 'status': CASE WHEN p % 4 = 0 THEN 'pass' WHEN p % 4 = 1 THEN 'warn' ELSE 'fail' END},
        {'id': 'C1', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN about AND contact THEN 'pass' WHEN about OR contact THEN 'warn' ELSE 'fail' END},
        {'id': 'C2', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN full_page AND p % 4 = 0 THEN 'pass' ELSE 'fail' END},
        {'id': 'D1', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN full_page AND (p % 4 = 1 OR p % 6 = 0) THEN 'pass' ELSE 'fail' END},
        {'id': 'D2', 'status': CASE WHEN NOT home_read THEN 'skip' WHEN meta THEN 'pass' ELSE 'fail' END},
        {'id': 'D3', 'status': CASE WHEN p % 10 = 0 THEN 'pass' ELSE 'fail' END}]) AS x FROM grid""",
    "verdicts": """SELECT p, engine, coalesce(string_agg(x.id, ',' ORDER BY x.id) FILTER (w = 3 AND x.status = 'fail'), '') AS blockers,
        CASE WHEN bool_or(w = 3 AND x.status = 'fail') THEN 'blocked' WHEN bool_or(x.status IN ('fail', 'warn')) THEN 'ready_with_warnings' ELSE 'ready' END AS verdict,
        coalesce(round_even(100 * sum(w * CASE x.status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END) FILTER (x.status <> 'skip')::DOUBLE
            / sum(w) FILTER (x.status <> 'skip'), 0), 100)::BIGINT AS score,
        count(*) FILTER (x.status = 'pass') AS n_pass, count(*) FILTER (x.status = 'warn') AS n_warn,
        count(*) FILTER (x.status = 'fail') AS n_fail, count(*) FILTER (x.status = 'skip') AS n_skip
        FROM (SELECT *, CASE WHEN x.id IN ('A1', 'A2', 'A3', 'A5') THEN 3 WHEN x.id IN ('B4', 'D1', 'D2', 'D3') THEN 1 ELSE 2 END AS w FROM graded) GROUP BY p, engine""",
}


def case(key, fn, sql, extra=None):
    CASES[key] = (fn, None if sql is None else with_ctes(sql, SITES if extra is None else extra))


def _site_no(df):
    return df.withColumn("p", F.regexp_extract("target", r"site(\d+)", 1).cast("bigint"))


# --- robots --------------------------------------------------------------------------------------------

case("robots_state", lambda d: present(R.robots_state(d.site_fetch), "target", "fetched", "present", "unreadable"),
     f"SELECT {_SITE} AS target, p % 7 <> 6 AS fetched, present, unreadable FROM facts")
_RULE_ROWS = [
    (0, 0, "*", True, "/"), (1, 0, "*", False, "/"), (2, 0, "gptbot", False, "/"), (2, 0, "claudebot", False, "/"),
    (2, 1, "*", False, "/private"), (3, 0, "*", False, "/"), (3, 1, "googlebot", True, "/"),
    (4, 0, "oai-searchbot", False, "/"), (4, 0, "oai-searchbot", True, "/"), (4, 1, "perplexitybot", False, "/*"),
]
_RULES_SQL = ", ".join(f"({a}, {b}::BIGINT, '{c}', {str(e).upper()}, '{f}')" for a, b, c, e, f in _RULE_ROWS)
case("robots_rules", lambda d: present(R.robots_rules(d.site_fetch)),
     f"SELECT {_SITE} AS target, group_no, agent, allow, path FROM facts JOIN (VALUES {_RULES_SQL}) r(body, group_no, agent, allow, path) ON p % 7 = body")
_BOTS = ", ".join(f"('{ua}', '{op}', '{tier}')" for ua, op, tier, _, _ in CRAWLERS)
_ALLOWED = """CASE WHEN NOT present THEN TRUE WHEN p % 7 = 1 THEN FALSE WHEN p % 7 = 2 THEN ua NOT IN ('GPTBot', 'ClaudeBot')
    WHEN p % 7 = 3 THEN ua = 'Googlebot' WHEN p % 7 = 4 THEN ua <> 'PerplexityBot' ELSE TRUE END AS allowed"""
_MATRIX = f"SELECT {_SITE} AS target, ua, operator, tier, {_ALLOWED} FROM facts, (VALUES {_BOTS}) b(ua, operator, tier)"
case("robots_policy_matrix", lambda d: present(R.robots_policy_matrix(d.site_fetch)), _MATRIX)
case("robots_policies",
     lambda d: present(R.robots_policies(d.site_fetch).select(
         "target", "sitemaps", F.size(F.filter("policies", lambda x: x["allowed"])).alias("n_allowed"))),
     f"""SELECT target, s AS sitemaps, count(*) FILTER (allowed) AS n_allowed FROM (SELECT m.*,
     CASE p % 7 WHEN 0 THEN 'https://x.example/sitemap.xml' WHEN 3 THEN 'https://x.example/a.xml' ELSE '' END AS s
     FROM ({_MATRIX}) m JOIN (SELECT p, {_SITE} AS target FROM facts) USING (target)) GROUP BY ALL""")
case("robots_sitemaps",
     lambda d: present(d.site_fetch.where("kind = 'robots'").select("target", R.robots_sitemaps(F.col("text")).alias("sitemaps"))),
     f"SELECT {_SITE} AS target, CASE WHEN p % 7 IN (0, 6) THEN 'https://x.example/sitemap.xml' WHEN p % 7 = 3 THEN 'https://x.example/a.xml' ELSE '' END AS sitemaps FROM facts")
case("bot_registry",
     lambda d: present(R.robots_policy_matrix(d.site_fetch).join(bot_registry(d.spark, "search"), "ua").groupBy("ua", "respects_robots", "engine").agg(
         F.count_if(~F.col("allowed")).alias("n_blocked"))),
     f"""SELECT ua, respects AS respects_robots, engine, count(*) FILTER (NOT allowed) AS n_blocked FROM ({_MATRIX}) JOIN
     (VALUES {", ".join(f"('{ua}', {str(r).upper()}, {q(e) if e else 'NULL'})" for ua, _, t, r, e in CRAWLERS if t == 'search')}) b(ua, respects, engine) USING (ua) GROUP BY ALL""")


def _asked(d: Derived):
    return R.robots_policies(d.site_fetch).withColumn("engine", F.explode(F.array(*[F.lit(e) for e in ASKED])))


case("gating_policy", lambda d: present(R.gating_policy(_asked(d))),
     f"SELECT {_SITE} AS target, engine, gate AS gating_ua, gate IS NOT NULL AS gradable, NOT gate_blocked AS allowed FROM grid")
case("engine_gating",
     lambda d: present(_asked(d).join(engine_gating(d.spark), "engine", "left").groupBy("engine", "gating_ua").agg(F.count(F.lit(1)).alias("n"))),
     f"SELECT engine, ua AS gating_ua, count(*) AS n FROM grid LEFT JOIN (VALUES {', '.join(str(g) for g in GATING)}) g(engine, ua) USING (engine) GROUP BY ALL")

# --- pages ---------------------------------------------------------------------------------------------


def _home_signals(d: Derived):
    home = d.site_fetch.where("kind = 'homepage' AND text IS NOT NULL")
    return _site_no(P.page_signals(home.select("target", F.col("text").alias("html"))).select("target", "signals.*"))


_SIGNALS = {
    "raw_word_count": "words", "heading_count": "n_headings", "heading_levels": "array_to_string(levels, ',')", "h1_count": "h1", "has_main_or_article": "has_main", "heading_order_ok": "order_ok",
    "empty_root_markers": "CASE WHEN shell THEN 'div#root' ELSE '' END", "framework": "CASE WHEN shell THEN 'Next' END",
    "has_noscript": "FALSE", "js_dependent": "home_js",
    "title": "CASE WHEN has_title THEN trim(" + _UNESC.format(x=f"regexp_extract(clean, {q(P.TITLE)}, 1)") + ", e' \\t\\n\\r') END",
    "meta_description": "CASE WHEN meta THEN 'about us' END", "canonical": "CASE WHEN meta THEN 'https://x.example/' END",
    "lang": "CASE WHEN full_page THEN nullif(regexp_extract(clean, '<html lang=\"([^\"]*)\"', 1), '') END",
    "noindex": "full_page AND p % 19 = 0", "og_present": "meta", "has_feed": "meta",
    "jsonld_types": "CASE WHEN full_page AND p % 4 = 0 THEN 'Organization' WHEN full_page AND p % 4 = 1 THEN 'Recipe,Article,Course' ELSE '' END",
    "jsonld_blocks": "(full_page AND p % 4 < 3)::BIGINT", "jsonld_invalid": "(full_page AND p % 4 = 2)::BIGINT",
    "has_organization": "full_page AND p % 4 = 0", "org_logo": "full_page AND p % 4 = 0", "org_sameas": "(full_page AND p % 4 = 0)::BIGINT",
    "has_about_link": "about", "has_contact_link": "contact", "has_dates": "full_page AND (p % 4 = 1 OR p % 6 = 0)",
}
case("page_signals", lambda d: present(_home_signals(d), "p", *_SIGNALS),
     "SELECT p, " + ", ".join(f"{e} AS {n}" for n, e in _SIGNALS.items()) + " FROM facts WHERE NOT down")
case("heading_levels", lambda d: present(_home_signals(d), "p", "heading_levels"),
     "SELECT p, array_to_string(levels, ',') AS heading_levels FROM facts WHERE NOT down")
case("heading_order_ok", lambda d: present(_home_signals(d), "p", "heading_order_ok"), "SELECT p, order_ok AS heading_order_ok FROM facts WHERE NOT down")
case("sitemap_wellformed",
     lambda d: present(_site_no(d.site_fetch.where("kind = 'sitemap'")).select("p", P.sitemap_wellformed(F.col("text")).alias("good"))),
     "SELECT p, p // 3 % 2 = 0 AS good FROM facts")
case("llms_has_h1",
     lambda d: present(_site_no(d.site_fetch.where("kind = 'llms'")).select("p", P.llms_has_h1(F.col("text")).alias("good"))),
     "SELECT p, p % 2 = 0 AS good FROM facts")
case("latest_site_fetch",
     lambda d: present(_site_no(T.latest_site_fetch(d.site_fetch)).select(
         "p", F.col("homepage.status").alias("home"), F.col("robots.status").alias("robots"), F.col("target_page.status").alias("page"),
         F.length("homepage.text").alias("n_chars"))),
     """SELECT p, CASE WHEN down THEN NULL WHEN p % 23 = 0 THEN 503 ELSE 200 END::BIGINT AS home,
     CASE WHEN p % 7 = 6 THEN [404, 429, 500][p // 7 % 3 + 1] ELSE 200 END::BIGINT AS robots,
     CASE WHEN p % 12 = 0 THEN 404 WHEN p % 3 = 0 THEN 200 END::BIGINT AS page, CASE WHEN NOT down THEN length(html) END AS n_chars FROM facts""")

# --- audits --------------------------------------------------------------------------------------------

case("audit_sites",
     lambda d: present(K.audit_sites(d.site_fetch, ASKED), "target", "domain", "engine", "blockers", "verdict", "score", "n_pass", "n_warn", "n_fail", "n_skip"),
     f"SELECT {_TARGET} AS target, 'site' || p || '.com' AS domain, engine, blockers, verdict, score, n_pass, n_warn, n_fail, n_skip FROM verdicts")
case("audit_checks",
     lambda d: present(K.audit_checks(d.site_fetch, ASKED).select("target", "engine", F.inline("checks")), "target", "engine", "id", "status"),
     f"SELECT {_TARGET} AS target, engine, x.id AS id, x.status AS status FROM graded")
for _id in CHECKS:
    case(f"check_{_id}",
         lambda d, i=_id: present(K.assemble_sites(d.site_fetch).withColumn("engine", F.explode(F.array(*[F.lit(e) for e in ASKED])))
                                  .select("target", "engine", K.ALL_CHECKS[i]().alias("c")).select("target", "engine", "c.id", "c.status")),
         f"SELECT {_SITE} AS target, engine, x.id AS id, x.status AS status FROM graded WHERE x.id = '{_id}'")
_AUDIT_VERDICT = """SELECT audit_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (severity = 'blocker' AND status = 'fail'), '') AS blockers,
    CASE WHEN bool_or(severity = 'blocker' AND status = 'fail') THEN 'blocked' WHEN bool_or(status IN ('fail', 'warn')) THEN 'ready_with_warnings' ELSE 'ready' END AS verdict
    FROM audit_checks GROUP BY audit_id"""
case("audit_verdict", lambda d: present(V.audit_verdict(d.audits), "audit_id", "blockers", "verdict"), _AUDIT_VERDICT, {})
case("audit_score", lambda d: present(V.audit_score(d.audits), "audit_id", "score"),
     """SELECT audit_id, coalesce(round_even(100 * sum(w * CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END) FILTER (status <> 'skip')::DOUBLE
        / sum(w) FILTER (status <> 'skip'), 0), 100)::BIGINT AS score
     FROM (SELECT *, CASE severity WHEN 'blocker' THEN 3 WHEN 'recommended' THEN 2 ELSE 1 END AS w FROM audit_checks) GROUP BY audit_id""", {})
case("audit_status_counts", lambda d: present(V.audit_status_counts(d.audits), "audit_id", "n_pass", "n_warn", "n_fail", "n_skip"),
     "SELECT audit_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("pass", "warn", "fail", "skip")) + " FROM audit_checks GROUP BY audit_id", {})
_RANK = "CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'skip' THEN 2 ELSE 3 END"
_GATE_RANK = "CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'pass' THEN 2 ELSE 3 END, CASE severity WHEN 'blocker' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END"
case("audit_check_order",
     lambda d: present(d.audits.select(
         "audit_id", F.transform(V.audit_check_order(F.col("checks")), lambda x: x["id"]).alias("report"),
         F.transform(V.audit_check_order(F.col("checks"), True), lambda x: x["id"]).alias("panel"))),
     f"SELECT audit_id, string_agg(id, ',' ORDER BY {_RANK}, id) AS report, string_agg(id, ',' ORDER BY {_GATE_RANK}, id) AS panel FROM audit_checks GROUP BY audit_id", {})
case("audit_by_category",
     lambda d: present(V.audit_by_category(d.audits.withColumn("target", F.col("audit_id").cast("string"))), "target", "category", "id", "position", "status"),
     f"SELECT audit_id::VARCHAR AS target, category, id, status, row_number() OVER (PARTITION BY audit_id, category ORDER BY {_RANK}, id) AS position FROM audit_checks", {})
_LATEST = f"audit_id, domain, engine, {ts('checked_at')} AS checked_at, score"
_LATEST_COLS = ["audit_id", "domain", "engine", "checked_at", "score"]
case("latest_audit", lambda d: present(V.latest_audit(d.audits), *_LATEST_COLS), f"SELECT {_LATEST} FROM latest_own", {})
case("latest_audit_any_engine", lambda d: present(V.latest_audit(d.audits, False), *_LATEST_COLS), f"SELECT {_LATEST} FROM latest_any", {})
_JOINED = "SELECT b.brand_id, split_part(b.domain, '/', 1) AS domain, a.engine, a.audit_id, a.score FROM brands b LEFT JOIN {t} a ON a.domain = split_part(b.domain, '/', 1)"
_JOINED_COLS = ["brand_id", "domain", "engine", "audit_id", "score"]
case("brand_audit_join", lambda d: present(V.brand_audit_join(d.brands, d.audits), *_JOINED_COLS), _JOINED.format(t="latest_own"), {})
case("view_audit", lambda d: present(view_audit(d.brands, d.audits, False), *_JOINED_COLS), _JOINED.format(t="latest_any"), {})
case("audit_refresh_list",
     lambda d: present(V.audit_refresh_list(d.audits, d.audits.where("audit_id % 3 <> 0"), F.lit("2026-02-08").cast("timestamp"), 86_400 * 14)),
     f"""SELECT w.domain, w.engine, {ts('a.checked_at')} AS checked_at FROM (SELECT DISTINCT domain, engine FROM audits) w LEFT JOIN
     (SELECT domain, engine, max(checked_at) AS checked_at FROM audits WHERE audit_id % 3 <> 0 AND engine IS NOT NULL GROUP BY ALL
      UNION ALL SELECT domain, NULL, max(checked_at) FROM audits WHERE audit_id % 3 <> 0 GROUP BY ALL) a
     ON a.domain = w.domain AND a.engine IS NOT DISTINCT FROM w.engine
     WHERE a.checked_at IS NULL OR TIMESTAMP '2026-02-08' - a.checked_at > INTERVAL 14 DAY""", {})
