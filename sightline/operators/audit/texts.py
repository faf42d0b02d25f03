"""What each check is called and what it says."""

# id: (category, title, severity)
CHECKS = {
    "A1": ("A", "Domain resolves & HTTPS valid", "blocker"),
    "A2": ("A", "Homepage returns 200", "blocker"),
    "A3": ("A", "robots.txt allows the engine's search bot", "blocker"),
    "A3b": ("A", "robots.txt hygiene", "recommended"),
    "A4": ("A", "sitemap.xml present & referenced", "recommended"),
    "A5": ("A", "Content in raw HTML (SSR)", "blocker"),
    "B1": ("B", "Structured data (JSON-LD)", "recommended"),
    "B2": ("B", "Semantic HTML", "recommended"),
    "B3": ("B", "Meta basics", "recommended"),
    "B4": ("B", "llms.txt present", "nice_to_have"),
    "C1": ("C", "About / Contact pages", "recommended"),
    "C2": ("C", "Organization schema (logo + sameAs)", "recommended"),
    "D1": ("D", "Visible dates", "nice_to_have"),
    "D2": ("D", "RSS/Atom feed", "nice_to_have"),
    "D3": ("D", ".well-known/security.txt", "nice_to_have"),
}

KEY_SCHEMA_TYPES = (
    "Organization", "WebSite", "Article", "BlogPosting", "FAQPage", "Product", "BreadcrumbList", "HowTo",
)

ROBOTS_ALLOW = (
    "User-agent: Googlebot\n"
    "Allow: /\n"
    "User-agent: OAI-SearchBot\n"
    "Allow: /\n"
    "Sitemap: https://<domain>/sitemap.xml"
)
ORG_JSONLD = (
    '<script type="application/ld+json">'
    '{"@context":"https://schema.org","@type":"Organization",'
    '"name":"<Brand>","url":"https://<domain>/",'
    '"logo":"https://<domain>/logo.png",'
    '"sameAs":["https://www.linkedin.com/company/<brand>"]}</script>'
)
LLMS_MIN = (
    "# <Brand>\n"
    "> One-sentence description of what <Brand> is.\n"
    "## Docs\n"
    "- [Getting started](https://<domain>/docs): setup and first steps"
)

# details and remedies; {n} marks what the check fills in
T = {
    "A1_down": "{0} unreachable: {1}.",
    "A1_down_fix": "Serve a valid TLS certificate and a reachable homepage over HTTPS.",
    "A1_http": "HTTPS is reachable but http:// does not redirect to https://.",
    "A1_http_fix": "Add a 301 redirect from http:// to https://.",
    "A1_ok": "Domain resolves and serves valid HTTPS.",
    "A2_skip": "Homepage unreachable (see A1).",
    "A2_home": "Homepage returned HTTP {0}.",
    "A2_home_fix": "Serve HTTP 200 at the canonical homepage.",
    "A2_page": "Target page {0} returned HTTP {1}.",
    "A2_page_fix": "Ensure the target URL returns HTTP 200.",
    "A2_chain": "Homepage 200 but reached via {0} redirects.",
    "A2_chain_fix": "Shorten the redirect chain to the canonical homepage.",
    "A2_ok": "Homepage returns HTTP 200.",
    "A3_unread": (
        "robots.txt could not be read (server error or timeout), so crawl access was not verified. "
        "Crawlers treat an unreadable robots.txt as a full disallow, so re-check once it serves 200 or 404."
    ),
    "robots_fix": "Serve /robots.txt with HTTP 200 (or 404 if you have none).",
    "A3_unmapped": (
        "No published search-bot user-agent is mapped for '{0}', so robots.txt cannot be graded as a "
        "citation blocker for this engine. Other search bots are still reported by A3b."
    ),
    "A3_blocked": "robots.txt disallows {0} (the search bot for {1}) from '/'.",
    "A3_ok": "{0} (the search bot for {1}) may fetch '/'.",
    "A3b_unread": (
        "robots.txt could not be read (server error or timeout) — crawl access is unverified, not confirmed."
    ),
    "A3b_none": "No robots.txt — everything is allowed.",
    "A3b_malformed": "robots.txt could not be parsed.",
    "A3b_other": "Other search bots blocked: {0}.",
    "A3b_ok": "No other search bots blocked.",
    "A3b_training": " Training bots blocked (a policy choice, not a citation block): {0}.",
    "A4_ok": "sitemap.xml is valid XML and referenced in robots.txt.",
    "A4_unref": "sitemap.xml is valid but not referenced in robots.txt.",
    "A4_unref_fix": "Add a `Sitemap:` line to robots.txt.",
    "A4_bad": "sitemap.xml is present but not well-formed XML.",
    "A4_bad_fix": "Serve a valid XML sitemap at /sitemap.xml.",
    "A4_none": "No sitemap.xml found.",
    "A4_none_fix": "Publish /sitemap.xml and reference it in robots.txt.",
    "A5_skip": "Could not read page HTML (see A1/A2).",
    "A5_ok": "Primary content is present in the raw HTML ({0} words).",
    "A5_spa": "Primary content is JS-rendered{0}: an SPA shell with {1} words in the raw HTML.",
    "A5_spa_fix": "Server-render or pre-render the primary content so it is in the initial HTML.",
    "A5_thin": (
        "Thin raw HTML ({0} words, {1} headings) with no server-rendered main block — "
        "verify the content is not JS-only."
    ),
    "A5_thin_fix": "Ensure the primary content is server-rendered / present in the initial HTML.",
    "no_html": "Homepage HTML unavailable.",
    "B1_none": "No JSON-LD structured data found.",
    "B1_invalid": "{0} of {1} JSON-LD blocks are invalid JSON.",
    "B1_no_key": "JSON-LD present but no key entity type (found: {0}).",
    "B1_ok": "Valid JSON-LD present: {0}.",
    "B2_ok": "Single <h1>, a <main>/<article>, and sane heading order.",
    "B2_none": "No headings found in the page.",
    "B2_none_fix": "Add a single <h1> and wrap primary content in <main>/<article>.",
    "B2_h1": "{0} <h1> elements",
    "B2_main": "no <main>/<article>",
    "B2_order": "heading levels skip",
    "B2_fix": "Use exactly one <h1>, a <main>/<article>, and a non-skipping heading order.",
    "B3_noindex": "Homepage is marked noindex (asks search engines to exclude it).",
    "B3_noindex_fix": "Remove the noindex robots meta from indexable pages.",
    "B3_ok": "Title, description and canonical present; not noindex.",
    "B3_missing": "Missing meta: {0}.",
    "B3_fix": "Add a unique <title>, a meta description and a canonical link.",
    "B4_ok": "/llms.txt is present with a top-level heading.",
    "B4_no_h1": "/llms.txt is present but has no top-level heading.",
    "B4_none": "No /llms.txt found.",
    "C1_ok": "About and Contact links found.",
    "C1_one": "Only one of About / Contact is linked.",
    "C1_one_fix": "Link both an About and a Contact page from the homepage.",
    "C1_none": "No About or Contact link found.",
    "C1_none_fix": "Add About and Contact pages linked from the homepage.",
    "C2_ok": "Organization schema with logo and sameAs.",
    "C2_part": "Organization schema present but missing logo and/or sameAs.",
    "C2_none": "No Organization schema found.",
    "D1_ok": "Publication/update dates present.",
    "D1_none": "No visible publication/update dates.",
    "D1_fix": "Expose datePublished/dateModified (JSON-LD) or <time> elements.",
    "D2_ok": "RSS/Atom feed linked.",
    "D2_none": "No RSS/Atom feed linked.",
    "D2_fix": "Publish an RSS/Atom feed and link it via <link rel=alternate>.",
    "D3_ok": "/.well-known/security.txt present.",
    "D3_none": "No /.well-known/security.txt.",
    "D3_fix": "Add a /.well-known/security.txt contact file.",
}
