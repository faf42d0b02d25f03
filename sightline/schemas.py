"""Explicit table schemas, as DDL text.  Nothing in the library infers a schema."""

from __future__ import annotations

LENSES = ("general", "branded", "comparative")
ALL = "all"

# the seven read-side metrics, in display order
RATIO_METRICS = (
    "overview_coverage",
    "visibility_in_sources",
    "visibility_in_citations",
    "relative_citation",
    "brand_mention_rate",
)
POSITION_METRICS = ("avg_source_position", "avg_citation_position")
SEVEN_METRICS = RATIO_METRICS + POSITION_METRICS
COUNT_METRICS = ("n_queries", "n_overviews", "n_in_sources", "n_cited", "n_brand_mentions")
METRIC_COLUMNS = COUNT_METRICS + SEVEN_METRICS

OUTCOMES = ("cited", "sources_only", "mention_only", "absent", "no_answer")


LINKS = "ARRAY<STRUCT<rank: INT, url: STRING, domain: STRING>>"

CAPTURE = (
    "query STRING, lens STRING, engine STRING, captured_at TIMESTAMP, answer_text_md STRING, "
    "screenshot_path STRING, overview_present BOOLEAN, "
    f"sources {LINKS}, citations {LINKS}, "
    "target_source_ranks ARRAY<INT>, target_citation_ranks ARRAY<INT>, "
    "brand_in_answer_text BOOLEAN, sentiment STRING"
)

BRANDS = ("brand_id LONG, name STRING, domain STRING, created_at TIMESTAMP")

RUNS = (
    "run_id LONG, brand_id LONG, engine STRING, run_at TIMESTAMP, status STRING, "
    "n_queries INT, n_ok INT, n_failed INT, group_id STRING"
)

RESULTS = (
    "id LONG, run_id LONG, query STRING, lens STRING, captured_at TIMESTAMP, answer_text_md STRING, "
    f"screenshot_path STRING, overview_present BOOLEAN, sources {LINKS}, citations {LINKS}, "
    "target_source_ranks ARRAY<INT>, target_citation_ranks ARRAY<INT>, "
    "brand_in_answer_text BOOLEAN, sentiment STRING"
)

METRICS = (
    "run_id LONG, brand_id LONG, engine STRING, lens STRING, "
    "n_queries LONG, n_overviews LONG, n_in_sources LONG, n_cited LONG, n_brand_mentions LONG, "
    "overview_coverage DOUBLE, visibility_in_sources DOUBLE, visibility_in_citations DOUBLE, "
    "relative_citation DOUBLE, brand_mention_rate DOUBLE, "
    "avg_source_position DOUBLE, avg_citation_position DOUBLE"
)

LENS_SENTIMENT = ("run_id LONG, lens STRING, summary STRING, computed_at TIMESTAMP")

DOMAIN_STATS = (
    "run_id LONG, brand_id LONG, engine STRING, lens STRING, domain STRING, is_brand BOOLEAN, "
    "appearances_sources LONG, appearances_citations LONG, "
    "sum_min_source_rank DOUBLE, sum_min_citation_rank DOUBLE, "
    "avg_source_position DOUBLE, avg_citation_position DOUBLE"
)

CHECK = (
    "STRUCT<id: STRING, category: STRING, title: STRING, severity: STRING, status: STRING, "
    "detail: STRING, remediation: STRING>"
)
AUDITS = (
    "audit_id LONG, target STRING, domain STRING, engine STRING, checked_at TIMESTAMP, "
    f"verdict STRING, score INT, blocked BOOLEAN, checks ARRAY<{CHECK}>"
)

QUESTIONS = ("query STRING, lens STRING")
CANDIDATES = (
    "query STRING, lens STRING, segment STRING, signal STRING, source_url STRING, note STRING"
)

SITE_FETCH = (
    "target STRING, domain STRING, kind STRING, url STRING, final_url STRING, status INT, "
    "text STRING, redirects INT, scheme STRING, error STRING, headers MAP<STRING, STRING>, "
    "checked_at TIMESTAMP"
)
FETCH_KINDS = (
    "homepage", "homepage_http", "robots", "sitemap", "llms", "security", "target_page",
)
