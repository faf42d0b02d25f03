"""Column expressions: URL rules, link arrays, text rules, calendar and comparison."""

from .calendar import day_as_written, is_fresh, iso_week, iso_week_monday
from .compare import delta_direction, lens_order, outcome_of, ratio, weighted_mean
from .links import (
    best_rank, decode_links, decode_ranks, domain_best_ranks, drop_ads, links_of_ranked, renumber,
    target_ranks, unwrap_redirects,
)
from .text import contains_brand, normalize_brand_name, normalize_query, split_phrase_text, strip_ws, tokens
from .urls import (
    effective_link, matches_target, normalize_domain, normalize_target, split_target, target_prefixes,
)

__all__ = [
    "best_rank", "contains_brand", "decode_links", "decode_ranks", "delta_direction",
    "day_as_written", "domain_best_ranks", "drop_ads", "effective_link", "is_fresh", "iso_week", "iso_week_monday",
    "lens_order", "links_of_ranked", "matches_target", "normalize_brand_name", "normalize_domain",
    "normalize_query", "normalize_target", "outcome_of", "ratio", "renumber", "split_phrase_text",
    "split_target", "strip_ws", "target_prefixes", "target_ranks", "tokens", "unwrap_redirects",
    "weighted_mean",
]
