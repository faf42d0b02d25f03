"""Registered queries against the same result in SQL.

The quick set covers every module; SIGHTLINE_ALL=1 runs all of them.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from conformance.check import compare

SF = os.environ.get("SIGHTLINE_SF", "/root/testdata/sf0.001")
QUICK = (
    "run_metrics domain_leaderboard leaderboard_top top_cited_domains with_shares view_metrics_today weekly_rollup "
    "metric_deltas previous_completed_run engine_matrix_period sentiment_samples match_links_to_targets quarantine "
    "append_captures rebuild_metrics read_captures run_artifact_parts missing_questions build_question_set "
    "near_duplicate_questions score_extraction page_signals audit_sites robots_policy_matrix audit_refresh_list "
    "normalize_target stream_dedupe stream_weekly_trend"
).split()
NAMES = list(entry.queries()) if os.environ.get("SIGHTLINE_ALL") else QUICK


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns[:4] == ["run_id", "brand_id", "engine", "lens"]
