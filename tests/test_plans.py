"""Plans have the shape they are meant to have."""

from __future__ import annotations

import pytest

from sightline.operators import leaderboard as L
from sightline.operators import metrics as M
from sightline.operators.captures import capture_links, match_links_to_targets
from sightline.operators.outcomes import sentiment_samples
from sightline.operators.runs import completed_only
from sightline.schemas import BRANDS, DOMAIN_STATS, RESULTS, RUNS
from sightline.session import scratch_path


@pytest.fixture(scope="module")
def tables(spark):
    out = {}
    for name, schema in (("captures", RESULTS), ("runs", RUNS), ("brands", BRANDS), ("stats", DOMAIN_STATS)):
        path = scratch_path(spark, name)
        spark.createDataFrame([], schema).write.parquet(path)
        out[name] = spark.read.schema(schema).parquet(path)
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def scans(text: str) -> list[str]:
    return [line for line in text.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]


def test_metrics_read_five_columns_and_use_no_python(tables):
    text = plan(M.run_metrics(tables["captures"], tables["runs"]))
    captures = next(line for line in scans(text) if "target_source_ranks" in line)
    assert "answer_text_md" not in captures and "sources:" not in captures.replace("target_source", "")
    assert "Python" not in text and "Expand" not in text


def test_leaderboard_prunes_inside_links(tables):
    text = plan(L.domain_leaderboard(tables["captures"], tables["runs"], tables["brands"]))
    captures = next(line for line in scans(text) if "citations" in line)
    assert "answer_text_md" not in captures and "CartesianProduct" not in text


def test_top_k_is_limited_before_the_shuffle(tables):
    for df in (L.leaderboard_top(tables["stats"]), sentiment_samples(tables["captures"])):
        physical = plan(df).split("== Physical Plan ==")[1]
        assert physical.count("WindowGroupLimit") >= 2


def test_filters_reach_the_scan(tables):
    assert any("PushedFilters: [IsNotNull(status), EqualTo(status,done)]" in line for line in scans(plan(completed_only(tables["runs"]))))


def test_targets_match_without_pairs(tables):
    text = plan(match_links_to_targets(capture_links(tables["captures"]), tables["brands"]))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_settings_of_the_user_stay(spark):
    from sightline.session import tuned

    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert tuned(spark).conf.get("spark.sql.session.timeZone") == "Europe/Berlin"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
