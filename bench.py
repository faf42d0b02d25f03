"""Headline queries, timed: one JSON line.

The capture, run, metric and leaderboard tables are derived from the given ones and stored first
(``prepare``); the queries then read them from Parquet, as they do in use.
"""

from __future__ import annotations

import json
import os
import time

from conformance.derived import Derived
from conformance.registry import _cases
from sightline.session import local_session, scratch_path

HEADLINE = (
    "run_metrics", "domain_leaderboard", "leaderboard_top", "leaderboard_period", "period_rollup", "group_spread",
    "weekly_rollup", "metric_deltas", "previous_completed_run", "engine_matrix", "view_metrics_today",
    "view_competitors", "outcome_counts", "sentiment_samples", "match_links_to_targets", "missing_questions",
    "quarantine", "append_captures", "score_extraction", "build_question_set", "near_duplicate_questions",
    "page_signals", "robots_policy_matrix", "audit_sites",
)
STORED = (
    "brands", "runs", "captures", "captures_raw", "capture_bodies", "metrics", "stats", "sentiment", "questions",
    "candidates", "audits", "site_fetch",
)


def prepare(d: Derived, files: int) -> None:
    """Write the derived tables in several files, as they come from many tasks, and let the queries read them."""
    root = scratch_path(d.spark, "bench")
    made = {}
    for name in STORED:
        df = getattr(d, name)
        df.repartition(files).write.parquet(f"{root}/{name}")
        made[name] = d.spark.read.schema(df.schema).parquet(f"{root}/{name}")
        d.__dict__[name] = made[name]
    for name in ("raw_objects", "candidates_raw"):
        d.__dict__.pop(name, None)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, "sightline-bench", int(cpus) if cpus.isdigit() else 8)
    # the tables are small here: keep all cores busy instead of merging small partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    derived = Derived(spark, sf_dir)
    started = time.perf_counter()
    prepare(derived, 2 * spark.sparkContext.defaultParallelism)
    timings = {}
    prepared = time.perf_counter() - started
    cases = _cases()
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            started = time.perf_counter()
            cases[name][0](derived).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        timings[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "prepare": round(prepared, 3), "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
