"""Folding metric rows over periods, repeat groups and weeks; deltas and the engine matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso_week, iso_week_monday
from ..schemas import ALL, COUNT_METRICS, METRIC_COLUMNS, SEVEN_METRICS
from .metrics import funnel_ratios
from .runs import (
    SERIES, completed_only, group_run_ids, latest_and_previous, latest_completed_run, metrics_of_done_runs,
    n_runs_done, run_day,
)

_COUNTS = ("n_queries", "n_overviews", "n_in_sources", "n_cited")


def fold_metrics(rows: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Fold metric rows over ``keys``: counts added, ratios worked out anew, positions weighted.

    Averages are never averaged: an average position goes back to its sum.  Runs from before mentions
    were counted are left out of both sides of the mention rate.
    """
    folded = rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS],
        F.sum("n_brand_mentions").alias("n_brand_mentions"),
        F.sum(F.when(F.col("n_brand_mentions").isNotNull(), F.col("n_overviews"))).alias("_mention_base"),
        F.sum(F.col("avg_source_position") * F.col("n_in_sources")).alias("sum_source_rank"),
        F.sum(F.col("avg_citation_position") * F.col("n_cited")).alias("sum_citation_rank"),
        *extra,
    )
    names = [c for c in folded.columns if not c.startswith(("_", "sum_")) and c not in COUNT_METRICS]
    return folded.withColumns(funnel_ratios(F.col("_mention_base"))).select(*names, *METRIC_COLUMNS)


def period_rollup(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """All done runs of a brand and engine, per lens."""
    return fold_metrics(metrics_of_done_runs(metrics, runs), [*SERIES, "lens"])


def _repeats(runs: DataFrame) -> DataFrame:
    return group_run_ids(runs).where(F.col("n_repeats") > 1)


def group_rollup(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Repeat groups of more than one done run, per lens."""
    rows = metrics.drop(*SERIES).join(_repeats(runs), "run_id")
    return fold_metrics(rows, [*SERIES, "group_id", "n_repeats", "lens"])


def _spread() -> list[Column]:
    return [f(m).alias(f"{m}_{end}") for m in SEVEN_METRICS for f, end in ((F.min, "min"), (F.max, "max"))]


def group_spread(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Smallest and largest value of each metric over the repeats of a group; NULLs say nothing."""
    rows = metrics.drop(*SERIES).join(_repeats(runs), "run_id")
    return rows.groupBy(*SERIES, "group_id", "n_repeats", "lens").agg(*_spread())


def trend_points(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """One point per done run and lens; in order of run_at, run_id."""
    return metrics_of_done_runs(metrics, runs).select(*SERIES, "lens", "run_id", "run_at", *METRIC_COLUMNS)


def weekly_rollup(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Done runs folded per ISO week of the day the run was made on, where it was made."""
    points = metrics_of_done_runs(metrics, runs)
    day = run_day(points)
    points = points.withColumns({"week": iso_week(day), "monday": iso_week_monday(day)})
    return fold_metrics(points, [*SERIES, "lens", "week", "monday"], F.count(F.lit(1)).alias("n_runs"))


def latest_vs_previous(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows of the newest done run beside those of the done run before it, lens by lens.

    The run is looked back, not the lens: a lens the previous run lacks has no previous value.
    """
    pair = latest_and_previous(runs)
    now = metrics.drop(*SERIES).join(pair, "run_id")
    before = metrics.select(
        F.col("run_id").alias("prev_run_id"), "lens", *[F.col(m).alias(f"{m}_prev") for m in SEVEN_METRICS]
    )
    return now.join(before, ["prev_run_id", "lens"], "left").select(
        *SERIES, "run_id", "run_at", "group_id", "prev_run_id", "prev_run_at", "lens", *METRIC_COLUMNS,
        *[f"{m}_prev" for m in SEVEN_METRICS],
    )


def metric_deltas(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Seven deltas of the newest done run; NULL when either side is NULL."""
    return latest_vs_previous(metrics, runs).withColumns(
        {f"{m}_delta": F.col(m) - F.col(f"{m}_prev") for m in SEVEN_METRICS}
    )


def engine_matrix(metrics: DataFrame, runs: DataFrame, period: str = "today", lens: str = ALL) -> DataFrame:
    """One row per brand and engine that has any run: newest run or whole period; engines never mixed."""
    engines = runs.select(*SERIES).distinct().join(n_runs_done(runs), SERIES, "left")
    engines = engines.withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    wanted = metrics.where(F.col("lens") == lens)
    if period == "all":
        none = F.lit(None)
        rows = period_rollup(wanted, runs).drop("lens").withColumns(
            {"run_id": none.cast("bigint"), "run_at": none.cast("timestamp")}
        )
    elif period == "today":
        latest = latest_completed_run(runs).select(*SERIES, "run_id", "run_at")
        rows = latest.join(wanted.drop(*SERIES, "lens"), "run_id", "left")
    else:
        raise ValueError("period must be 'today' or 'all'")
    return engines.join(rows, SERIES, "left").select(*SERIES, "n_runs", "run_id", "run_at", *METRIC_COLUMNS)


def with_sentiment_summary(rows: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Rows of (run_id, lens) with the stored summary; a NULL summary is no summary."""
    known = sentiment.where(F.col("summary").isNotNull()).select(
        "run_id", "lens", F.col("summary").alias("sentiment_summary")
    )
    return rows.join(known, ["run_id", "lens"], "left")
