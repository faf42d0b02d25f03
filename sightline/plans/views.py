"""Read views for all brands and engines at once; a caller filters the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lens_order
from ..operators import leaderboard as board_ops
from ..operators.audit.verdict import brand_audit_join
from ..operators.outcomes import results_in_order
from ..operators.rollups import (
    _spread, engine_matrix, fold_metrics, latest_vs_previous, period_rollup, trend_points, weekly_rollup,
    with_sentiment_summary,
)
from ..operators.runs import SERIES, group_run_ids, latest_completed_run, n_runs_done
from ..operators.skew import salted_join
from ..schemas import ALL, METRIC_COLUMNS, SEVEN_METRICS

DELTAS = [f"{m}_{what}" for m in SEVEN_METRICS for what in ("prev", "delta")]
SPREADS = [f"{m}_{end}" for m in SEVEN_METRICS for end in ("min", "max")]


def _none(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(kind) for n in names})


def focus_group(runs: DataFrame) -> DataFrame:
    """Members of the repeat group of each series' newest done run, if that group has several."""
    latest = latest_completed_run(runs).select(*SERIES, "group_id", F.col("run_id").alias("focus_run_id"))
    members = group_run_ids(runs).where(F.col("n_repeats") > 1)
    return members.join(latest, [*SERIES, "group_id"]).select(
        *SERIES, "group_id", "n_repeats", "focus_run_id", "run_id"
    )


def view_metrics_today(metrics: DataFrame, runs: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Newest done run per brand and engine, per lens: folded over its repeat group with spreads, or on its
    own with deltas against the run before."""
    group = focus_group(runs)
    keys = [*SERIES, "focus_run_id", "group_id", "n_repeats", "lens"]
    rows = metrics.drop(*SERIES).join(group, "run_id")
    folded = fold_metrics(rows, keys, *_spread()).withColumnRenamed("focus_run_id", "run_id")
    grouped = _none(folded, DELTAS).withColumn("prev_run_id", F.lit(None).cast("bigint"))
    alone = latest_vs_previous(metrics, runs).join(
        group.select(*SERIES).distinct(), SERIES, "left_anti"
    )
    alone = alone.withColumns({f"{m}_delta": F.col(m) - F.col(f"{m}_prev") for m in SEVEN_METRICS})
    alone = _none(alone, SPREADS).withColumns(
        {"n_repeats": F.lit(1).cast("bigint"), "group_id": F.lit(None).cast("string")}
    )
    columns = [
        *SERIES, "run_id", "prev_run_id", "group_id", "n_repeats", "lens", *METRIC_COLUMNS, *DELTAS, *SPREADS,
    ]
    both = grouped.select(*columns).unionByName(alone.select(*columns))
    return with_sentiment_summary(both, sentiment)


def view_metrics_all(metrics: DataFrame, runs: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Whole period per brand, engine and lens, with the number of runs and the newest run's summaries."""
    latest = latest_completed_run(runs).select(*SERIES, "run_id")
    rows = period_rollup(metrics, runs).join(n_runs_done(runs), SERIES).join(latest, SERIES)
    return with_sentiment_summary(rows, sentiment)


def view_timeseries(metrics: DataFrame, runs: DataFrame, bucket: str = "run") -> DataFrame:
    """Points per done run, or folded per ISO week."""
    if bucket == "run":
        return trend_points(metrics, runs)
    if bucket == "week":
        return weekly_rollup(metrics, runs)
    raise ValueError("bucket must be 'run' or 'week'")


def view_competitors(
    board: DataFrame, metrics: DataFrame, runs: DataFrame, period: str = "today", sort: str = "sources",
    limit: int = 15,
) -> DataFrame:
    """Leaderboard with shares per brand, engine and lens, newest run or whole period."""
    if period == "all":
        rows = board_ops.leaderboard_period(board, runs)
        done = runs.where(F.col("status") == "done").select("run_id", *SERIES)
        base = metrics.drop(*SERIES).join(done, "run_id").groupBy(*SERIES, "lens").agg(
            F.sum("n_overviews").alias("n_overviews")
        )
        # a series may own a large part of the board: cut it up before joining its few totals
        shared = board_ops.add_shares(salted_join(rows, base, [*SERIES, "lens"], ["domain"], "left"))
    elif period == "today":
        latest = latest_completed_run(runs).select("run_id")
        focus = board.join(latest, "run_id", "left_semi")
        shared = board_ops.with_shares(focus, metrics)
    else:
        raise ValueError("period must be 'today' or 'all'")
    return board_ops.leaderboard_top(shared, sort, limit, (*SERIES, "lens"))


def view_engine_matrix(metrics: DataFrame, runs: DataFrame, period: str = "today", lens: str = ALL) -> DataFrame:
    return engine_matrix(metrics, runs, period, lens)


def view_results(captures: DataFrame, runs: DataFrame, lens: str | None = None) -> DataFrame:
    """Captures of every run in order; NULL flags and lists read as false and empty."""
    known = captures.join(runs.select("run_id"), "run_id", "left_semi")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("overview_present", "brand_in_answer_text")}
    none = F.array().cast("array<int>")
    lists = {c: F.coalesce(F.col(c), none) for c in ("target_source_ranks", "target_citation_ranks")}
    return results_in_order(known.withColumns({**flags, **lists}), lens)


def view_audit(brands: DataFrame, audits: DataFrame, strict_engine: bool = True) -> DataFrame:
    return brand_audit_join(brands, audits, strict_engine)


def view_lens_breakdown(metrics: DataFrame) -> DataFrame:
    """Known lenses of every run in order, the total last."""
    known = metrics.where(F.col("lens").isin("general", "branded", "comparative", ALL))
    return known.withColumn("place", lens_order(F.col("lens"), all_last=True)["place"]).orderBy("run_id", "place")
