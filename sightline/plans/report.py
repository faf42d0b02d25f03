"""Everything a visibility report shows, as tables over all brands and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import delta_direction
from ..operators import leaderboard as board_ops
from ..operators.audit.verdict import audit_by_category, brand_audit_join
from ..operators.metrics import funnel_stages
from ..operators.outcomes import gap_list, outcome_counts, sentiment_samples
from ..operators.rollups import weekly_rollup
from ..operators.runs import SERIES, latest_completed_run, runs_with_metrics
from ..schemas import ALL, METRIC_COLUMNS, SEVEN_METRICS
from ..sources.dims import metric_defs_array
from .views import view_competitors, view_lens_breakdown, view_metrics_all, view_metrics_today


def metrics_long(today: DataFrame) -> DataFrame:
    """``view_metrics_today`` with one row per metric: value, previous value, spread and direction.

    The seven metric definitions are a literal of the row; nothing is joined.
    """
    values = F.array(
        *[
            F.struct(
                F.col(m).alias("value"), F.col(f"{m}_prev").alias("prev"), F.col(f"{m}_delta").alias("delta"),
                F.col(f"{m}_min").alias("low"), F.col(f"{m}_max").alias("high"),
            )
            for m in SEVEN_METRICS
        ]
    )
    defs = metric_defs_array()
    pairs = F.zip_with(defs, values, lambda d, v: F.struct(d.alias("d"), v.alias("v")))
    rows = today.select(*SERIES, "run_id", "n_repeats", "lens", F.explode(pairs).alias("p"))
    direction = delta_direction(
        F.col("p.v.value"), F.col("p.v.prev"), F.col("p.d.higher_is_better"), F.col("p.d.flat_below")
    )
    return rows.select(
        *SERIES, "run_id", "lens", "p.d.metric", "p.d.is_ratio", "p.v.value", "p.v.prev", "p.v.delta",
        "p.v.low", "p.v.high", F.when(F.col("n_repeats") == 1, direction).alias("direction"),
    )


def view_report_tables(
    runs: DataFrame, brands: DataFrame, metrics: DataFrame, sentiment: DataFrame, captures: DataFrame,
    board: DataFrame, audits: DataFrame, period: str = "today",
) -> dict[str, DataFrame]:
    """Report tables by name.  The focus of a brand and engine is its newest done run that has metrics.

    With the period ``all``, measures, lenses, funnel and leaderboard are folded over all done runs, under the id of the
    focus; there is nothing before them to compare with.  Answers are those of the focus in either period.
    """
    if period not in ("today", "all"):
        raise ValueError("period must be 'today' or 'all'")
    reported = runs_with_metrics(runs, metrics)
    focus = latest_completed_run(reported).select("run_id")

    def focused(df: DataFrame) -> DataFrame:
        return df.join(focus, "run_id", "left_semi")

    if period == "all":
        measured = view_metrics_all(metrics, reported, sentiment)
        none = {f"{m}_{part}": F.lit(None).cast("double") for m in SEVEN_METRICS for part in ("prev", "delta", "min", "max")}
        kpi = measured.withColumns({**none, "n_repeats": F.lit(1).cast("bigint")})
        measured = measured.select("run_id", *SERIES, "lens", *METRIC_COLUMNS)
    else:
        kpi, measured = view_metrics_today(metrics, reported, sentiment), focused(metrics)
    shown = view_competitors(board.where(F.col("lens") == ALL), metrics, reported, period, "sources", 15)
    return {
        "kpi": metrics_long(kpi.where(F.col("lens") == ALL)),
        "lenses": view_lens_breakdown(measured),
        "funnel": funnel_stages(measured.where(F.col("lens") == ALL)),
        "weekly": weekly_rollup(metrics, reported).where(F.col("lens") == ALL),
        "leaderboard": shown,
        "top_cited": board_ops.top_cited_domains(shown.drop("position"), 5, 15, (*SERIES, "lens")),
        "samples": sentiment_samples(focused(captures)),
        "outcomes": outcome_counts(focused(captures)),
        "gaps": gap_list(focused(captures)),
        "audit": audit_by_category(
            brand_audit_join(brands, audits).where(F.col("audit_id").isNotNull())
        ),
    }
