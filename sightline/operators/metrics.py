"""The seven metrics of a run, and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import best_rank, ratio, weighted_mean
from ..schemas import ALL, COUNT_METRICS, METRIC_COLUMNS

# additive state of a scope: everything else is derived from it, so scopes can be added up
STATE = (*COUNT_METRICS, "sum_source_rank", "sum_citation_rank")


def overview_gate(captures: DataFrame) -> DataFrame:
    """Captures whose overview was shown: the denominator of all visibility metrics."""
    return captures.where(F.coalesce(F.col("overview_present"), F.lit(False)))


def scope_state(captures: DataFrame) -> DataFrame:
    """Additive state per (run, lens).

    The scan keeps two rank arrays and three flags; each map task folds them to a few numbers per run and
    lens before the only shuffle, so a run that holds a third of the captures costs no more than another.
    """
    seen = F.coalesce(F.col("overview_present"), F.lit(False))
    rows = captures.select(
        "run_id",
        "lens",
        seen.alias("seen"),
        F.when(seen, best_rank(F.col("target_source_ranks"))).alias("best_source"),
        F.when(seen, best_rank(F.col("target_citation_ranks"))).alias("best_citation"),
        (seen & F.coalesce(F.col("brand_in_answer_text"), F.lit(False))).alias("named"),
    )
    return rows.groupBy("run_id", "lens").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("seen")).alias("n_overviews"),
        F.count("best_source").alias("n_in_sources"),
        F.count("best_citation").alias("n_cited"),
        F.count_if(F.col("named")).alias("n_brand_mentions"),
        F.coalesce(F.sum("best_source"), F.lit(0)).alias("sum_source_rank"),
        F.coalesce(F.sum("best_citation"), F.lit(0)).alias("sum_citation_rank"),
    )


def funnel_ratios(mentions_base: Column | None = None) -> dict[str, Column]:
    """The seven metrics out of additive state columns."""
    c = F.col
    return {
        "overview_coverage": ratio(c("n_overviews"), c("n_queries")),
        "visibility_in_sources": ratio(c("n_in_sources"), c("n_overviews")),
        "visibility_in_citations": ratio(c("n_cited"), c("n_overviews")),
        "relative_citation": ratio(c("n_cited"), c("n_in_sources")),
        "brand_mention_rate": ratio(
            c("n_brand_mentions"), c("n_overviews") if mentions_base is None else mentions_base
        ),
        "avg_source_position": weighted_mean(c("sum_source_rank"), c("n_in_sources")),
        "avg_citation_position": weighted_mean(c("sum_citation_rank"), c("n_cited")),
    }


def run_metrics(captures: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts and metrics per run for every lens it has, and for ``all``; ``all`` also for empty runs.

    ``all`` is added up from the lens states, which is exact because the state is whole numbers, so the
    captures are read once and are not doubled by grouping sets.
    """
    lenses = scope_state(captures)
    scoped = lenses.withColumn("lens", F.explode(F.array(F.col("lens"), F.lit(ALL))))
    return metrics_of_scopes(scoped.groupBy("run_id", "lens").agg(*[F.sum(s).alias(s) for s in STATE]), runs)


def metrics_of_scopes(scopes: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows out of the additive state of each scope."""
    every_run = runs.select("run_id", "brand_id", "engine").join(scopes, "run_id", "left")
    filled = every_run.select(
        "run_id", "brand_id", "engine",
        F.coalesce("lens", F.lit(ALL)).alias("lens"),
        *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in STATE],
    )
    return filled.withColumns(funnel_ratios()).select("run_id", "brand_id", "engine", "lens", *METRIC_COLUMNS)


def funnel_stages(metrics: DataFrame) -> DataFrame:
    """Funnel bars: count and width per stage, and whether the stages only ever narrow."""
    stages = F.array(
        *[
            F.struct(F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"), F.col(col).alias("stage_count"))
            for i, (stage, col) in enumerate(
                (("overview", "n_overviews"), ("sources", "n_in_sources"), ("cited", "n_cited")), start=1
            )
        ]
    )
    narrowing = (
        (F.col("n_cited") <= F.col("n_in_sources"))
        & (F.col("n_in_sources") <= F.col("n_overviews"))
        & (F.col("n_overviews") <= F.col("n_queries"))
    )
    base = F.greatest(F.col("n_overviews"), F.lit(1))
    return metrics.select(
        "run_id", "lens", base.alias("base"), narrowing.alias("narrowing"), F.inline(stages)
    ).select(
        "run_id", "lens", "stage_no", "stage", "stage_count",
        ratio(F.col("stage_count"), F.col("base")).alias("width"), "narrowing",
    )
