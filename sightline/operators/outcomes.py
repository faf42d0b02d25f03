"""Outcomes of captures, gaps and sentiment samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outcome_of, split_phrase_text
from ..functions.text import strip_ws
from ..schemas import ALL, OUTCOMES
from .skew import top_per_key


def with_outcome(captures: DataFrame) -> DataFrame:
    return captures.withColumn(
        "outcome",
        outcome_of(
            F.col("overview_present"), F.col("target_source_ranks"), F.col("target_citation_ranks"),
            F.col("brand_in_answer_text"),
        ),
    )


def outcome_counts(captures: DataFrame) -> DataFrame:
    """Captures per run and outcome, zero where there are none, and over all."""
    return (
        with_outcome(captures)
        .groupBy("run_id")
        .agg(
            *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
            F.count(F.lit(1)).alias(ALL),
        )
    )


def results_by_outcome(captures: DataFrame) -> DataFrame:
    """Captures with their outcome, in the fixed order of outcomes within a run."""
    rank = F.coalesce(*[F.when(F.col("outcome") == o, F.lit(i)) for i, o in enumerate(OUTCOMES)])
    return (
        with_outcome(captures)
        .withColumn("outcome_rank", rank)
        .orderBy("run_id", "outcome_rank", "id")
    )


def gap_list(captures: DataFrame) -> DataFrame:
    """Questions whose overview was shown and does not know the brand at all."""
    return with_outcome(captures).where(F.col("outcome") == "absent").select(
        "run_id", "id", strip_ws(F.coalesce("query", F.lit(""))).alias("query"), "lens"
    )


def sentiment_samples(captures: DataFrame, k: int = 4) -> DataFrame:
    """The newest k different phrases per run and lens, each with the question of its newest capture.

    Phrases are made distinct by an aggregate first; the top-k then moves at most k rows per task and key.
    """
    phrases = (
        captures.select(
            "run_id", "lens", "captured_at", "id", "query", split_phrase_text(F.col("sentiment")).alias("phrase")
        )
        .where(F.col("phrase").isNotNull())
        .groupBy("run_id", "lens", "phrase")
        .agg(F.max(F.struct("captured_at", "id", "query")).alias("newest"))
    )
    return top_per_key(
        phrases, ["run_id", "lens"], [F.desc("newest.captured_at"), F.desc("newest.id")], k
    ).select(
        "run_id", "lens", "position", "phrase", strip_ws(F.coalesce("newest.query", F.lit(""))).alias("query")
    )


def results_in_order(captures: DataFrame, lens: str | None = None) -> DataFrame:
    """Captures of every run by id, of one lens if asked."""
    rows = captures if lens is None else captures.where(F.col("lens") == lens)
    return rows.orderBy("run_id", "id")
