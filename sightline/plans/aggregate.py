"""Metrics and leaderboard of runs out of one scan of their captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import best_rank
from ..operators.leaderboard import board_of_scopes, domain_places
from ..operators.metrics import STATE, metrics_of_scopes
from ..schemas import ALL
from ..session import scratch_path
from ..sources.tables import rebuild_domain_stats, rebuild_metrics

BOARD_STATE = ("appearances_sources", "appearances_citations", "sum_min_source_rank", "sum_min_citation_rank")


def scope_states(captures: DataFrame) -> DataFrame:
    """Additive state per (run, lens or ``all``) and per domain in it, as tagged rows of one aggregate.

    A capture makes one row for itself and, where its overview was shown, one for each domain and channel.  ``of_domain``
    tells the two kinds apart; each kind leaves the state of the other empty.  Map tasks fold the rows before the shuffle.
    """
    seen = F.coalesce(F.col("overview_present"), F.lit(False))
    place = "struct<of_domain: boolean, domain: string, source_rank: int, citation_rank: int>"
    itself = F.array(F.struct(F.lit(False), F.lit(None), F.lit(None), F.lit(None)).cast(place))
    domains = F.transform(domain_places(), lambda p: F.struct(F.lit(True), p["domain"], p["source_rank"], p["citation_rank"]).cast(place))
    rows = captures.select(
        "run_id", "lens", seen.alias("seen"),
        F.when(seen, best_rank(F.col("target_source_ranks"))).alias("best_source"),
        F.when(seen, best_rank(F.col("target_citation_ranks"))).alias("best_citation"),
        (seen & F.coalesce(F.col("brand_in_answer_text"), F.lit(False))).alias("named"),
        F.inline(F.concat(itself, F.when(seen, domains).otherwise(F.array().cast(f"array<{place}>")))),
    )
    own = ~F.col("of_domain")

    def total(column: Column | str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    lenses = rows.groupBy("run_id", "lens", "of_domain", "domain").agg(
        F.count_if(own).alias("n_queries"), F.count_if(own & F.col("seen")).alias("n_overviews"),
        F.count(F.when(own, F.col("best_source"))).alias("n_in_sources"), F.count(F.when(own, F.col("best_citation"))).alias("n_cited"),
        F.count_if(own & F.col("named")).alias("n_brand_mentions"),
        total(F.when(own, F.col("best_source"))).alias("sum_source_rank"), total(F.when(own, F.col("best_citation"))).alias("sum_citation_rank"),
        F.count("source_rank").alias("appearances_sources"), F.count("citation_rank").alias("appearances_citations"),
        total("source_rank").cast("double").alias("sum_min_source_rank"), total("citation_rank").cast("double").alias("sum_min_citation_rank"),
    )
    scoped = lenses.withColumn("lens", F.explode(F.array(F.col("lens"), F.lit(ALL))))
    return scoped.groupBy("run_id", "lens", "of_domain", "domain").agg(*[F.sum(c).alias(c) for c in (*STATE, *BOARD_STATE)])


def aggregate_runs(
    captures: DataFrame, runs: DataFrame, brands: DataFrame, metrics_path: str, stats_path: str
) -> tuple[DataFrame, DataFrame]:
    """Work out the metrics and leaderboard of ``runs`` anew and store both; returns what was stored.

    ``captures`` are read once: the states go to the scratch folder, and both tables are made from there.  Only captures
    of ``runs`` count.  A run without captures gets the empty ``all`` row and loses its leaderboard.
    """
    spark = captures.sparkSession
    path = scratch_path(spark, "scope-states")
    asked = captures.join(runs.select("run_id"), "run_id", "left_semi")
    found = scope_states(asked).withColumn("of_domain", F.col("of_domain").cast("int"))
    found.write.partitionBy("of_domain").parquet(path)
    states = spark.read.schema(found.schema).parquet(path)
    metrics = metrics_of_scopes(states.where("of_domain = 0").select("run_id", "lens", *STATE), runs)
    board = board_of_scopes(states.where("of_domain = 1").select("run_id", "lens", "domain", *BOARD_STATE), runs, brands)
    rebuild_metrics(metrics, metrics_path, runs)
    rebuild_domain_stats(board, stats_path, runs)
    return metrics, board
