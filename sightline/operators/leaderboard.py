"""The leaderboard of every domain seen in the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain_best_ranks, normalize_domain, ratio, weighted_mean
from ..schemas import ALL
from .metrics import overview_gate
from .skew import salted_join, top_per_key

_ADDITIVE = (
    "appearances_sources", "appearances_citations", "sum_min_source_rank", "sum_min_citation_rank",
)


def with_positions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "avg_source_position": weighted_mean(F.col("sum_min_source_rank"), F.col("appearances_sources")),
            "avg_citation_position": weighted_mean(
                F.col("sum_min_citation_rank"), F.col("appearances_citations")
            ),
        }
    )


def domain_places() -> Column:
    """Domains of an answer as (domain, source_rank, citation_rank), once for each channel, with the best rank there."""
    def tagged(channel: str) -> Column:
        return F.transform(
            domain_best_ranks(F.col(channel)),
            lambda p: F.struct(
                p["domain"].alias("domain"),
                (p["rank"] if channel == "sources" else F.lit(None).cast("int")).alias("source_rank"),
                (p["rank"] if channel == "citations" else F.lit(None).cast("int")).alias("citation_rank"),
            ),
        )

    none = F.array().cast("array<struct<domain: string, source_rank: int, citation_rank: int>>")
    return F.concat(F.coalesce(tagged("sources"), none), F.coalesce(tagged("citations"), none))


def domain_leaderboard(captures: DataFrame, runs: DataFrame, brands: DataFrame) -> DataFrame:
    """Appearances and rank sums per (run, lens or ``all``, domain) over shown overviews.

    A domain counts once per answer with its best rank.  That reduction happens inside the row, so only
    (run, lens, domain) sums leave a map task; ``all`` is added up from those sums.
    """
    rows = overview_gate(captures).select("run_id", "lens", F.inline(domain_places()))
    lenses = rows.groupBy("run_id", "lens", "domain").agg(
        F.count("source_rank").alias("appearances_sources"),
        F.count("citation_rank").alias("appearances_citations"),
        F.coalesce(F.sum("source_rank"), F.lit(0)).cast("double").alias("sum_min_source_rank"),
        F.coalesce(F.sum("citation_rank"), F.lit(0)).cast("double").alias("sum_min_citation_rank"),
    )
    scopes = (
        lenses.withColumn("lens", F.explode(F.array(F.col("lens"), F.lit(ALL))))
        .groupBy("run_id", "lens", "domain")
        .agg(*[F.sum(c).alias(c) for c in _ADDITIVE])
    )
    return board_of_scopes(scopes, runs, brands)


def board_of_scopes(scopes: DataFrame, runs: DataFrame, brands: DataFrame) -> DataFrame:
    """Leaderboard rows out of the additive state of each scope and domain."""
    owners = runs.select("run_id", "brand_id", "engine").join(
        brands.select("brand_id", normalize_domain(F.col("domain")).alias("brand_domain")), "brand_id", "left"
    )
    named = salted_join(scopes, owners, ["run_id"], ["domain"])
    return with_positions(
        named.withColumn("is_brand", F.coalesce(F.col("domain") == F.col("brand_domain"), F.lit(False)))
    ).select(
        "run_id", "brand_id", "engine", "lens", "domain", "is_brand", *_ADDITIVE,
        "avg_source_position", "avg_citation_position",
    )


def with_shares(board: DataFrame, metrics: DataFrame) -> DataFrame:
    """Share of the scope's overviews that hold the domain, per channel; NULL without overviews."""
    base = metrics.select("run_id", "lens", "n_overviews")
    joined = salted_join(board, base, ["run_id", "lens"], ["domain"], "left")
    return add_shares(joined)


def add_shares(board: DataFrame) -> DataFrame:
    return board.withColumns(
        {
            "share_sources": ratio(F.col("appearances_sources"), F.col("n_overviews")),
            "share_citations": ratio(F.col("appearances_citations"), F.col("n_overviews")),
        }
    )


leaderboard_shares = with_shares


def board_order(sort: str = "sources") -> list[Column]:
    """Most appearances in the chosen channel, then in the other one, then by name."""
    first, second = (
        ("appearances_citations", "appearances_sources")
        if sort == "citations"
        else ("appearances_sources", "appearances_citations")
    )
    return [F.desc(first), F.desc(second), F.asc("domain")]


def leaderboard_top(
    board: DataFrame, sort: str = "sources", k: int = 15, scope: tuple[str, ...] = ("run_id", "lens")
) -> DataFrame:
    """First k domains per scope with their position; k of 0 or less is the whole board, sorted."""
    if sort not in ("sources", "citations"):
        raise ValueError("sort must be 'sources' or 'citations'")
    if k <= 0:
        return board.orderBy(*scope, *board_order(sort))
    return top_per_key(board, list(scope), board_order(sort), k)


def top_domains(board: DataFrame, k: int = 10) -> DataFrame:
    """First k domains of each run over all lenses."""
    return leaderboard_top(board.where(F.col("lens") == ALL), "sources", k)


def top_cited_domains(board: DataFrame, k: int = 5, among: int = 15, scope=("run_id", "lens")) -> DataFrame:
    """Most cited domains of the first ``among`` of each board; without a position they come last."""
    shown = leaderboard_top(board, "sources", among, scope).drop("position")
    place = F.coalesce(F.nullif(F.col("avg_citation_position"), F.lit(0.0)), F.lit(999.0))
    return top_per_key(
        shown.where(F.col("appearances_citations") > 0),
        list(scope),
        [F.desc("appearances_citations"), place.asc(), F.asc("domain")],
        k,
    )


def leaderboard_resort(board: DataFrame, by: str, ascending: bool, scope=("run_id", "lens")) -> DataFrame:
    """A board sorted by any column: NULLs last when ascending, first when descending; ties by
    appearances, then name."""
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_first(by)
    return board.orderBy(*scope, key, F.desc("appearances_sources"), F.asc("domain"))


def leaderboard_period(board: DataFrame, runs: DataFrame) -> DataFrame:
    """The board of all done runs of a brand and engine, per lens and domain."""
    folded = (
        stats_of_done_runs(board, runs)
        .groupBy("brand_id", "engine", "lens", "domain")
        .agg(F.max("is_brand").alias("is_brand"), *[F.sum(c).alias(c) for c in _ADDITIVE])
    )
    return with_positions(folded)


def stats_of_done_runs(board: DataFrame, runs: DataFrame) -> DataFrame:
    """Leaderboard rows of done runs with the run's own brand and engine."""
    done = runs.where(F.col("status") == "done").select("run_id", "brand_id", "engine", "run_at")
    return salted_join(board.drop("brand_id", "engine"), done, ["run_id"], ["domain"])
