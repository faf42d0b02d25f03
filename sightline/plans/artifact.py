"""One document per run with everything known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_domain
from ..functions.compare import lens_order
from ..operators.audit.verdict import latest_audit
from ..operators.runs import runs_with_brand
from ..schemas import METRIC_COLUMNS
from ..sources.tables import RUN_BUCKETS, run_bucket

SCHEMA_VERSION = 1
PART_ROWS = 10_000

_RESULT_FIELDS = (
    "query", "lens", "captured_at", "overview_present", "sources", "citations", "target_source_ranks",
    "target_citation_ranks", "answer_text_md", "brand_in_answer_text", "sentiment", "screenshot_path",
)
_STAT_FIELDS = (
    "domain", "is_brand", "appearances_sources", "appearances_citations", "avg_source_position",
    "avg_citation_position",
)


def _by_lens(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Map lens to value per run, in lens order; a run has a handful of lenses."""
    entry = F.struct(lens_order(F.col("lens")).alias("place"), F.col("lens").alias("lens"), value.alias("value"))
    sorted_entries = F.sort_array(F.collect_list(entry))
    return df.groupBy("run_id").agg(
        F.map_from_entries(F.transform(sorted_entries, lambda e: F.struct(e["lens"], e["value"]))).alias(name)
    )


def _parts(rows: DataFrame, spread: str, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their part of the run's document, and the number of parts per run."""
    sizes = rows.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    cut = rows.join(sizes, "run_id").withColumn(
        "part", F.pmod(F.xxhash64(spread), F.col("_parts").cast("bigint")).cast("int")
    )
    return cut.drop("_parts"), sizes


def run_artifact(
    runs: DataFrame, brands: DataFrame, metrics: DataFrame, sentiment: DataFrame, results: DataFrame,
    stats: DataFrame, audits: DataFrame, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(run_id, part, n_parts, artifact STRUCT).

    A run of up to ``part_rows`` captures and leaderboard rows is one document.  A larger one is written
    as several parts of about that size, each whole in itself, so no row and no task holds a run of
    unbounded size and nothing is left out.  Part 0 has the metrics, summaries and audit.
    """
    header = runs_with_brand(runs, brands)
    newest = latest_audit(audits)
    audit_row = newest.select(
        F.col("domain").alias("_domain"), "engine", F.struct(*[c for c in newest.columns]).alias("audit")
    )
    results_cut, results_parts = _parts(results, "id", part_rows)
    stats_cut, stats_parts = _parts(stats, "domain", part_rows)
    n_parts = (
        results_parts.unionByName(stats_parts).groupBy("run_id").agg(F.max("_parts").alias("n_parts"))
    )
    result_lists = results_cut.groupBy("run_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("id", F.struct(*_RESULT_FIELDS).alias("r")))).alias("_r")
    )
    order = F.struct(
        lens_order(F.col("lens")).alias("lens_place"), (-F.col("appearances_sources")).alias("s"),
        (-F.col("appearances_citations")).alias("c"), F.col("domain").alias("name"),
        F.struct("lens", *_STAT_FIELDS).alias("d"),
    )
    stat_lists = stats_cut.groupBy("run_id", "part").agg(F.sort_array(F.collect_list(order)).alias("_d"))
    parts = (
        header.join(n_parts, "run_id", "left")
        .withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("_domain", normalize_domain(F.col("target")))
    )
    metric_map = _by_lens(metrics, F.struct(*METRIC_COLUMNS), "metrics")
    summary_map = _by_lens(sentiment, F.col("summary"), "lens_sentiment")
    rows = (
        parts.join(metric_map, "run_id", "left")
        .join(summary_map, "run_id", "left")
        .join(audit_row, ["_domain", "engine"], "left")
        .join(result_lists, ["run_id", "part"], "left")
        .join(stat_lists, ["run_id", "part"], "left")
    )
    first = F.col("part") == 0

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    artifact = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.col("run_id").alias("id"), "run_at", "status", "engine", "group_id",
            count("n_queries"), count("n_ok"), count("n_failed"),
        ).alias("run"),
        F.struct(F.col("brand_id").alias("id"), F.col("brand_name").alias("name"), "target").alias("brand"),
        F.when(first, F.col("metrics")).alias("metrics"),
        F.when(first, F.col("lens_sentiment")).alias("lens_sentiment"),
        F.coalesce(F.transform("_r", lambda x: x["r"]), F.array()).alias("results"),
        F.coalesce(F.transform("_d", lambda x: x["d"]), F.array()).alias("domain_stats"),
        F.when(first, F.col("audit")).alias("audit"),
    )
    return rows.select("run_id", "part", "n_parts", artifact.alias("artifact"))


def write_artifacts(artifacts: DataFrame, path: str, buckets: int = RUN_BUCKETS) -> None:
    """Documents as JSON lines in a fixed number of folders by run."""
    artifacts.select(
        "run_id", "part", "n_parts", F.to_json("artifact").alias("artifact"),
        run_bucket("run_id", buckets).alias("run_bucket"),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_bucket").json(path)
