"""Selecting runs: latest, previous, resumed, with metrics; and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_brand_name, normalize_target
from ..functions.text import brand_match_key
from .skew import first_per_key, latest_per_key

SERIES = ["brand_id", "engine"]


def completed_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "done")


def runs_with_brand(runs: DataFrame, brands: DataFrame) -> DataFrame:
    """Runs with the name and target of their brand; brands go to all executors only if small enough."""
    return runs.join(
        brands.select("brand_id", F.col("name").alias("brand_name"), F.col("domain").alias("target")),
        "brand_id",
    )


def run_day(runs: DataFrame) -> Column:
    """Date of a run at the offset its time was given in, where the table keeps it (``run_day``); else by the session's zone."""
    day = F.to_date("run_at")
    return F.coalesce(F.col("run_day"), day) if "run_day" in runs.columns else day


def metrics_of_done_runs(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows of done runs, with run time, repeat tag and the run's own day if the table keeps it."""
    kept = [c for c in ("run_day",) if c in runs.columns]
    done = completed_only(runs).select("run_id", "brand_id", "engine", "run_at", "group_id", *kept)
    return metrics.drop("brand_id", "engine").join(done, "run_id")


def runs_with_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Done runs that have any metric row."""
    return completed_only(runs).join(metrics.select("run_id"), "run_id", "left_semi")


def engines_without_metrics(requested: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requested (brand_id, engine) pairs no report can be made for."""
    return requested.join(runs_with_metrics(runs, metrics), SERIES, "left_anti").select(*SERIES)


def distinct_engines(runs: DataFrame) -> DataFrame:
    """Engines of every brand, with whether any of their runs is done."""
    return runs.groupBy(*SERIES).agg(F.bool_or(F.col("status") == "done").alias("any_done"))


def n_runs_done(runs: DataFrame) -> DataFrame:
    return completed_only(runs).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_runs"))


def latest_completed_run(runs: DataFrame) -> DataFrame:
    """Newest done run per brand and engine, by time, then id."""
    return latest_per_key(
        completed_only(runs), SERIES, ["run_at", "run_id"], ["run_id", "run_at", "group_id"]
    )


def latest_and_previous(runs: DataFrame) -> DataFrame:
    """Newest done run per series with the done run before it (NULL for a first run).

    Two map-side maxima instead of a sort of the whole series.
    """
    done = completed_only(runs)
    latest = latest_completed_run(runs)
    cut = latest.select(*SERIES, F.struct("run_at", "run_id").alias("_cut"))
    before = done.join(cut, SERIES).where(F.struct("run_at", "run_id") < F.col("_cut"))
    previous = latest_per_key(before, SERIES, ["run_at", "run_id"], ["run_id", "run_at"]).select(
        *SERIES, F.col("run_id").alias("prev_run_id"), F.col("run_at").alias("prev_run_at")
    )
    return latest.join(previous, SERIES, "left")


def previous_completed_run(runs: DataFrame) -> DataFrame:
    """Every done run with the done run just before it in its series.

    The series is cut into days.  Inside a day a window looks back; the first run of a day takes the last
    run of the day before that has one, out of a table of day ends.  So no task sorts more of a long
    series than one day of it, plus its list of days.
    """
    done = completed_only(runs).select("run_id", *SERIES, "run_at").withColumn("_day", F.to_date("run_at"))
    order = [F.col("run_at"), F.col("run_id")]
    inside = done.withColumn(
        "_before", F.lag(F.struct("run_at", "run_id")).over(Window.partitionBy(*SERIES, "_day").orderBy(*order))
    )
    day_ends = done.groupBy(*SERIES, "_day").agg(F.max(F.struct("run_at", "run_id")).alias("_end"))
    day_before = day_ends.select(
        *SERIES, "_day", F.lag("_end").over(Window.partitionBy(*SERIES).orderBy("_day")).alias("_day_before")
    )
    return inside.join(day_before, [*SERIES, "_day"], "left").select(
        "run_id", *SERIES, "run_at",
        F.coalesce(F.col("_before.run_id"), F.col("_day_before.run_id")).alias("prev_run_id"),
    )


def group_run_ids(runs: DataFrame) -> DataFrame:
    """Done runs of every repeat group, one row each, with the size of the group; order by run_at, run_id."""
    members = completed_only(runs).where(F.coalesce(F.col("group_id"), F.lit("")) != "")
    sizes = members.groupBy(*SERIES, "group_id").agg(F.count(F.lit(1)).alias("n_repeats"))
    return members.select(*SERIES, "group_id", "run_id", "run_at").join(sizes, [*SERIES, "group_id"])


def runs_newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy("brand_id", F.desc("run_at"), F.desc("run_id"))


def brands_by_name(brands: DataFrame) -> DataFrame:
    return brands.orderBy(F.lower("name"), "brand_id")


def resolve_brand(brands: DataFrame, requested: DataFrame) -> DataFrame:
    """Requests (request_id, name, domain) to brand ids: the exact name on the domain first, then the same
    name up to case.  Where the domain is unknown for the name, the domains it is known for are listed."""
    known = brands.select(
        "brand_id",
        F.col("name").alias("known_name"),
        F.col("domain").alias("target"),
        brand_match_key(F.col("name")).alias("match_key"),
    )
    asked = requested.select(
        "request_id",
        normalize_brand_name(F.col("name")).alias("asked_name"),
        normalize_target(F.col("domain")).alias("target"),
        brand_match_key(F.col("name")).alias("match_key"),
    )
    hits = first_per_key(
        asked.join(known, ["target", "match_key"]),
        ["request_id"],
        [F.desc(F.col("known_name") == F.col("asked_name")), F.asc("brand_id")],
    ).select("request_id", "brand_id")
    # a name has a handful of domains; the list is part of the answer
    elsewhere = known.groupBy("match_key").agg(
        F.array_join(F.sort_array(F.collect_set("target")), ", ").alias("known_domains")
    )
    return (
        asked.join(hits, "request_id", "left")
        .join(elsewhere, "match_key", "left")
        .select(
            "request_id", "brand_id",
            F.when(F.col("brand_id").isNull(), F.col("known_domains")).alias("known_domains"),
        )
    )
