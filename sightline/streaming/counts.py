"""Stateful streams over arriving captures (run_id, query, lens, captured_at, overview_present, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import best_rank, iso_week, iso_week_monday
from ..operators.captures import CAPTURE_KEY
from ..operators.metrics import funnel_ratios
from ..operators.runs import SERIES, completed_only, run_day
from ..operators.skew import first_per_key
from ..schemas import ALL, METRIC_COLUMNS
from ..sources.tables import stored_keys, write_captures


def stream_dedupe(stream: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Store the first arrival per (run, query, lens), however late it comes.

    A batch is held against the keys that are stored already, so nothing is kept in state and nothing is
    dropped for its age; a batch that is worked on again finds its own rows stored.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def store(batch: DataFrame, batch_no: int) -> None:
        batch.persist()  # read for its folders, then for its rows
        try:
            known = stored_keys(batch.sparkSession, out_dir, columns, batch)
            firsts = first_per_key(batch, CAPTURE_KEY, [F.col("captured_at"), F.col("id")])
            write_captures(firsts.join(known, CAPTURE_KEY, "left_anti"), out_dir)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_live_counts(stream: DataFrame) -> DataFrame:
    """Captures so far per run; for update mode."""
    return stream.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_ok"))


def stream_weekly_trend(stream: DataFrame, runs: DataFrame) -> DataFrame:
    """The twelve measures per brand, engine, ISO week of the run and lens or ``all``, as captures arrive; for update mode.

    Equals ``weekly_rollup`` of the captures so far, whatever their order: the state of a group is whole numbers that add
    up and the set of its runs, so a capture of a resumed run counts in its run's week however late it comes.  Captures
    of runs that are not done are left out; a run counts from its first capture on.  ``runs`` is joined as it is when a
    batch starts.
    """
    done = completed_only(runs).select("run_id", *SERIES, iso_week(run_day(runs)).alias("week"), iso_week_monday(run_day(runs)).alias("monday"))
    seen = F.coalesce(F.col("overview_present"), F.lit(False))
    rows = stream.select(
        "run_id", F.explode(F.array(F.col("lens"), F.lit(ALL))).alias("lens"), seen.alias("seen"),
        F.when(seen, best_rank(F.col("target_source_ranks"))).alias("best_source"),
        F.when(seen, best_rank(F.col("target_citation_ranks"))).alias("best_citation"),
        (seen & F.coalesce(F.col("brand_in_answer_text"), F.lit(False))).alias("named"),
    ).join(done, "run_id")
    state = rows.groupBy(*SERIES, "lens", "week", "monday").agg(
        F.size(F.collect_set("run_id")).cast("bigint").alias("n_runs"),
        F.count(F.lit(1)).alias("n_queries"), F.count_if("seen").alias("n_overviews"), F.count("best_source").alias("n_in_sources"),
        F.count("best_citation").alias("n_cited"), F.count_if("named").alias("n_brand_mentions"),
        F.coalesce(F.sum("best_source"), F.lit(0)).alias("sum_source_rank"), F.coalesce(F.sum("best_citation"), F.lit(0)).alias("sum_citation_rank"),
    )
    return state.withColumns(funnel_ratios()).select(*SERIES, "lens", "week", "monday", "n_runs", *METRIC_COLUMNS)
