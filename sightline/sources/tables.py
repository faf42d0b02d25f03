"""Tables on Parquet: reading, idempotent appends and per-run replacement."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import day_as_written, normalize_target
from ..functions.text import brand_match_key, normalize_brand_name
from ..operators.captures import CAPTURE_KEY
from ..operators.skew import first_per_key
from .arrays import read_array
from ..schemas import ALL, AUDITS, DOMAIN_STATS, FETCH_KINDS, LENS_SENTIMENT, LENSES, METRICS, QUESTIONS

# Tables keyed by run are stored in a fixed number of folders, not one per run: millions of runs with a
# few metric rows each would otherwise be millions of tiny files.
RUN_BUCKETS = 64


def run_bucket(run_id: Column | str, buckets: int = RUN_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture objects of JSON array files as (file, index, raw VARIANT), whatever the size of a file.

    A file that holds no array gives one row with its own value and index -1; quarantine reports it.
    """
    return read_array(spark, path)


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """Capture objects, one per line: the form that splits over tasks.  Lines that are no JSON give NULL."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("raw"))


_CSV = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).options(**_CSV, multiLine=True).csv(path)


def write_questions(df: DataFrame, path: str) -> None:
    df.select("query", "lens").write.mode("overwrite").options(**_CSV).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table with the expected columns: a missing table is empty, a missing column NULL."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return table.select(*spark.createDataFrame([], schema).columns)


def row_place(batch: DataFrame) -> list[str]:
    """The columns that name a row of a batch: the run, its file if known, and the place in that."""
    return [c for c in ("run_id", "file", "index") if c in batch.columns]


def append_captures(batch: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows to skip) of a batch: the first of each (run, query, lens) that is not stored.

    ``batch`` has run_id, index and the capture columns; where several chunks of a run may come together, ``file``
    says which chunk ``index`` counts in.  Only keys of ``results`` are read.
    """
    names = row_place(batch)
    judged = judge_captures(batch, results)
    return judged.where("new").drop("new"), judged.where("NOT new").select(*names)


def judge_captures(batch: DataFrame, results: DataFrame) -> DataFrame:
    """The batch with ``new``: whether the row is the first of its (run, query, lens) and that is not stored; in one pass."""
    first = F.row_number().over(Window.partitionBy(*CAPTURE_KEY).orderBy(*row_place(batch)[1:])) == 1
    known = results.select(*CAPTURE_KEY).distinct().withColumn("_known", F.lit(True))
    judged = batch.withColumn("_first", first).join(known, list(CAPTURE_KEY), "left")
    return judged.select(*batch.columns, (F.col("_first") & F.col("_known").isNull()).alias("new"))


def stored_keys(spark: SparkSession, path: str, schema: str, batch: DataFrame) -> DataFrame:
    """Keys of the stored captures that can collide with a batch: only its folders are read.

    The folders a batch touches, at most RUN_BUCKETS numbers, go into the filter as literals, so the scan lists no other.
    """
    touched = [r[0] for r in batch.select(run_bucket("run_id")).distinct().collect()]
    stored = read_or_empty(spark, path, schema + ", run_bucket INT")
    return stored.where(F.col("run_bucket").isin(touched) if touched else F.lit(False)).select(*CAPTURE_KEY)


def write_captures(rows: DataFrame, path: str) -> None:
    """Append captures to their folders; tasks get whole folders or parts of large ones, so few files come of many tasks."""
    placed = rows.withColumn("run_bucket", run_bucket("run_id")).hint("rebalance", F.col("run_bucket"))
    placed.write.mode("append").partitionBy("run_bucket").parquet(path)


# Tables that are worked out anew run by run hold generations.  ``rows`` gets the rows of the runs at hand, ``state``
# afterwards one row for each of these runs, also for those without rows.  Of a run the newest generation that ``state``
# names counts.  Nothing is overwritten: what a rebuild costs follows the runs at hand, and one that is cut short leaves
# rows that nothing names.
STATE = "run_id LONG, generation LONG, batch STRING"


def _newest(spark: SparkSession, path: str) -> DataFrame:
    state = read_or_empty(spark, f"{path}/state", STATE)
    newest = F.max(F.struct("generation", "batch")).alias("newest")
    return state.groupBy(F.col("run_id").alias("of_run")).agg(newest).select("of_run", "newest.*")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that count of a table kept by ``rebuild_metrics`` or ``rebuild_domain_stats``; an emptied run has none."""
    newest = _newest(spark, path).select("of_run", F.col("generation").alias("newest_generation"), F.col("batch").alias("newest_batch"))
    rows = read_or_empty(spark, f"{path}/rows", schema + ", generation LONG, batch STRING")
    met = (
        (F.col("run_id") == F.col("of_run")) & (F.col("generation") == F.col("newest_generation")) & (F.col("batch") == F.col("newest_batch"))
    )
    return rows.join(newest, met).select(*[c for c in rows.columns if c not in ("generation", "batch")])


def _replace_runs(rows: DataFrame, path: str, schema: str, runs: DataFrame | None) -> None:
    """A new generation of the runs given, or of those that have rows."""
    spark = rows.sparkSession
    last = read_or_empty(spark, f"{path}/state", STATE).agg(F.max("generation")).first()[0]
    generation, batch = (last or 0) + 1, uuid.uuid4().hex  # of two writers at once the names differ, and one wins whole
    names = spark.createDataFrame([], schema).columns
    made = rows.select(*names).withColumn("batch", F.lit(batch)).withColumn("generation", F.lit(generation).cast("bigint"))
    # sorted, so that the statistics of a file tell a reader of some runs what to leave out
    made.hint("rebalance").sortWithinPartitions("run_id").write.mode("append").partitionBy("generation").parquet(f"{path}/rows")
    written = spark.read.schema(schema + ", generation LONG, batch STRING").parquet(f"{path}/rows") if runs is None else None
    of = runs if runs is not None else written.where((F.col("generation") == generation) & (F.col("batch") == batch))
    of.select("run_id").distinct().select(
        F.col("run_id").cast("bigint").alias("run_id"), F.lit(generation).cast("bigint").alias("generation"), F.lit(batch).alias("batch")
    ).write.mode("append").parquet(f"{path}/state")


def compact_runs(spark: SparkSession, path: str, schema: str, to: str) -> None:
    """The rows that count as one generation of another table, without what they replaced."""
    _replace_runs(read_runs(spark, path, schema), to, schema, _newest(spark, path).select(F.col("of_run").alias("run_id")))


def rebuild_metrics(metrics: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Store metric rows, replacing those of the same runs (or of all ``runs``)."""
    _replace_runs(metrics, path, METRICS, runs)


def rebuild_domain_stats(stats: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Store leaderboard rows; with ``runs`` a run that has none any more loses its old ones."""
    _replace_runs(stats, path, DOMAIN_STATS, runs)


def append_audits(audits: DataFrame, path: str) -> None:
    columns = audits.sparkSession.createDataFrame([], AUDITS).columns
    audits.select(*columns).write.mode("append").parquet(path)


def upsert_lens_sentiment(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest summary per (run, lens); unknown lenses are left out, a NULL summary replaces too."""
    columns = current.sparkSession.createDataFrame([], LENS_SENTIMENT).columns
    news = updates.where(F.col("lens").isin(*LENSES, ALL)).select(*columns).withColumn("_new", F.lit(1))
    both = current.select(*columns).withColumn("_new", F.lit(0)).unionByName(news)
    return first_per_key(
        both, ["run_id", "lens"], [F.desc("_new"), F.desc("computed_at")]
    ).select(*columns)


def made_id(*parts: Column | str) -> Column:
    """An id that any task makes alike from what names the row, so a repeated job makes no second row."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def upsert_brands(brands: DataFrame, requested: DataFrame) -> DataFrame:
    """Brands with those requested (name, domain) that are not known yet; case of the name does not count."""
    asked = requested.select(
        normalize_brand_name(F.col("name")).alias("name"),
        normalize_target(F.col("domain")).alias("domain"),
        brand_match_key(F.col("name")).alias("match_key"),
        (F.col("requested_at") if "requested_at" in requested.columns else F.current_timestamp()).alias(
            "created_at"
        ),
    )
    known = brands.select("domain", brand_match_key(F.col("name")).alias("match_key"))
    fresh = first_per_key(
        asked.join(known, ["domain", "match_key"], "left_anti"),
        ["domain", "match_key"],
        [F.col("created_at"), F.col("name")],
    ).select(made_id("domain", "match_key").alias("brand_id"), "name", "domain", "created_at")
    return brands.select("brand_id", "name", "domain", "created_at").unionByName(fresh)


def open_runs(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs with one new running run per request (brand_id, engine, run_at, group_id).

    Where ``run_at`` of the requests is text, the day it names at its own offset is kept beside the instant
    (``run_day``), so that the run stays in its week whatever zone a session has; runs from before have none.
    """
    none = F.lit(None)
    if isinstance(requests.schema["run_at"].dataType, StringType):
        requests = requests.withColumns({"run_at": F.try_to_timestamp(F.trim("run_at")), "run_day": day_as_written(F.col("run_at"))})
    if "run_day" in requests.columns and "run_day" not in runs.columns:
        runs = runs.withColumn("run_day", none.cast("date"))
    day = [F.col("run_day") if "run_day" in requests.columns else none.cast("date").alias("run_day")] if "run_day" in runs.columns else []
    fresh = requests.select(
        made_id("brand_id", "engine", "run_at", F.coalesce("group_id", F.lit(""))).alias("run_id"),
        "brand_id", "engine", "run_at", F.lit("running").alias("status"),
        none.cast("int").alias("n_queries"), none.cast("int").alias("n_ok"), none.cast("int").alias("n_failed"),
        "group_id", *day,
    )
    return runs.select(*fresh.columns).unionByName(fresh)


def update_run_counts(runs: DataFrame, patch: DataFrame) -> DataFrame:
    """Runs with the fields a patch names; NULL in the patch leaves a field as it is, 0 is a value."""
    fields = [c for c in ("n_queries", "n_ok", "n_failed", "status") if c in patch.columns]
    news = patch.select("run_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return runs.join(news, "run_id", "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).cast(runs.schema[c].dataType).alias(c) if c in fields else F.col(c)
            for c in runs.columns
        ]
    )


def latest_site_fetch(site_fetch: DataFrame) -> DataFrame:
    """Newest response of each kind, one row per target.

    For whole audits prefer ``audit_sites``, which reads what it needs out of a page before the shuffle.
    """
    response = F.struct("url", "final_url", "status", "text", "redirects", "scheme", "error")
    return site_fetch.groupBy("target").agg(
        F.max("checked_at").alias("checked_at"),
        *[
            F.max_by(
                F.when(F.col("kind") == kind, response), F.when(F.col("kind") == kind, F.col("checked_at"))
            ).alias(kind)
            for kind in FETCH_KINDS
        ],
    )
