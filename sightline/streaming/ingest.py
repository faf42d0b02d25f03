"""Continuous ingest of captures: validate, keep what is new, note what became of every row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.captures import CAPTURE_KEY
from ..operators.validation import checked_captures, ingest_outcomes
from ..schemas import RESULTS
from ..session import discard
from ..sources.tables import judge_captures, made_id, read_or_empty, row_place, stored_keys, write_captures

STREAM_LINE = "run_id LONG, index LONG, body STRING"


def ingest_batch(raw: DataFrame, out_dir: str, batch_no: int) -> None:
    """Store the new captures of a batch ``raw(run_id, index, raw VARIANT[, file])``.

    ``out_dir/results`` gets one row per (run, query, lens) ever sent; ``out_dir/outcomes`` says for every
    row of the batch whether it was stored, skipped or refused, and why.  A batch may be sent again in
    whole or part: outcomes of the same ``batch_no`` are replaced and what is stored already is skipped.
    The id of a capture is a hash of its run, query and lens, so it is the same whenever it is sent.
    """
    spark = raw.sparkSession
    results = f"{out_dir}/results"
    # every row is typed once; what is decided on afterwards are the keys and places only, and of the rows that are new the rest
    tag = uuid.uuid4().hex
    typed, fates = f"{out_dir}/_checked-{tag}", f"{out_dir}/_judged-{tag}"
    try:
        made = checked_captures(raw).withColumn("_row", F.monotonically_increasing_id())
        made.write.parquet(typed)
        checked = spark.read.schema(made.schema).parquet(typed)
        good = checked.where(F.col("error").isNull())
        bad = checked.where(F.col("error").isNotNull()).select(
            *row_place(checked), F.col("echoed_query").alias("query"), "error.field", "error.msg"
        )
        keys = good.select(*CAPTURE_KEY, *row_place(checked)[1:], "_row")
        judged = judge_captures(keys, stored_keys(spark, results, RESULTS, keys)).select(*row_place(checked), "_row", "new")
        # stored apart by fate: the planner then knows how few rows are new, and sends their numbers to the others' tasks if they are
        judged.write.partitionBy("new").parquet(fates)
        kind = judged.drop("new").schema
        inserted, skipped = (read_or_empty(spark, f"{fates}/new={new}", kind) for new in ("true", "false"))
        # outcomes first: once the captures are stored the same question has another answer
        ingest_outcomes(inserted, skipped, bad).withColumn("batch_no", F.lit(batch_no)).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(f"{out_dir}/outcomes")
        if not inserted.isEmpty():
            names = spark.createDataFrame([], RESULTS).columns
            rows = good.join(inserted.select("_row"), "_row").withColumn("id", made_id(*CAPTURE_KEY))
            write_captures(rows.select(*names), results)
    finally:
        discard(spark, typed)
        discard(spark, fates)


def stream_captures(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, *, available_now: bool = True,
    max_files: int = 1000,
) -> StreamingQuery:
    """Follow a folder of Parquet chunks (run_id, index, body JSON) and ingest each chunk once.

    A chunk that was half written when an executor or the driver was lost is worked on again; the keys
    already stored are skipped.
    """
    lines = spark.readStream.schema(STREAM_LINE).option("maxFilesPerTrigger", max_files).parquet(in_dir)
    raw = lines.select("run_id", F.col("_metadata.file_path").alias("file"), "index", F.try_parse_json("body").alias("raw"))

    def store(batch: DataFrame, batch_no: int) -> None:
        ingest_batch(batch, out_dir, batch_no)

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
