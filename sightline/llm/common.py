"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import discard, scratch_path  # noqa: F401

ROWS_AT_ONCE = 1000


ROWS_IN_BATCH = "10000", "1000"  # Spark's own, and what suits rows that hold whole documents


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver found it, and be sent documents in small batches.

    A batch size that the user has set is left alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_IN_BATCH[0]) == ROWS_IN_BATCH[0]:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_IN_BATCH[1])
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go as soon as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


HOT_SHARE = 1024


def joined_counts(rows: DataFrame, counts: DataFrame, keys: list[str], n_rows: str, total: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``counts``, which has one row for each key; null keys are equal.

    ``n_rows`` of ``counts`` says how many of the ``total`` rows hold the key.  A key with more than 1 / HOT_SHARE of them
    meets a broadcast, of fewer than HOT_SHARE rows; its own rows are then dealt by ``spread``, so that no task gets all.
    """
    made = [c for c in counts.columns if c not in keys]
    shared = counts.withColumn("__hot", F.col(n_rows) * HOT_SHARE > total)

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{mark}{c}") for c in df.columns])

    def equal(left: DataFrame, right: DataFrame, mark: str) -> Column:
        return reduce(and_, [left[k].eqNullSafe(right[f"{mark}{k}"]) for k in keys])

    hot, rest = renamed(shared.where("__hot"), "__h_"), renamed(shared.where("NOT __hot"), "__r_").withColumn("__r_deal", F.lit(0))
    found = rows.join(F.broadcast(hot), equal(rows, hot, "__h_"), "left")
    met = F.col("__h___hot").isNotNull()
    found = found.withColumn("__deal", F.when(met, 1 + F.pmod(F.xxhash64(spread), F.lit(HOT_SHARE))).otherwise(0).cast("int"))
    both = found.join(rest, equal(found, rest, "__r_") & (F.col("__deal") == F.col("__r_deal")), "left")
    values = [F.when(met, F.col(f"__h_{c}")).otherwise(F.col(f"__r_{c}")).alias(c) for c in made]
    return both.select(*[both[c] for c in rows.columns], *values)


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text, the number that deals rows to folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def per_row(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[list]]],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One output row for each input row, made from its whole text in Arrow batches.

    ``make()`` runs once in a task and returns a function from a list of texts (or None) to a list of columns.
    ``keep`` names further input columns that are passed on unchanged.
    """
    names = [id_col, *keep]
    schema = T.StructType([field(df, n) for n in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = work(part.column(len(names)).to_pylist())
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                arrays += [pa.array(c, type=arrow.field(len(names) + i).type) for i, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """Something costly that a worker process keeps over its tasks; only the last one, so that caches do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Bounded(dict):
    """A cache that forgets the older half of its entries when it is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self) -> None:
        if len(self) > self.limit:
            for key in list(self)[: len(self) - self.limit // 2]:
                del self[key]
