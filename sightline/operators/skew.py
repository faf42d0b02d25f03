"""Joins and top-k that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join a fact table to a table that is unique on the keys, with every key cut into ``salts`` parts.

    ``spread_by`` are columns of ``big`` that differ within a key.  The small side is repeated per salt, so
    a run that holds a third of all rows is worked on by ``salts`` tasks.  Whether the small side is sent
    to all executors instead is left to the size check of the planner.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", part).join(repeated, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    The rank is compared with a literal, so the planner limits each key to one row inside every map task
    before the shuffle: a hot key sends one row per task.
    """
    return top_per_key(df, keys, order, 1).drop("position")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every key with their ``position``; limited per map task as above."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= F.lit(k))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the row with the largest ``order``: a plain aggregate, combined map-side."""
    newest = F.max(F.struct(*[F.col(c) for c in [*order, *[k for k in keep if k not in order]]]))
    return df.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, *[F.col(f"_newest.{c}") for c in keep])
