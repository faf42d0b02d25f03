"""ISO weeks and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_as_written(stamp: Column) -> Column:
    """DATE of an ISO timestamp text at its own offset, whatever the session's zone; NULL for other texts."""
    text = F.trim(stamp)
    return F.when(F.try_to_timestamp(text).isNotNull() & F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_date(F.substring(text, 1, 10)))


def iso_week(ts: Column) -> Column:
    """``YYYY-Www`` of the ISO calendar; of a timestamp by its date in the session's zone."""
    return F.format_string(
        "%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts)
    )


def iso_week_monday(ts: Column) -> Column:
    """Monday of the ISO week as DATE."""
    return F.to_date(F.date_trunc("week", ts))


def is_fresh(ts: Column, now: Column, max_age_s: int) -> Column:
    """Age is at most ``max_age_s`` seconds; text that is no timestamp is never fresh."""
    seen = F.try_to_timestamp(ts.cast("string"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen)
    return F.coalesce(age <= F.lit(max_age_s * 1_000_000), F.lit(False))
