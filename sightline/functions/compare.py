"""Ratios, outcomes, deltas and display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LENSES


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE; NULL, never 0, when the whole is 0 or unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def weighted_mean(total: Column, weight: Column) -> Column:
    return ratio(total, weight)


def outcome_of(overview: Column, source_ranks: Column, citation_ranks: Column, mention: Column) -> Column:
    """The one outcome of a capture; the first rule that holds wins."""
    return (
        F.when(~F.coalesce(overview, F.lit(False)), "no_answer")
        .when(F.coalesce(F.size(citation_ranks), F.lit(0)) > 0, "cited")
        .when(F.coalesce(F.size(source_ranks), F.lit(0)) > 0, "sources_only")
        .when(F.coalesce(mention, F.lit(False)), "mention_only")
        .otherwise("absent")
    )


def delta_direction(cur: Column, prev: Column, higher_is_better: Column, threshold: Column) -> Column:
    """How a value moved: none, new, no_data, flat, improved or worse."""
    diff = cur - prev
    return (
        F.when(cur.isNull() & prev.isNull(), "none")
        .when(prev.isNull(), "new")
        .when(cur.isNull(), "no_data")
        .when(F.abs(diff) < threshold, "flat")
        .when((diff > 0) == higher_is_better, "improved")
        .otherwise("worse")
    )


def lens_order(lens: Column, all_last: bool = False) -> Column:
    """Sort key of a lens: all, general, branded, comparative, then unknown ones by name.

    ``all_last`` is the order of the breakdown table, where the total is the last row.
    """
    ranked = F.when(lens == "all", F.lit(50 if all_last else 0))
    for place, name in enumerate(LENSES, start=1):
        ranked = ranked.when(lens == name, F.lit(place))
    return F.struct(ranked.otherwise(F.lit(99)).alias("place"), lens.alias("lens"))
