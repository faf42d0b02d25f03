"""Removal of repeated passages of three lines or more.

Every three lines that follow each other are a window, windows overlap.  A window that occurs again anywhere, in the
same text or in another, keeps its first place (by id, then by line); at its later places its lines are covered, and
covered lines go.  Windows are compared by 128 bits of hashes of their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SPAN = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_lines, n_removed, text) for each row, the text without the lines of later occurrences.

    Lines end at a line feed.  Texts of fewer than three lines stay as they are, also empty ones; null stays null with
    0 lines.  Windows of blank lines do not count.  Where an occurrence overlaps the first one in the same text, only
    what is beyond the first goes.  Rows that share id and text count as one text and get the same result; a null id
    comes before all others.  An empty table gives an empty one; further columns are ignored.
    """
    kept_columns = F.struct(F.lit(0).alias("_"), *keep)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), kept_columns.alias("kept"))
    keyed = rows.select("id", F.xxhash64("t").alias("th"), F.split("t", "\n").alias("lines"), F.col("t").isNull().alias("none"), "kept")
    last = F.size("lines") - SPAN

    def window(i):
        three = [F.get("lines", i + k) for k in range(SPAN)]
        return F.when(
            F.length(F.trim(F.concat(*three))) > 0,
            F.struct(i.alias("pos"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(7), *three).alias("h2")),
        )

    windows = (
        keyed.where(last >= 0)
        .select("id", "th", F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("w"))
        .where(F.col("w").isNotNull())
        .select("id", "th", "w.pos", "w.h1", "w.h2")
    )
    windows = stored(windows, "windows")
    place = F.struct("id", "th", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end")
    later = windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("first") != place)
    same = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th"))
    begin = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + SPAN)).otherwise(F.col("pos"))
    covers = (
        later.select("id", "th", begin.alias("begin"), (F.col("pos") + SPAN - 1).alias("stop"))
        .where("begin <= stop")
        .groupBy(F.col("id").alias("cid"), F.col("th").alias("cth"))
        .agg(F.collect_set(F.struct("begin", "stop")).alias("covers"))
    )
    met = keyed.join(covers, keyed["id"].eqNullSafe(covers["cid"]) & (keyed["th"] == covers["cth"]), "left")
    covered = F.flatten(F.transform("covers", lambda c: F.sequence(c["begin"], c["stop"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("none"), F.lit(None).cast("string")).when(F.col("covers").isNull(), F.array_join("lines", "\n")).otherwise(text)
    n_lines = F.when(F.col("none"), 0).otherwise(F.size("lines"))
    removed = F.when(F.col("covers").isNull(), 0).otherwise(F.size("lines") - F.size(kept))
    return met.select(
        F.col("id").alias(id_col), *(F.col(f"kept.{c}").alias(c) for c in keep), n_lines.cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"), text.alias(text_col)
    )
