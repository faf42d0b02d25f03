"""Shards of nearly equal size that keep equal texts together: the minimax contiguous partition.

Groups of equal texts are put in the order of their smallest id and cut into as many runs as there are shards, so that the
largest run is as small as possible.  That capacity is found by binary search, a greedy pass telling whether a capacity is
enough.  The pass needs to know where running sums of sizes end; the driver holds these as a summary of bounded size and
asks for finer parts of it, only where a cut may fall, until the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS = 20_000
OVERHEAD = 16


def _numbered(df: DataFrame, order: list[str], kinds: str, value: str, by: str | None = None) -> DataFrame:
    """The frame in a global order, with a running sum of ``value`` in each partition (of each ``by``) and the partition.

    Partitions are ranges of the order, so they are even however many rows share a first key.
    """
    at, by_at = df.columns.index(value), df.columns.index(by) if by else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for batch in batches:
            values = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values)
            if by_at is None:
                out, total = sums + total, total + int(values.sum())
            else:
                keys = batch.column(by_at).to_numpy(zero_copy_only=False)
                begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
                base = np.zeros(len(keys), np.int64)
                for i, b in enumerate(begins):
                    end = begins[i + 1] if i + 1 < len(begins) else len(keys)
                    carried = total if b == 0 and keys[0] == last else 0
                    base[b:end] = carried - (sums[b - 1] if b else 0)
                out = sums + base
                if len(keys):
                    total, last = int(out[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "sum"])

    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    found = sorted_rows.withColumn("part", F.spark_partition_id())
    return found.mapInArrow(run, f"{kinds}, part int, sum bigint")


class _Sums:
    """What is known of the running sums: bins (least, largest, how many sums) in order, some of them opened."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total = groups, total
        self.bins = self._ask([(0, total)])
        self.largest = [b[1] for b in self.bins]

    def _ask(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Bins of the sums in some ranges (from, to], at most about PARTS of them."""
        step = max(1, -(-sum(b - a for a, b in ranges) // PARTS))
        inside, base = None, F.lit(0)
        for a, b in ranges:
            here = (F.col("sum") > a) & (F.col("sum") <= b)
            inside, base = here if inside is None else inside | here, F.when(here, a).otherwise(base)
        found = (
            self.groups.where(inside).select("sum", base.alias("base"))
            .groupBy("base", F.floor((F.col("sum") - F.col("base") - 1) / step).alias("bin"))
            .agg(F.min("sum").alias("lo"), F.max("sum").alias("hi"), F.count("*").alias("n"))
        )
        return sorted((r["lo"], r["hi"], r["n"]) for r in found.collect())

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest sum that is at most x; equal where it is known."""
        i = bisect_right(self.largest, x)
        known = self.largest[i - 1] if i else 0
        if i < len(self.bins) and self.bins[i][0] <= x:
            lo, _, n = self.bins[i]
            return (lo, lo) if n <= 2 else (lo, x)
        return known, known

    def refine(self, ranges: list[tuple[int, int]]) -> None:
        """Open the bins that are not exact and meet one of the ranges."""
        opened = [b for b in self.bins if b[2] > 2 and any(b[0] <= hi and lo <= b[1] for lo, hi in ranges)]
        if opened:
            finer = self._ask([(lo - 1, hi) for lo, hi, _ in opened[:200]])
            gone = set(opened[:200])
            self.bins = sorted([b for b in self.bins if b not in gone] + finer)
            self.largest = [b[1] for b in self.bins]


def _greedy(sums: _Sums, capacity: int, shards: int, side: int) -> list[int] | None:
    """Ends of the runs, each as long as the capacity allows; None if there are too many.  side: 0 at least, 1 at most."""
    ends, at = [], 0
    while at < sums.total:
        to = min(sums.below(at + capacity)[side], sums.total)
        if to <= at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends


def _smallest(sums: _Sums, shards: int, side: int, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if _greedy(sums, middle, shards, side) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Ends of at most ``shards`` runs of ``groups`` (column sum: running sum of sizes) with the least largest run."""
    if not total:
        return []
    sums = _Sums(groups, total)
    while True:
        low = _smallest(sums, shards, 1, -(-total // shards), total)
        high = _smallest(sums, shards, 0, low, total)
        least, most = _greedy(sums, low, shards, 0), _greedy(sums, high, shards, 0)
        sure = _greedy(sums, high, shards, 1)
        if low == high and most == sure:
            return most
        # where the end of a run may be asked for, between the smallest and the largest capacity that are possible
        ranges, a, b = [], 0, 0
        for _ in range(shards):
            if a >= total:
                break
            ranges.append((a + low, min(total, b + high)))
            a, b = max(sums.below(a + low)[0], a), min(total, sums.below(min(total, b + high))[1])
        before = len(sums.bins)
        sums.refine(ranges)
        if len(sums.bins) == before and least is None:
            sums.refine([(0, total)])


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row: slots count from 0 in each shard.

    A row's size is the UTF-8 bytes of its text and 16.  Rows of equal text are one group and stay together; a group that
    alone is as large as an even share gets a shard of its own, the others are cut by ``minimax_cuts``.  With fewer
    groups than shards some shards are empty.  Null counts as the empty text, a null id comes before all others, repeated
    rows are rows of their own; an empty table gives an empty one; further columns are ignored.  Ids are integers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.min("id").alias("first"), F.sum("size").alias("bytes"))
    numbered = stored(_numbered(groups, ["first", "key"], f"key binary, first {id_type}, bytes bigint", "bytes"), "groups")
    # at most ``shards`` groups can be as large as an even share
    top = numbered.orderBy(F.desc("bytes"), F.asc("key")).select("key", "bytes").limit(shards).collect()
    left, remaining, alone = sum(r["s"] or 0 for r in numbered.agg(F.sum("bytes").alias("s")).collect()), shards, []
    for r in top:
        if remaining > 1 and r["bytes"] * remaining >= left and r["bytes"] < left:
            alone.append(bytes(r["key"]))
            left, remaining = left - r["bytes"], remaining - 1
        else:
            break
    if alone:
        is_alone = F.array_contains(F.array(*(F.unhex(F.lit(k.hex())) for k in alone)), F.col("key"))
        others = numbered.where(~is_alone).select("key", "first", "bytes")
        numbered_rest = stored(_numbered(others, ["first", "key"], f"key binary, first {id_type}, bytes bigint", "bytes"), "groups")
        own = numbered.where(is_alone).select("key", "first", F.array_position(F.array(*(F.unhex(F.lit(k.hex())) for k in alone)), F.col("key")).alias("shard"))
    else:
        numbered_rest, own = numbered, None
    before, offsets = 0, []
    for r in sorted((r["part"], r["s"]) for r in numbered_rest.groupBy("part").agg(F.sum("bytes").alias("s")).collect()):
        offsets.append((r[0], before))
        before += r[1]
    spark = docs.sparkSession
    offset = spark.createDataFrame(offsets, "part int, offset bigint")  # one row a partition
    summed = numbered_rest.join(offset, "part").select("key", "first", (F.col("sum") + F.col("offset")).alias("sum"))
    summed = stored(summed, "groups")
    cuts = minimax_cuts(summed, before, remaining)
    number = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("sum")))
    placed = summed.select("key", "first", number.cast("int").alias("shard"))
    if own is not None:
        placed = placed.union(own.select("key", "first", (F.col("shard") - 1 + remaining).cast("int").alias("shard")))
    dealt = rows.join(placed, "key").select("shard", "first", "id", "size", "crc", F.lit(1).alias("one"))
    kinds = f"shard int, first {id_type}, id {id_type}, size bigint, crc bigint, one int"
    counted = stored(_numbered(dealt, ["shard", "first", "id"], kinds, "one", "shard"), "slots")
    held: dict[int, int] = {}
    starts = []
    for part, shard, n in sorted((r["part"], r["shard"], r["n"]) for r in counted.groupBy("part", "shard").agg(F.max("sum").alias("n")).collect()):
        starts.append((part, shard, held.get(shard, 0)))
        held[shard] = held.get(shard, 0) + n
    start = spark.createDataFrame(starts, "part int, shard int, start bigint")  # a row for each partition and shard in it
    return counted.join(start, ["part", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("sum") - 1 + F.col("start")).alias("slot")
    )
