"""Vectors as short codes: a codebook for each of several parts of the vector, fitted by Lloyd rounds over active entries.

Each vector keeps, for each of its parts, the entry it is assigned to and the exact distance to it.  After a round only
some entries have moved.  Where a part's own entry stayed, the distances to all that stayed are no better than before,
so it is held against the moved entries alone; where its own entry moved it is compared with all.  Codebooks are as
large as some vectors and live on the driver; assignments are a written table, and what a round sends back is one sum
for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, joined_counts, stored, stored_at

LIMIT = 1 << 27  # whole components beyond +-LIMIT (|x| from 32,768 at scale 4096) count as that, so that all sums fit 64 bits
AT_ONCE = 1 << 18  # components compared at once


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


@dataclass
class Codebooks:
    entries: np.ndarray  # part, entry, component
    moved: np.ndarray  # part, entry: moved since distances were stored

    def nearest(self, x: np.ndarray, part: int, code: np.ndarray, distance: np.ndarray, fresh: bool) -> None:
        """Put the nearest entry of each row's part, ties to the lower index, in ``code`` and its distance in ``distance``."""
        book, moved = self.entries[part], self.moved[part]

        def squared(rows: np.ndarray, some: np.ndarray) -> np.ndarray:
            made = np.empty((len(rows), len(some)), np.int64)
            for i, e in enumerate(some):
                apart = rows - book[e]
                made[:, i] = np.einsum("ij,ij->i", apart, apart)
            return made

        everything = np.arange(len(book))
        again = np.arange(len(x)) if fresh else np.flatnonzero(moved[code])
        if len(again):
            apart = squared(x[again], everything)
            code[again] = apart.argmin(1)
            distance[again] = apart.min(1)
        active = np.flatnonzero(moved)
        if fresh or not len(active):
            return
        still = np.ones(len(x), bool)
        still[again] = False
        still = np.flatnonzero(still)
        if len(still):
            apart = squared(x[still], active)
            at = apart.argmin(1)
            least, entry = apart.min(1), active[at]
            better = (least < distance[still]) | ((least == distance[still]) & (entry < code[still]))
            code[still[better]], distance[still[better]] = entry[better], least[better]


def _rows(batch: pa.RecordBatch, column: int, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype).astype(np.int64).reshape(batch.num_rows, width)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about AT_ONCE components."""
    rows = max(1, AT_ONCE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _binary(rows: np.ndarray, dtype: str) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(dtype)], pa.binary())


def whole_components(df: DataFrame, keep: list[str], vector: str, scale: int, parts: int) -> DataFrame:
    """(kept columns, ints, width): floor(scale * x) of each component as packed 32-bit words, with zeros up to whole parts."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("ints", T.BinaryType()), T.StructField("width", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, widths = [], []
            for v in batch.column(len(keep)):
                x = np.clip(np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale), -LIMIT, LIMIT)
                made.append(np.pad(x, (0, -len(x) % parts)).astype("<i4").tobytes())
                widths.append(len(x))
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(made, pa.binary()), pa.array(widths, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "ints", "width"])

    return df.select(*keep, vector).mapInArrow(run, schema)


def assign(state: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    """The table with each part's nearest entry and exact distance, from those stored in it unless ``fresh``."""
    parts, _, size = books.entries.shape
    names = [*[c for c in state.columns if c not in ("ints", "codes", "apart")], "ints", "codes", "apart"]
    schema = T.StructType([
        *[state.schema[c] for c in names[:-2]], T.StructField("codes", T.BinaryType()), T.StructField("apart", T.BinaryType()),
    ])
    first = names.index("ints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, parts * size):
            x = _rows(batch, first, parts * size, "<i4")
            if fresh:
                codes, apart = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
            else:
                codes, apart = _rows(batch, first + 1, parts, "u1"), _rows(batch, first + 2, parts, "<i8")
            for p in range(parts):
                code, distance = codes[:, p].copy(), apart[:, p].copy()
                books.nearest(x[:, p * size : (p + 1) * size], p, code, distance, fresh)
                codes[:, p], apart[:, p] = code, distance
            arrays = [*[batch.column(i) for i in range(first + 1)], _binary(codes, "u1"), _binary(apart, "<i8")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return state.select(*names[: first + 1 if fresh else len(names)]).mapInArrow(run, schema)


def sums(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and counts of the parts assigned to each entry: arrays in each task, one sum an entry after it."""
    parts, entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _cut(batches, parts * size):
            x, codes = _rows(batch, 0, parts * size, "<i4"), _rows(batch, 1, parts, "u1")
            for p in range(parts):
                for e in np.unique(codes[:, p]):
                    total[p, e] += x[codes[:, p] == e, p * size : (p + 1) * size].sum(0)
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    found = state.select("ints", "codes").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    placed = found.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    total, n = np.zeros((parts, entries, size), object), np.zeros((parts, entries), object)
    for r in placed.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        total[r["part"], r["entry"], r["place"]], n[r["part"], r["entry"]] = r["x"], r["n"]
    return total, n


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8,
    entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, Codebooks]:
    """(id, code, error, label_error, codebooks_sha256) for each row with a finite vector, and the codebooks.

    Components are taken as floor(scale * x).  A part's codebook starts as that part of the ``entries`` vectors with the
    smallest ids (repeated ids: ordered by the packed bytes of their vectors; null ids last; fewer, if there are fewer vectors), is fitted in
    ``rounds`` rounds and is at most 256 entries.  ``code`` holds two hex digits for each part, ``error`` the squared distance
    to the entries, ``label_error`` its sum over rows of the same label, null labels together.

    Rows whose vector is null or holds a null or non-finite component are left out.  A vector of another length than the
    first one's stays, with null code and error.  Where the length is no multiple of ``parts``, zeros follow.  Components of
    32,768 and more (at the scale 4096) count as 32,768.  Equal distances go to the lower index.  Repeated rows each have
    a result; an empty table gives an empty one; further columns are ignored.
    """
    spark = vectors.sparkSession
    named = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    )
    base = stored(whole_components(named, ["id", "label"], "v", scale, parts), "vectors")
    # only the ids of the smallest first, so that no vectors are sorted but those that may start a codebook
    ids = [r["id"] for r in base.select("id").orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("id").isin([i for i in ids if i is not None]) | F.lit(None in ids) & F.col("id").isNull()
    repeats = base.where(wanted).groupBy("id", "ints", "width").agg(F.count(F.lit(1)).alias("n"))
    ordered = repeats.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    chosen = [(r["ints"], r["width"]) for r in ordered for _ in range(min(r["n"], entries))][:entries]
    width = chosen[0][1] if chosen else 0
    size = -(-width // parts)
    first = [np.frombuffer(x, "<i4").astype(np.int64).reshape(parts, size) for x, w in chosen if w == width]
    books = Codebooks(np.stack(first, 1) if first else np.zeros((parts, 0, size), np.int64), np.ones((parts, len(first)), bool))
    same, other = base.where(F.col("width") == width).drop("width"), base.where(F.col("width") != width)
    state, path = None, None
    for turn in range(rounds + 1):
        if not first or (state is not None and not books.moved.any()):
            break  # nothing has moved: further rounds change nothing
        old = path
        state, path = stored_at(assign(same if state is None else state, books, state is None), f"vector-codes-{turn}")
        discard(spark, old)
        if turn == rounds:
            break
        total, n = sums(state, books)
        new = books.entries.copy()
        for p, e in zip(*np.nonzero(n), strict=True):
            new[p, e] = [x // n[p, e] for x in total[p, e]]
        books = Codebooks(new, (new != books.entries).any(2))
    written = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    return _result(state if state is not None else same, other, id_col, written, spark, parts), books


def _result(state: DataFrame, other: DataFrame, id_col: str, written: str, spark, parts: int) -> DataFrame:
    if "codes" in state.columns:
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                errors = _rows(batch, 3, parts, "<i8").sum(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(errors)], names=["id", "label", "codes", "error"])

        schema = T.StructType([state.schema["id"], state.schema["label"], state.schema["codes"], T.StructField("error", T.LongType())])
        coded = state.select("id", "label", "codes", "apart").mapInArrow(total, schema).withColumn("code", F.lower(F.hex("codes"))).drop("codes")
    else:
        coded = state.select("id", "label", F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("string").alias("code"))
    coded = coded.unionByName(other.select("id", "label", F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("string").alias("code")))
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    rows = coded.select("id", "label", "code", "error")
    return joined_counts(rows, labels, ["label"], "n", coded.count(), "id").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(written).alias("codebooks_sha256")
    )
