"""Exact top-k search by inner product: a join over the Voronoi cells of pivots.

Queries are grouped by their nearest pivot p; a group's radius R is the largest distance from a query to p.  For a query q
of the group and any vector s, q.s is within R |s| of p.s.  So the (k+1)-th largest p.s - R |s| over all vectors is a score
that every query of the group reaches k times, and only vectors with p.s + R |s| at or above it need to be sent to the
group.  What is sent is cut into blocks, each solved by one product of matrices; the blocks' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS = 16
BLOCK = 8192
QUERY_BLOCK = 1024
EXACT = float(1 << 53)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(float)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x); rows with a null or non-finite component are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    return vectors.where(F.col(vector_col).isNotNull()).where(~F.coalesce(bad, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact also where they do not fit a double."""
    bound = np.sqrt((q**2).sum(1).max(initial=0) * (s**2).sum(1).max(initial=0))
    if bound < EXACT:
        return (q @ s.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in s], object).reshape(s.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def nearest_by_product(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query with the other rows' vectors.

    ``is_query`` is a condition on the id column.  Components count as floor(scale * x); ties go to the smaller id.  Rows
    whose vector is null or holds a null, NaN or infinite component take no part, nor do rows with a null id; shorter vectors
    are filled up with zeros.  A query does not meet rows of its own id.  Fewer than k others: all of them.  An empty
    table, or one without a query, gives an empty one; further columns are ignored.
    """
    spark = vectors.sparkSession
    data = whole_numbers(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col, scale)
    asked = whole_numbers(vectors.where(F.col(id_col).isNotNull() & is_query), id_col, vector_col, scale)
    id_type = vectors.schema[id_col].dataType.simpleString()
    width = data.agg(F.max(F.size("v"))).first()[0] or 0
    chosen = asked.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    shape = f"query_id {id_type}, {id_col} {id_type}, score bigint"
    if not width or not chosen:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score bigint")
    p = np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in chosen])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            apart = ((x[:, None, :] - p[None]) ** 2).sum(2)
            g = apart.argmin(1)
            far = np.sqrt(apart[np.arange(len(g)), g])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(far)], names=["id", "v", "g", "far"])

    grouped = stored(asked.mapInArrow(nearest, f"id {id_type}, v array<double>, g int, far double"), "queries")
    radius, count = np.full(len(p), -1.0), np.zeros(len(p), int)
    for r in grouped.groupBy("g").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():
        radius[r["g"]], count[r["g"]] = r["r"] * (1 + 1e-9) + 1e-6, r["n"]
    live = np.flatnonzero(radius >= 0)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(live), k + 1), -np.inf)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            low = p[live] @ x.T - radius[live, None] * np.sqrt((x**2).sum(1))[None]
            best = -np.sort(-np.concatenate([best, low], 1), 1)[:, : k + 1]
        g, value = np.repeat(live, k + 1), best.ravel()
        on = np.isfinite(value)
        yield pa.RecordBatch.from_arrays([pa.array(g[on].astype(np.int32)), pa.array(value[on])], names=["g", "low"])

    ranked = data.mapInArrow(bounds, "g int, low double").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("low"))))
    reached = {r["g"]: r["low"] for r in ranked.where(F.col("n") == k + 1).collect()}
    floor = np.array([reached.get(int(g), -np.inf) for g in live])
    floor -= np.abs(np.where(np.isfinite(floor), floor, 0)) * 1e-9 + 1e-3

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            high = p[live] @ x.T + radius[live, None] * np.sqrt((x**2).sum(1))[None]
            which, row = np.nonzero(high >= floor[:, None])
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(live[which].astype(np.int32))], names=["id", "v", "g"])

    sent = stored(data.mapInArrow(needed, f"id {id_type}, v array<double>, g int"), "sent")
    blocks = {r["g"]: -(-r["n"] // BLOCK) for r in sent.groupBy("g").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame([(int(g), int(blocks.get(int(g), 1)), int(-(-count[g] // QUERY_BLOCK))) for g in live], "g int, blocks int, q_blocks int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = sent.join(F.broadcast(plan), "g").select("g", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("x"), spread("q_blocks").alias("y"), "id", "v")
    right = grouped.join(F.broadcast(plan), "g").select("g", spread("blocks").alias("x"), F.pmod(F.xxhash64("id"), "q_blocks").cast("int").alias("y"), "id", "v")

    def solve(s: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], s.schema.field("id").type), id_col: pa.array([], s.schema.field("id").type), "score": pa.array([], pa.int64())})
        if not s.num_rows or not q.num_rows:
            return empty
        sv, si = _matrix(s.column("v"), width), s.column("id").to_numpy()
        qv, qi = _matrix(q.column("v"), width), q.column("id").to_numpy()
        out = []
        for at in range(0, len(qi), 128):
            scores = _products(qv[at : at + 128], sv)
            for i, row in zip(qi[at : at + 128], scores, strict=True):
                may = si != i
                ids, row = si[may], row[may]
                if len(row) > 4 * k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    ids, row = ids[row >= least], row[row >= least]
                top = np.lexsort((ids, -row.astype(float) if abs(row).max(initial=0) < EXACT else [-int(r) for r in row]))[:k]
                out.append((np.full(len(top), i), ids[top], row[top]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, empty.schema, strict=True)], schema=empty.schema)

    keys = ["g", "x", "y"]
    solved = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
