"""Dense search: exact inner products in blocks, and inverted lists over k-means cells.

Queries are sent to the rows in blocks of at most `QUERIES` vectors; a task multiplies them with a few thousand rows at a
time and keeps k for each query, so memory is bounded whatever the tables' sizes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES = 20_000
#: Vectors that cells are fitted on, at most.
SAMPLE = 20_000


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _best(queries: DataFrame, vectors: DataFrame, k: int, allowed=None) -> DataFrame:
    """The k best of each query by inner product, of the rows for which `allowed(query index, cell)` holds if given."""
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES))
    parts = []
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # a block of queries
        if not len(got):
            continue
        held = spark.sparkContext.broadcast((got["id"].to_numpy(), _matrix(got["v"]), np.stack(got["cells"].to_numpy()) if "cells" in got.column_names else None))

        def run(batches, held=held):
            qid, qx, cells = held.value
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.slice(lo, 4096)
                    ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                    for at in range(0, len(qid), 1024):
                        s = np.round(qx[at : at + 1024] @ x.T, 6)
                        s[qid[at : at + 1024, None] == ids[None, :]] = -np.inf
                        if cells is not None:
                            s[~(cells[at : at + 1024, :, None] == part.column(2).to_numpy()[None, None, :]).any(1)] = -np.inf
                        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                        row = np.repeat(np.arange(len(s)), order.shape[1])
                        col = order.ravel()
                        ok = np.isfinite(s[row, col])
                        yield pa.RecordBatch.from_arrays([pa.array(qid[at + row[ok]]), pa.array(ids[col[ok]]), pa.array(s[row[ok], col[ok]])], ["q", "s", "score"])

        parts.append(vectors.mapInArrow(run, "q long, s long, score double"))
    if not parts:
        return spark.createDataFrame([], "q long, s long, score double, rank int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "s")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries, vectors (id, v) -> q, s, score, rank: exact, a vector is never its own neighbour."""
    return _best(queries.select("id", "v"), vectors.select("id", "v"), k)


def cells_of(vectors: DataFrame, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means cells, fitted on at most SAMPLE vectors (the smallest hashes)."""
    x = _matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"])
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        sums, size = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def ivf_top_k(queries: DataFrame, vectors: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """Inverted lists: 4 sqrt(n) cells; a query looks into the cells of its nearest centres only."""
    n = vectors.count()
    centres = cells_of(vectors, int(4 * math.sqrt(max(1, n))))

    def assign(most, wide):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                dist = (centres * centres).sum(1) - 2 * x @ centres.T
                near = np.argsort(dist, axis=1, kind="stable")[:, :most].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.int32())) if wide else pa.array(near[:, 0])], ["id", "v", "cells"])

        return run

    kind = vectors.schema["v"].dataType.simpleString()
    q = queries.select("id", "v").mapInArrow(assign(min(probes, len(centres)), True), f"id long, v {kind}, cells array<int>")
    v = vectors.select("id", "v").mapInArrow(assign(1, False), f"id long, v {kind}, cells int")
    return _best(q, v, k)
