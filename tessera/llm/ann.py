"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Every vector is scaled to length one and projected on `DIMS` Gaussian (2-stable) directions: the squared distance of two
projections, over that of the vectors, is chi-square with `DIMS` degrees of freedom. Each task indexes its rows by a
kd-tree over the projections and visits leaves in the order of their projected distance from a query. A vector closer than
the k-th best so far has a projected distance up to the chi-square quantile times the k-th best's with probability `SURE`:
leaves and single vectors beyond that are not verified, and the search ends when no leaf is left within it. The best of all
tasks are merged. Every row is indexed; there is no fitted part. `search` counts the pairs that it verified.

Queries go to the tasks in blocks of at most `QUERIES` vectors, one pass over the rows each, so memory is bounded.

Edge cases: null, zero and non-finite vectors, those with a null component or of another than the most common length,
and null ids take no part; fewer candidates than k give fewer rows; equal scores go to the smaller vec_id; of a repeated
vec_id every row is a query (with a ranking of its own) and a candidate of the others; an empty table gives an empty
result; extra columns are ignored. The input must read the same twice (files, not a random sample).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, with_rid
from .vectors import SEED, cosine, dimension, matrix, unit

K = 5
DIMS = 12
SURE = 0.9
LEAF = 128
QUERIES = 50_000
#: Rows of one tree.
TREE = 65_536


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom, where the tail is a finite sum; by bisection."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projections: leaves as runs of a permutation, with their boxes."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        order, parts = np.arange(len(p)), [(0, len(p))]
        self.leaves = []
        while parts:
            a, b = parts.pop()
            if b - a <= leaf:
                self.leaves.append((a, b))
                continue
            rows = order[a:b]
            axis = int(np.ptp(p[rows], axis=0).argmax())
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(p[rows, axis], half)]
            parts += [(a, a + half), (a + half, b)]
        self.order = order
        self.low = np.stack([p[order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.stack([p[order[a:b]].max(0) for a, b in self.leaves])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each leaf's box, at least."""
        out = np.zeros((len(q), len(self.leaves)))
        for d in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, d] - q[:, d, None], q[:, d, None] - self.high[:, d]), 0)
            out += gap * gap
        return out


def search(qx: np.ndarray, qrow: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, directions: np.ndarray, limit: float, seen_pairs: list | None = None):
    """(query, candidate, cosine) of the k best found for each query; qrow and rows tell a query's own row."""
    xu = unit(x)
    px = xu @ directions
    tree = Tree(px)
    found: list = []
    for lo in range(0, len(qx), 256):
        q, own = unit(qx[lo : lo + 256]), qrow[lo : lo + 256]
        pq = q @ directions
        bound = tree.bounds(pq)
        turn = np.argsort(bound, axis=1, kind="stable")
        best = np.full((len(q), k), -2.0)
        live = np.arange(len(q))
        seen: list = []
        for step in range(len(tree.leaves)):
            leaf = turn[live, step]
            farthest = 2 - 2 * best[live].min(1)  # squared distance of the k-th best
            going = bound[live, leaf] <= farthest * limit
            live, leaf = live[going], leaf[going]
            if not len(live):
                break
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            for some in np.split(order, cuts):
                a, b = tree.leaves[leaf[some[0]]]
                members = tree.order[a:b]
                who = live[some]
                # squared projected distances of the leaf's vectors: those beyond the quantile are left out
                apart = (pq[who] ** 2).sum(1)[:, None] + (px[members] ** 2).sum(1)[None, :] - 2 * pq[who] @ px[members].T
                near = apart <= ((2 - 2 * best[who].min(1)) * limit)[:, None] + 1e-9
                near &= rows[members][None, :] != own[who][:, None]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                if seen_pairs is not None:
                    seen_pairs.append(len(i))
                s = np.full(near.shape, -3.0)
                if 4 * len(i) > near.size:
                    s = np.where(near, q[who] @ xu[members].T, s)
                else:
                    s[i, j] = np.einsum("ij,ij->i", q[who[i]], xu[members[j]])
                best[who] = np.partition(np.concatenate([best[who], s], 1), -k, axis=1)[:, -k:]
                keep = s[i, j] >= best[who[i]].min(1) - 1e-9
                seen.append((who[i[keep]], members[j[keep]], s[i[keep], j[keep]]))
        if seen:
            who, row, s = map(np.concatenate, zip(*seen))
            ok = s >= best[who].min(1) - 1e-9
            who, row = who[ok], row[ok]
            exact = cosine(qx[lo + who], x[row])
            order = np.lexsort((rows[row], ids[row], -exact, who))
            who, row, exact = who[order], row[order], exact[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            top = rank < k
            found.append((lo + who[top], row[top], exact[top]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


SCHEMA = "query long, query_id long, vec_id long, rid long, score double"


def nearest(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for the rows of which `is_query` holds."""
    spark = vectors.sparkSession
    numbered = with_rid(vectors, rid := free_name(vectors, "rid")).where(F.col(id_col).isNotNull())
    rows = numbered.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), is_query.alias("asks"))
    dim = dimension(rows, "v")
    queries = rows.where("asks").select("rid", "vec_id", "v")
    blocks = max(1, -(-queries.count() // QUERIES))
    directions = np.random.default_rng(SEED).normal(size=(dim, DIMS))
    limit = chi_square_quantile(sure, DIMS)
    parts = []
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).toArrow()  # at most about QUERIES vectors
        at, qx = matrix(got["v"], dim) if len(got) else (np.zeros(0, int), np.zeros((0, dim)))
        if not len(at):
            continue
        held = spark.sparkContext.broadcast((got["rid"].to_numpy()[at], got["vec_id"].to_numpy()[at], qx))

        def run(batches, held=held):
            qrow, qid, qx = held.value
            x, ids, rids, n = [], [], [], 0

            def out():
                own, names = np.concatenate(rids), np.concatenate(ids)
                w, r, s = search(qx, qrow, np.concatenate(x), names, own, k, directions, limit)
                return pa.RecordBatch.from_arrays([pa.array(v) for v in (qrow[w], qid[w], names[r], own[r], s)], ["query", "query_id", "vec_id", "rid", "score"])

            for batch in batches:
                at, m = matrix(batch.column(2), dim)
                x.append(m)
                rids.append(batch.column(0).to_numpy()[at])
                ids.append(batch.column(1).to_numpy()[at])
                n += len(m)
                if n >= TREE:
                    yield out()
                    x, ids, rids, n = [], [], [], 0
            if n:
                yield out()

        parts.append(rows.select("rid", "vec_id", "v").mapInArrow(run, SCHEMA))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
