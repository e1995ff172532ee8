"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are collapsed first (one class with a count). Centroids are fitted by spherical k-means on at most `SAMPLE`
classes; every class is assigned to its `PROBES` nearest cells, since a link may cross a border. A cell is cut into
blocks of about `BLOCK` classes and each two blocks are one task, so that a hot cell is many tasks; a pair that meets in
several cells counts in the first of them only. A task returns how many vectors each class links with and a forest of
its links, not the pairs; components are then joined over all tasks.

Links are those found: a pair is missed if its nearest cells are all different. Measured recall against brute force
is in the README.

Edge cases: null, zero and non-finite vectors, those with a null component and those of another than the most common
length link with nothing (n_links 0, their own component, kept); so do rows with a null vec_id, whose component is null;
equal vectors all link; repeated rows count each, also where one vec_id stands for different vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored
from .components import components
from .vectors import SEED, cosine, dimension, matrix, unit

#: Classes that the centroids are fitted on, at most.
SAMPLE = 40_000
#: Classes for each cell, and cells at most (what the driver fits and every task holds).
PER_CELL, MOST_CELLS = 200, 4096
PROBES = 6
BLOCK = 2048
THRESHOLD = 0.9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell is given the vector that is worst served."""
    rng = np.random.default_rng(SEED)
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(rounds):
        s = x @ c.T
        cell = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.sqrt((sums * sums).sum(1))
        bad = np.flatnonzero(norm < 1e-12)
        if len(bad):
            sums[bad] = x[np.argsort(s.max(1), kind="stable")[: len(bad)]]
            norm = np.sqrt((sums * sums).sum(1))
        c = sums / norm[:, None]
    return c


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that two rows of cells share."""
    shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int32).max)
    return shared.min(1)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, dim: int):
    def run(key, table):
        t = table.sort_by([("cid", "ascending")])
        rep, m, block = (t[c].to_numpy() for c in ("cid", "m", "block"))
        cells = np.stack(t["cells"].to_numpy())
        x = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(-1, dim)
        cell, i, j = (k.as_py() for k in key)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links = np.zeros(len(rep), np.int64)
        pairs: list = []
        label = np.arange(len(rep))
        for lo in range(0, len(left), 512):
            mine = left[lo : lo + 512]
            a, b = np.nonzero((near := x[mine] @ x[right].T) >= threshold - 1e-12)
            close = near[a, b] < threshold + 1e-12
            a, b = mine[a], right[b]
            if close.any():  # products of blocks round as they please: pairs at the threshold are asked one by one
                ok = ~close
                ok[close] = cosine(x[a[close]], x[b[close]]) >= threshold
                a, b = a[ok], b[ok]
            if i == j:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 18):
                p, q = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                own = _first_common(cells[p], cells[q]) == cell
                p, q = p[own], q[own]
                links += np.bincount(p, m[q], len(rep)).astype(np.int64) + np.bincount(q, m[p], len(rep)).astype(np.int64)
                pairs.append(np.stack([p, q]))
            if pairs:
                p, q = np.concatenate(pairs, 1)
                label = _forest(len(rep), np.concatenate([p, np.arange(len(rep))]), np.concatenate([q, label]))
                pairs = []
        some = np.flatnonzero(links)
        return pa.table({"a": rep[some], "b": rep[label[some]], "n": links[some]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    dim = dimension(rows, "v")

    def keyed(batches):
        for batch in batches:
            at, x = matrix(batch.column(1), dim)
            vec = np.empty(len(batch), object)
            vec[at] = [r.tobytes() for r in unit(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["vec_id", "vec"])

    read = rows.mapInArrow(keyed, "vec_id long, vec binary").withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec")))
    keyed_rows = Stored(read.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64("vec", F.lit(SEED))), "vectors").df
    grouped = keyed_rows.where("vec IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    # a class has a number of its own: the same vec_id may stand for different vectors
    classes = Stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes").df
    n = classes.count()
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("vec").toArrow()["vec"].to_pylist()
    k = max(1, min(MOST_CELLS, n // PER_CELL, len(sample)))
    centres = spherical_kmeans(np.frombuffer(b"".join(sample), np.float64).reshape(-1, dim), k) if sample else np.zeros((0, max(dim, 1)))
    t = min(probes, k)

    def assign(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, dim)
            s = x @ centres.T
            near = np.sort(np.argpartition(-s, t - 1, axis=1)[:, :t].astype(np.int32), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.int32())), batch.column(2)], ["cid", "m", "cells", "vec"])

    placed = classes.select("cid", "m", "vec").mapInArrow(assign, "cid long, m long, cells array<int>, vec binary").withColumn("cell", F.explode("cells"))
    sizes = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row for each cell: at most MOST_CELLS
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    tiles = dealt.withColumn("tile", F.explode(others)).select("cell", "tile.i", "tile.j", "block", "cid", "m", "cells", "vec")
    found = Stored(tiles.groupBy("cell", "i", "j").applyInArrow(_compare(threshold, dim), "a long, b long, n long"), "found").df

    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("a <> b").select("a", "b"))
    labelled = (
        classes.select("k1", "k2", "cid", "rep", "m")
        .join(links.withColumnRenamed("a", "cid"), "cid", "left")
        .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = labelled.join(least, "component").select("k1", "k2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    live = keyed_rows.where("vec IS NOT NULL").select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    idle = keyed_rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return live.unionByName(idle).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
