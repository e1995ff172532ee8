"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with a > b: neighbours are linked to the least node of their neighbourhood.

    Least neighbours are aggregated map-side before the join back, so a node with very many links is no hot group.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    up = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (a, b) of comparable nodes -> (node, component): the least node reachable, for every node that has a link.

    Every round is written to the shared folder; memory doesn't grow with a component. Links that `rounds` rounds don't
    settle raise an error: a labelling that isn't final is no result.
    """
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = Stored(start, "links")
    before = _mark(now.df)
    for _ in range(rounds if before[0] else 0):
        then = Stored(_stars(_stars(now.df, True), False), "links")
        after = _mark(then.df)
        now.drop()
        now = then
        settled, before = after == before, after
        if settled:
            break
    else:
        if before[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    out = now.df
    return out.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(out.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
