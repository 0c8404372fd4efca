"""Connected components of links between ids, as DataFrame steps; nothing is collected but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop, written


def _dealt(low: DataFrame) -> DataFrame:
    """The rows dealt by all columns, so that a join by one deals both sides anew: only then can Spark split a hub's rows."""
    return low.repartition(F.xxhash64(*low.columns))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's greater neighbours move to the least node of its neighbourhood. Small: its lesser ones, and itself, do."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(_dealt(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(_dealt(low), "b")
    out = near.select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id reachable) of every id in links (a, b) but the roots themselves.

    Alternating large-star and small-star steps until the edges, compared by count and hash sum, stand still;
    rounds grow with the logarithm of the links. Each round's edges are written to the shared folder, and those of the round before go.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    was = mark(edges)
    while was[0]:
        last, edges = edges, written(_star(_star(edges, True), False), "links")
        drop(last)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
